"""Near copies by the exact Jaccard similarity of their sets of word shingles: SimHash first, keys of the sets for the rest.

A SimHash finds the nearest copies cheaply, but sets of similarity ``NUM / DEN`` differ in more of its bits than any table of
bounded cost looks up. The other candidates share a key:

* small sets (up to ``SMALL`` shingles, and those that may be similar to one) by prefix filtering: under any one order of all
  shingles two similar sets share one of the first n - ceil(n * NUM / DEN) + 1 of each, so no pair is missed;
* larger sets by ``BANDS`` keys of ``ROWS`` least hashes each, taken from as many ranges of the hashes (empty ranges borrow from
  others). A pair at the threshold shares no key with a probability of (1 - 0.8 ** ROWS) ** BANDS, 7e-6; closer ones less often.

1. each text is its set of shingle hashes, and its fingerprint is their majority; equal sets are one row throughout, known by
   a hash of the set;
2. pairs whose fingerprints differ in at most ``BITS`` bits come from the multi-index tables of ``simhash``;
3. keys that no other set has are dropped, and each other set meets a hub, one set for each key; pairs of 2. and 3. that pass
   are linked;
4. whatever is not in the largest component of a key by then meets up to ``MORE_HUBS`` sets that are;
5. whatever is still not in it meets all others there: as pairs where a key has up to ``FEW`` sets, else in blocks that hold the
   whole sets and give a spanning forest of their links, so that no pair of a large group becomes a row;
6. a pair is linked if both whole sets are similar enough; pairs whose sizes, places or signatures rule that out are not looked
   at. A signature has a bit of each of 256 least hashes; it rules out a pair at the threshold with a probability below 1e-6.

Shingles that are common in a sample of documents go last in the order. That order is a matter of cost alone: whatever the
sample shows, the links are the same. A large group of copies costs keys times hubs, not the square of its size, where
the hubs connect it.

Defined cases: texts without a word have the empty set and are copies of each other; a text of fewer words than a shingle is
one shingle; rows of one id are one document; null ids are left out; an empty table gives an empty one. Shingles and sets are
told apart by 64-bit hashes, the shingles of sets that are compared by 32 bits of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, field, map_texts, only_cache, slices, staged, tidy
from .components import blocked, components, forest
from .simhash import BITS, majority, near_links

WORDS = 5
NUM, DEN = 4, 5
SEED = 42
#: Shingles up to which a set is small; larger ones have so many keys, of so many least hashes each.
SMALL = 160
BANDS, ROWS = 32, 5
#: Further hubs that a key's sets meet if they are not connected with its first one.
MORE_HUBS = 16
#: Sets of a key up to which the pairs that are left are rows.
FEW = 64
#: A block of a larger key: so many hashes in its sets, each counting for ``LEAST`` at least (1024 sets at most).
BLOCK, LEAST = 1 << 18, 256
#: One document of so many is looked at for common shingles; so many of these make one common, and so many are remembered at most.
SAMPLE, COMMON, REMEMBERED = 16, 8, 1 << 18

_space = re.compile(r"[\x20\x09-\x0D]+")
_upper = {c: c + 32 for c in range(65, 91)}


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """The hash of each of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest as digest

    raw = [w.encode("utf-8", "surrogatepass") for w in _space.split(text.translate(_upper) if not text.isascii() else text.lower()) if w]
    if not raw:
        return np.zeros(0, np.uint64)
    whole = b" ".join(raw)
    if len(raw) <= size:
        return np.array([digest(whole, SEED)], np.uint64)
    view = memoryview(whole)
    ends = np.cumsum([len(w) + 1 for w in raw])
    begin = [0, *ends[: len(raw) - size].tolist()]
    stop = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(view[a:b], SEED) for a, b in zip(begin, stop, strict=True)], np.uint64)


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, size))


#: Where a range of hashes without a member looks for one, in this order.
_borrow = np.random.default_rng(SEED).integers(0, BANDS * ROWS, (BANDS * ROWS, 64))
_edges = (np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(2**64 // (BANDS * ROWS))).astype(np.uint64)
_odd = np.random.default_rng([SEED, 1]).integers(1, 2**63, (2, ROWS)).astype(np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a set of many hashes (ascending): equal least hashes in the same ranges make the same key."""
    at = np.searchsorted(found, _edges)
    filled = np.concatenate([at[1:], [len(found)]]) > at
    low = found[np.minimum(at, len(found) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        source = _borrow[empty]
        low[empty] = low[source[np.arange(len(empty)), filled[source].argmax(axis=1)]]
    rows = low.reshape(BANDS, ROWS)
    x = (rows ^ (rows >> np.uint64(29))) * _odd[0]
    x = ((x ^ (x >> np.uint64(32))) * _odd[1]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(33))


_turn = np.random.default_rng([SEED, 2]).integers(1, 2**63, 4).astype(np.uint64) | np.uint64(1)
_sixty_four = np.arange(64, dtype=np.uint64) << np.uint64(58)
_look = np.random.default_rng([SEED, 3]).integers(0, 64, (64, 64))
_bits = np.uint64(1) << np.arange(64, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """Four times 64 bits: one of the least hash of each 64th of the range, under four orders of the hashes."""
    out = np.zeros(4, np.uint64)
    if not len(found):
        return out
    for k in range(4):
        h = found * _turn[k]
        h = np.sort((h ^ (h >> np.uint64(32))) * _turn[k - 1])
        at = np.searchsorted(h, _sixty_four)
        filled = np.concatenate([at[1:], [len(h)]]) > at
        low = h[np.minimum(at, len(h) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            source = _look[empty]
            low[empty] = low[source[np.arange(len(empty)), filled[source].argmax(axis=1)]]
        low = (low ^ (low >> np.uint64(29))) * _odd[0, 0]
        out[k] = _bits[(low >> np.uint64(40)) & np.uint64(1) == 1].sum(dtype=np.uint64)
    return out


def key_of(found: np.ndarray) -> int:
    """A hash of a set."""
    from xxhash import xxh64_intdigest as digest

    return int(np.uint64(digest(found.tobytes(), SEED)).view(np.int64))


def first_of(found: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The entries of a set: rare shingles in the order of their hashes, then the ``common`` (ascending) by ``place``."""
    n = len(found)
    if not n:
        return found
    many = n - -(-n * NUM // DEN) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hot = common[at] == found
        if hot.any():
            late = found[hot]
            found = np.concatenate([found[~hot], late[np.argsort(place[at[hot]], kind="stable")]])
    return found[:many]


def keys_of(found: np.ndarray, common: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set and their places; a key of a larger set has place 0, which rules nothing out."""
    first = first_of(found, common, place) if len(found) * NUM <= SMALL * DEN else found[:0]
    bands = band_keys(found) if len(found) > SMALL else found[:0]
    return np.concatenate([first, bands]), np.concatenate([np.arange(len(first), dtype=np.int32), np.zeros(len(bands), np.int32)])


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the sampled small documents have, ascending, and the place of each by how common it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("shingles")
        for whole in batches:
            for b in slices(whole, 0):
                sets = [shingle_set(t or "", size) for t in b.column(0).to_pylist()]
                sets = [np.zeros(0, np.uint64), *(x for x in sets if len(x) * NUM <= SMALL * DEN)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidy(run), "h long")
    rows = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(REMEMBERED).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], -order  # the most common one is the last


def with_keys(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, s, n, fp, sig, keys, places): the hash of each document's set, its size, fingerprint, signature and keys."""
    common, place = common_shingles(docs, size)

    def make():
        only_cache("shingles")

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            every = [shingle_hashes(t, size) for t in texts]
            counts = np.fromiter(map(len, every), np.int64, len(every))
            fp = np.zeros(len(every), np.uint64)
            if len(some := np.flatnonzero(counts)):
                fp[some] = majority(np.concatenate(every), counts[some])
            sets = [np.unique(x) for x in every]
            keys = [keys_of(x, common, place) for x in sets]
            return [
                pa.array([key_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(fp.view(np.int64)),
                pa.array([signature(x).view(np.int64) for x in sets], pa.list_(pa.int64())),
                pa.array([k.view(np.int64) for k, _ in keys], pa.list_(pa.int64())), pa.array([i for _, i in keys], pa.list_(pa.int32())),
            ]

        return run

    return map_texts(docs, "text", [field("s", "long"), field("n", "int"), field("fp", "long"), field("sig", "array<bigint>"), field("keys", "array<bigint>"), field("places", "array<int>")], make, drop=("text",))


def with_sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (s, n, hashes) of the documents (id, s, n, text) whose text has the set ``s``; 32 bits of each hash."""

    def make():
        only_cache("shingles")

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            sets = [shingle_set(t, size) for t in texts]
            return [pa.array([key_of(x) for x in sets], pa.int64()), pa.array([x.astype(np.uint32).view(np.int32) for x in sets], pa.list_(pa.int32()))]

        return run

    made = map_texts(docs.select("s", "n", "text"), "text", [field("found", "long"), field("hashes", "array<int>")], make, drop=("text",))
    return made.where("s = found").select("s", "n", "hashes")


def admits(one: str = "", other: str = "2") -> Column:
    """Whether sets of these sizes, first common shingles at these places and signatures can be similar enough."""
    na, ia, nb, ib = (F.col(f"{x}{y}") for y in (one, other) for x in ("n", "i"))
    least = F.least(na - ia, nb - ib).cast("long")
    fits = least * (NUM + DEN) >= (na.cast("long") + nb) * NUM
    # similar sets differ in a tenth of the bits; small ones fill fewer ranges, so that their bits vary more
    n = F.least(na, nb)
    most = F.when(n < 24, F.lit(256.0)).otherwise(25.6 + 5.5 * 0.3 * 256 / F.sqrt(256 * (1 - F.exp(-n / 64))))
    differ = sum(F.bit_count(F.col(f"sig{one}")[k].bitwiseXOR(F.col(f"sig{other}")[k])) for k in range(4))
    return fits & (differ <= most)


def near_prints(made: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of sets that connect all whose fingerprints differ in at most ``bits`` bits."""
    sets = made.select("s", "fp").distinct()
    prints = staged(sets.groupBy("fp").agg(F.min("s").alias("node")).select("fp", F.lit(0).cast("long").alias("more"), "node"), "fingerprints")
    same = sets.join(prints, "fp").where("s <> node").select(F.col("node").alias("a"), F.col("s").alias("b"))
    return near_links(prints, bits).unionByName(same)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    one = pairs.join(sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("y")), "b")
    enough = F.size(F.array_intersect("x", "y")).cast("long") * (NUM + DEN) >= (F.col("na").cast("long") + F.col("nb")) * NUM
    return both.where(enough).select("a", "b").distinct()


def admitted(n: np.ndarray, i: np.ndarray, sig: np.ndarray, k: int, rest: np.ndarray) -> np.ndarray:
    """``admits`` of row ``k`` and each of ``rest``."""
    fits = np.minimum(n[k] - i[k], n[rest] - i[rest]) * (NUM + DEN) >= (n[k] + n[rest]) * NUM
    less = np.minimum(n[k], n[rest])
    most = np.where(less < 24, 256.0, 25.6 + 5.5 * 0.3 * 256 / np.sqrt(256 * (1 - np.exp(-np.maximum(less, 1) / 64))))
    return fits & (np.bitwise_count(sig[k] ^ sig[rest]).sum(axis=1, dtype=np.int64) <= most)


def bitmaps(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of bits for each set, of ``sizes`` of the ``hashes``: one for each hash that occurs again."""
    _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    again = n[at] > 1
    row, at = np.repeat(np.arange(len(sizes)), sizes)[again], column[at[again]]
    out = np.zeros((len(sizes), int((n > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (row, at >> 6), _bits[at & 63])
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group; rows come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b])
        cols = [t.column(k).to_numpy() for k in keys]
        starts = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols])) + 1).tolist()]
        for a, z in zip(starts, starts[1:], strict=False):
            yield t.slice(a, z - a)
        held = t.slice(starts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def forest_links(t: pa.Table) -> list[tuple[int, int]]:
    """Links that connect the components of a block pair (bi, bj, side, s, n, i, sig, c, hashes) wherever two of its sets do."""
    s, n, i, c, side = (t.column(x).to_numpy().astype(np.int64) for x in ("s", "n", "i", "c", "side"))
    sig = t.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 4)
    lists = t.column("hashes").combine_chunks()
    bits = bitmaps(lists.flatten().to_numpy(), lists.value_lengths().to_numpy())
    cross = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()

    def neighbours(k: int, rest: np.ndarray) -> np.ndarray:
        near = c[rest] == c[k]
        fit = np.flatnonzero(~near & admitted(n, i, sig, k, rest) & ((side[rest] != side[k]) | (not cross)))
        if len(fit):
            others, words = rest[fit], np.flatnonzero(bits[k])
            shared = np.bitwise_count(bits[np.ix_(others, words)] & bits[k, words]).sum(axis=1, dtype=np.int64)
            near[fit] = shared * (NUM + DEN) >= (n[k] + n[others]) * NUM
        return near

    return [(int(s[a]), int(s[b])) for a, b in forest(len(s), neighbours) if c[a] != c[b]]


def linked_in_blocks(tagged: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is similar enough among the sets of a key (h, s, n, i, sig, c), c being what is connected."""
    other = tagged.select("h", *[F.col(x).alias(f"{x}2") for x in ("n", "i", "sig", "c")]).withColumnRenamed("h", "h2")
    close = staged(tagged.join(other, (F.col("h") == F.col("h2")) & (F.col("c") != F.col("c2")) & admits(), "left_semi"), "close-keys")
    dealt = staged(blocked(close, ["h"], "s", BLOCK, weight=F.greatest("n", F.lit(LEAST))), "close-blocks")
    keys = ["h", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, keys):
            links = forest_links(t)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    rows = dealt.join(sets.select("s", "hashes"), "s").select(*keys, "side", "s", "n", "i", "sig", "c", "hashes")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, bits: int = BITS) -> DataFrame:
    """(id, component_id) of each distinct id: the least id that is reachable over pairs of similarity NUM / DEN or more."""
    spark = df.sparkSession
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = staged(with_keys(docs, size), "shingle-keys")
    lead = staged(made.groupBy("s").agg(F.min("id").alias("id")), "set-leads")
    every = staged(made.join(lead, ["s", "id"], "left_semi").select("s", "n", F.explode(F.arrays_zip(F.col("keys").alias("h"), F.col("places").alias("i"))).alias("k")).select("s", "n", "k.h", "k.i").distinct(), "keys")
    twice = staged(every.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "keys-twice")
    signs = made.groupBy("s").agg(F.first("sig").alias("sig"))
    some = staged(every.join(twice, "h", "left_semi").join(signs, "s"), "shared-keys")
    discard(spark, every)
    discard(spark, twice)

    hubs = some.groupBy("h").agg(F.min(F.struct("s", "n", "i", "sig")).alias("hub"))
    hubs = staged(hubs.select("h", *[F.col(f"hub.{x}").alias(f"{x}2") for x in ("s", "n", "i", "sig")]), "hubs")
    met = some.join(hubs, "h").where((F.col("s") != F.col("s2")) & admits())
    met = met.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b"))
    near = near_prints(made, bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = staged(met.unionByName(near).distinct(), "hub-pairs")
    wanted = staged(some.select("s").unionByName(met.select(F.col("a").alias("s"))).unionByName(met.select(F.col("b").alias("s"))).distinct(), "sets-wanted")
    rep = made.select("id", "s", "n").join(lead.join(wanted, "s", "left_semi"), ["s", "id"], "left_semi").distinct()
    sets = staged(with_sets(docs.join(rep, "id").select("s", "n", "text"), size), "shingle-sets")
    # rows of one id are one document, whatever their sets
    same = made.groupBy("id").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a <> z").select("id", "a").join(made.select("id", F.col("s").alias("b")), "id").select("a", "b")
    links = staged(verified(met, sets).unionByName(same), "hub-links")

    def apart_from_most(comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Keys with the components of their sets and the largest one among them, and those that are not in it."""
        tagged = some.join(comp.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("c", F.coalesce("component", "s")).drop("component")
        tagged = staged(tagged, "tagged-keys")
        most = tagged.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("k"), F.sum("m").alias("size"))
        tagged = staged(tagged.join(staged(most.where("k > 1").select("h", F.col("most.c").alias("hc"), "size"), "key-components"), "h"), "tagged-keys")
        return tagged, tagged.where("c <> hc").select("h", *[F.col(x).alias(f"{x}2") for x in ("s", "n", "i", "sig", "c")])

    comp = staged(components(links, "hub-components"), "hub-components")
    tagged, apart = apart_from_most(comp)
    slot = F.pmod(F.xxhash64("s"), F.lit(MORE_HUBS))
    inside = tagged.where("c = hc").groupBy("h").agg(F.array(*[F.min(F.when(slot == j, F.struct("s", "n", "i", "sig"))) for j in range(MORE_HUBS)]).alias("more"))
    again = staged(inside.select("h", F.explode(F.filter("more", lambda x: x.isNotNull())).alias("x")).select("h", "x.*"), "more-hubs")
    again = again.join(apart, "h").where(admits()).select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct()
    again = staged(again.join(met, ["a", "b"], "left_anti"), "more-pairs")
    more = staged(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(again, sets)), "more-links")

    comp = staged(components(more, "more-components"), "more-components")
    tagged, apart = apart_from_most(comp)
    rest = tagged.where(F.col("size") <= FEW).join(apart, "h").where((F.col("c") != F.col("c2")) & admits())
    rest = rest.select(F.least("s", "s2").alias("a"), F.greatest("s", "s2").alias("b")).distinct()
    rest = staged(rest.join(met.unionByName(again), ["a", "b"], "left_anti"), "rest-pairs")
    hot = linked_in_blocks(tagged.where(F.col("size") > FEW).select("h", "s", "n", "i", "sig", "c"), sets)
    found = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(rest, sets)).unionByName(hot), "copy-links")

    placed = made.select("id", "s").join(found.withColumnRenamed("node", "s"), "s", "left").select("id", F.coalesce("component", "s").alias("c"))
    first = staged(placed.groupBy("c").agg(F.min("id").alias("component_id")), "component-leads")  # so that a large component can be split
    out = staged(placed.join(first, "c").select(F.col("id").alias(id_col), "component_id").distinct(), "near-copies")
    for x in (lead, some, hubs, wanted, sets, tagged, rest, met, made):
        discard(spark, x)
    return out
