"""Exact removal of repeated byte strings by suffix arrays over shards.

A string of ``length`` bytes that occurs twice has the same least ``GRAM``-byte hash in both places, at the same offset. So

1. each text is cut into runs of strings that share the place of their least hash (the anchor); a run's bytes, from its first
   string to the end of its last, are its context, told from others by a second hash;
2. anchors that occur once cannot be repeated and are dropped; contexts that occur twice are repeated from end to end;
3. what is left, each different context of an anchor that has several, goes to the shard of its anchor. There its bytes make
   a suffix array (Larsson-Sadakane: ranks by 8 bytes, then doubled to the end, only unsorted groups being sorted again), whose
   neighbours' common prefixes (Kasai) tell which strings occur twice;
4. an anchor with more than ``SHARD_CONTEXTS`` contexts is dealt to several shards; the sorted digests of their strings, one for
   each that differs within its shard, are then merged: each shard's run is looked up in those of the others by binary search;
5. the strings found give byte ranges, which are removed from each text.

Shards hold a bounded number of contexts, no anchor or text is brought together in one task, and no text is read in part.

Contexts are told apart by two hashes of 64 bits each.

Defined cases: a null text counts as the empty one; texts shorter than ``length`` lose nothing; repeated rows lose all of a
text that is long enough; documents are told apart by id and text, null ids too; an empty table gives an empty one; columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, only_cache, slices, staged, tidy

LENGTH = 200
GRAM = 32
#: Contexts of one anchor that a shard takes; more are dealt to several.
SHARD_CONTEXTS = 1024
#: Bytes of contexts that a suffix array is made over, unless one anchor has more.
SHARD_BYTES = 1 << 19
#: Strings that start within so many bytes are hashed at once.
SEGMENT = 1 << 20

#: A string of a run: two digests, its context and its place there.
RUN = np.dtype([("d1", np.uint64), ("d2", np.uint64), ("c", np.int64), ("i", np.int32)])

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=16).digest() for i in range(256)), np.uint64).reshape(256, 2)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SEGMENT + 4096), x)])) for x in (*_BASE, *_INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of some bytes, by prefix sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = powers(len(data) + 1)[which], powers(len(data) + 1)[which + 2]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[:, which][data] * self.up[: len(data)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def runs_of(raws: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of some texts together: document, anchor hash, context hash, first string and number of further strings of each run."""
    lens = np.fromiter(map(len, raws), np.int64, len(raws))
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    starts = np.cumsum(lens) - lens
    low = np.uint64((1 << 24) - 1)
    one, two = Rolling(data, 0), Rolling(data, 1)
    grams = one.all(gram)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    strings = np.maximum(lens - length + 1, 0)
    doc = np.repeat(np.arange(len(raws)), strings)
    at = np.arange(len(doc)) + (starts - (np.cumsum(strings) - strings))[doc]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    m = least[at]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    p0, p1, x = at[first], at[last], (m[first] & low).astype(np.int64)
    context = mix(two.of(p0, p1 + length) + (x - p0).astype(np.uint64) * _BASE[1] + (p1 - p0).astype(np.uint64))
    d = doc[first]
    return d, grams[x].view(np.int64), context.view(np.int64), p0 - starts[d], p1 - p0


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (d, v, h, c, p, w): document, anchor, context, first string, further strings. ``docs`` has d, v and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("suffix_dedup", _powers.clear)
        for whole in batches:
            for b in slices(whole, 2, SEGMENT):
                raws, owner, base = [], [], []
                for i, t in enumerate(b.column(2).to_pylist()):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    for a in range(0, max(1, len(raw)), SEGMENT):  # a long text in segments of strings, which overlap in bytes
                        raws.append(raw[a : a + SEGMENT + length - 1])
                        owner.append(i)
                        base.append(a)
                packs: list[list[int]] = [[]]
                size = 0
                for k, r in enumerate(raws):
                    if packs[-1] and size + len(r) > 2 * SEGMENT:
                        packs.append([])
                        size = 0
                    packs[-1].append(k)
                    size += len(r)
                for pack in packs:
                    d, h, c, p, w = runs_of([raws[k] for k in pack], length, gram)
                    src = np.array(pack, np.int64)[d] if len(pack) else d
                    at = pa.array(np.array(owner, np.int64)[src])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(h), pa.array(c), pa.array(p + np.array(base, np.int64)[src]), pa.array(w.astype(np.int32))], names=["d", "v", "h", "c", "p", "w"])

    return docs.select("d", "v", "text").mapInArrow(tidy(run), "d long, v long, h long, c long, p long, w int")


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the first eight bytes from each place. Places take four bytes: shards are far smaller."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, 255, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight <<= np.uint64(8)
        eight |= padded[k : k + n]
    order = np.argsort(eight, kind="stable").astype(np.int32)
    key = eight[order]
    rank = np.empty(n + 1, np.int32)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))  # a group has the place of its first
    rank[n] = n  # what follows the end comes last, as the separator does
    del key, padded
    at = np.flatnonzero(~(head & np.concatenate([head[1:], [True]]))).astype(np.int32)
    step = 8
    while len(at):  # places of suffixes that are tied in their first ``step`` bytes
        who = order[at]
        pair = rank[who].astype(np.uint64) << np.uint64(32) | rank[np.minimum(who.astype(np.int64) + step, n)].astype(np.uint64)
        inner = np.argsort(pair, kind="stable")
        who, pair = who[inner], pair[inner]
        order[at] = who
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[who] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        at = at[~(head & np.concatenate([head[1:], [True]]))]
        step *= 2
    return order, eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, starts: np.ndarray, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Kasai in lanes: each suffix's predecessor in the array, and the length of what both begin with, up to ``cap``.

    A lane walks through one context; what its suffix has in common with its predecessor falls by one at most from one place to
    the next, as the array is sorted to the end. Eight bytes are compared at once. Stretches end with their context.
    """
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    remains = (np.repeat(ends, ends - starts) - np.arange(n)).astype(np.int32)
    top = np.where(before >= 0, np.minimum(np.minimum(remains, remains[before]), cap), 0)
    common = np.zeros(n, np.int32)
    size = ends - starts
    lanes = np.argsort(-size, kind="stable")
    have = np.zeros(len(starts), np.int64)  # by lane: may be more than the cap, as it is carried on
    limits = size[lanes]
    for k in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-limits, -k, side="left"))
        i = starts[lanes[:live]] + k
        j, most = before[i], top[i]
        got = np.minimum(np.maximum(have[:live] - 1, 0), most)
        open_ = np.flatnonzero(got < most)
        while len(open_):
            x = eight[i[open_] + got[open_]] ^ eight[j[open_] + got[open_]]
            same = x == 0
            more = np.full(len(open_), 8)
            for b in range(1, 8):
                more -= x >= np.uint64(1 << 8 * b)
            got[open_] += more - ~same
            open_ = open_[same & (got[open_] < most[open_])]
        got = np.minimum(got, most)
        common[i] = got
        have[:live] = got
    return before, common


def repeated(contexts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each context which of its strings start elsewhere in the shard too, and which have no equal one before them in the
    array; also all bytes, and where contexts start."""
    sep = b"\xff"  # in no UTF-8 text
    data = np.frombuffer(sep.join(contexts) + sep, np.uint8)
    lens = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    starts = np.cumsum(lens) - lens
    order, eight = suffix_array(data)
    before, common = common_prefixes(order, eight, starts, starts + lens, length)
    rest = np.repeat(starts + lens - 1, lens) - np.arange(len(data))  # bytes of the context from here
    hit = (common >= length) & (rest >= length)
    found = np.zeros(len(data), bool)
    found[hit] = True
    found[before[hit]] = True
    edge = [(s, s + max(0, n - length)) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]
    return [found[a:b] for a, b in edge], [~hit[a:b] for a, b in edge], data, starts


def spans_of(mask: np.ndarray) -> list[int]:
    """First and last of each run of True, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def search_shards(contexts: DataFrame, length: int) -> DataFrame:
    """Rows (h, c, spans) of repeated strings within shards; of anchors in several shards also sorted runs of digests.

    ``contexts`` has h, sub, parts, c and bytes. A shard's run is cut into as many ranges of digests as its anchor has shards,
    a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            masks, news, data, starts = repeated([r[4] for r in rows], length)
            for (h, _, _, c, _), m in zip(rows, masks, strict=True):
                if m.any():
                    out.append((h, c, spans_of(m), None, None, None))
            groups: dict[tuple[int, int, int], list[int]] = {}
            for k, (h, sub, parts, _, _) in enumerate(rows):
                if parts > 1:
                    groups.setdefault((h, sub, parts), []).append(k)
            if groups:
                one, two = Rolling(data, 0), Rolling(data, 1)
            for (h, sub, parts), who in groups.items():
                place = [np.flatnonzero(news[k]) for k in who]
                found = np.zeros(sum(map(len, place)), RUN)
                at = np.concatenate([starts[k] + x for k, x in zip(who, place, strict=True)])
                found["i"] = np.concatenate(place)
                found["c"] = np.repeat(np.array([rows[k][3] for k in who], np.int64), list(map(len, place)))
                found["d1"], found["d2"] = one.of(at, at + length), two.of(at, at + length)
                found = found[np.argsort(found["d1"], kind="stable")]
                block = (found["d1"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                edge = np.searchsorted(block, np.arange(parts + 1)).tolist()
                out += [(h, None, None, sub, j, found[a:b].tobytes()) for j, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["h", "c", "spans", "sub", "block", "run"])

        only_cache("suffix_dedup", _powers.clear)
        held: list[tuple] = []
        size = 0
        for b in (part for whole in batches for part in slices(whole, 4, SHARD_BYTES)):
            for row in zip(*(b.column(x).to_pylist() for x in ("h", "sub", "parts", "c", "bytes")), strict=True):
                if held and (held[-1][0], held[-1][3]) == (row[0], row[3]):
                    continue  # the context of a repeated row
                if size >= SHARD_BYTES and held and (held[-1][0], held[-1][1]) != (row[0], row[1]):
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield work(held)

    dealt = contexts.repartition(F.col("h"), F.col("sub")).sortWithinPartitions("h", "sub", "c")
    return dealt.select("h", "sub", "parts", "c", "bytes").mapInArrow(tidy(run), "h long, c long, spans array<int>, sub int, block int, run binary")


def merge_shards(runs: DataFrame) -> DataFrame:
    """Rows (h, c, spans) of strings that another shard of their anchor has too: each run is searched in the merged others.

    ``runs`` has h, sub, block and run. A block of an anchor has about as many digests as one of its shards.
    """

    def merged(h: int, held: list[bytes]) -> Iterator[tuple]:
        if len(held) < 2:
            return
        every = np.concatenate([np.frombuffer(x, RUN) for x in held])
        order = np.sort(every["d1"])
        # a digest that n shards hold stands n times in the merged run
        some = every[np.searchsorted(order, every["d1"], side="right") - np.searchsorted(order, every["d1"], side="left") > 1]
        some = some[np.lexsort([some["d2"], some["d1"]])]
        same = (some["d1"][1:] == some["d1"][:-1]) & (some["d2"][1:] == some["d2"][:-1])
        hit = some[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(some) else some
        hit = hit[np.argsort(hit["c"], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], hit["c"][1:] != hit["c"][:-1], [True]])).tolist() if len(hit) else []
        for a, b in zip(edge[:-1], edge[1:], strict=False):
            yield h, int(hit["c"][a]), np.repeat(hit["i"][a:b], 2).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["h", "c", "spans"])

        key, held = None, []
        for b in (part for whole in batches for part in slices(whole, 2, SHARD_BYTES)):
            out: list[tuple] = []
            for h, block, found in zip(*(b.column(x).to_pylist() for x in ("h", "block", "run")), strict=True):
                if (h, block) != key:
                    if key:
                        out += merged(key[0], held)
                    key, held = (h, block), []
                held.append(found)
            yield rows(out)
        if key:
            yield rows(list(merged(key[0], held)))

    dealt = runs.repartition(F.col("h"), F.col("block")).sortWithinPartitions("h", "block", "sub")
    return dealt.select("h", "block", "run").mapInArrow(tidy(run), "h long, c long, spans array<int>")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Rows (d, v, at): the first and last string, flat, of each run of strings that occur twice. ``docs`` has d, v and text."""
    spark = docs.sparkSession
    every = staged(anchors(docs, length, gram), "anchors")
    # counts by anchor are written, so that the join deals both of its sides anew and may split those of a hot anchor
    twice = staged(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors-twice")
    some = staged(every.join(twice, "h", "left_semi"), "repeated-anchors")
    discard(spark, every)
    discard(spark, twice)
    kinds = some.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "v", "p", "w")).alias("one"))
    of_anchor = staged(kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "contexts-by-anchor")
    doubt = kinds.join(of_anchor, "h").select("h", "c", "n", "k", "one.*")
    held = docs.select("d", "v", F.col("text").cast("binary").alias("raw"))
    cut = doubt.join(held, ["d", "v"]).select(
        "h", "c", F.ceil(F.col("k") / shard_contexts).cast("int").alias("parts"), F.expr(f"substring(raw, cast(p + 1 as int), w + {length})").alias("bytes")
    )
    cut = cut.withColumn("sub", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("c"), F.col("parts"))).otherwise(0).cast("int"))
    found = staged(search_shards(cut, length), "shard-results")
    across = merge_shards(found.where("run is not null"))
    inside = found.where("spans is not null").select("h", "c", "spans")
    partly = inside.unionByName(across).groupBy("h", "c").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    fully = kinds.where("n > 1").select("h", "c", F.lit(True).alias("all"))
    known = fully.join(partly, ["h", "c"], "full").select("h", "c", F.coalesce("all", F.lit(False)).alias("all"), "spans")
    hits = some.join(known, ["h", "c"]).select(
        "d", "v", F.when(F.col("all"), F.array(F.col("p"), F.col("p") + F.col("w"))).otherwise(F.transform("spans", lambda s: s + F.col("p"))).alias("at"),
    )
    return hits


def remove(docs: DataFrame, hits: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """kept (binary), n_bytes, n_removed, n_spans and spans (first byte and end of each removed run, flat) instead of d, v and text.

    With ``whole_characters`` a run that begins or ends within a character leaves that character in place.
    """
    at = hits.groupBy("d", "v").agg(F.flatten(F.collect_set("at")).alias("at"))  # rows that repeat a document add nothing
    carried = [f for f in docs.schema if f.name not in ("d", "v", "text")]
    names = [f.name for f in carried]
    both = docs.join(at, ["d", "v"], "left").select(F.col("text").cast("binary").alias("raw"), "at", *names)

    def inner(raw: bytes, a: int, z: int) -> list[int]:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        return [a, z] if a < z else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                kept, n, gone, spans = [], [], [], []
                for raw, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    cuts: list[int] = []
                    if at:
                        x = np.array(at, np.int64).reshape(-1, 2)
                        x = x[np.argsort(x[:, 0], kind="stable")]
                        end = np.maximum.accumulate(x[:, 1] + length)
                        first = np.flatnonzero(np.concatenate([[True], x[1:, 0] > end[:-1]]))
                        lo, hi = x[first, 0], end[np.concatenate([first[1:], [len(x)]]) - 1]
                        cuts = np.stack([lo, hi], 1).ravel().tolist()
                        if whole_characters:
                            cuts = [y for a, z in zip(cuts[::2], cuts[1::2], strict=True) for y in inner(raw, a, z)]
                    edge = [0, *cuts, len(raw)]
                    kept.append(b"".join(raw[a:z] for a, z in zip(edge[::2], edge[1::2], strict=True)) if cuts else raw)
                    n.append(len(raw))
                    gone.append(len(raw) - len(kept[-1]))
                    spans.append(cuts)
                made = [pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[2:], *made], names=schema.names)

    schema = T.StructType([*carried, *T._parse_datatype_string("kept binary, n_bytes long, n_removed long, n_spans long, spans array<bigint>")])
    return both.mapInArrow(tidy(run), schema)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_contexts: int = SHARD_CONTEXTS, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """One row a document: ``id_col``, the columns to ``carry``, kept, n_bytes, n_removed, n_spans, spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("d"), F.xxhash64(text).alias("v"), text.alias("text"), F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in carry])
    hits = repeated_runs(docs.select("d", "v", "text"), length, min(gram, length), shard_contexts)
    out = remove(docs, hits, length, whole_characters)
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__{c}").alias(c) for c in carry], "kept", "n_bytes", "n_removed", "n_spans", "spans")
