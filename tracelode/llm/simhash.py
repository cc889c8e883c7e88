"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two that differ in at most ``bits`` bits differ in at most r of some segment
(pigeonhole, with r one less for the later segments), so each fingerprint is put into one table a segment and looks up the
small Hamming ball around its own segment there. Of the two directions of a look-up only one is made: a flip is tried where its
highest bit is 0. Matches are verified on the whole fingerprint. Equal fingerprints are one row throughout.

Candidates of one table slot are compared in blocks, and a block gives a spanning forest of its links, never all of its pairs.

Defined cases: texts without a word (null, empty, white space) have fingerprint zero and are linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows have equal fingerprints; a null id is never a component's least id
unless nothing else is in it, and its row keeps its place; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, only_cache, staged, tidy
from .components import blocked, components, forest

BITS = 4
WORDS = 4
SEED = 42
#: Rows of one table slot that are compared with each other at once.
BLOCK = 1024
#: Owners of a slot up to which their links are all written.
FEW = 16
#: Distinct fingerprints up to which three segments keep the slots of a table sparse; beyond it there are two.
THREE_SEGMENTS = 1 << 27

_space = re.compile(r"[\x20\x09-\x0D]+")
_upper = {c: c + 32 for c in range(65, 91)}
#: The bits of a byte (lowest first) as eight bytes, each 0 or 1.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority of each bit over each ``counts`` (1 or more) hashes."""
    # bits are counted in bytes, over up to 255 hashes, and those counts are added up
    parts = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), parts)
    starts = np.cumsum(counts) - counts
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = starts[owner] + 255 * within
    small = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], at, axis=0).view(np.uint8).reshape(len(at), 64)
    sums = np.add.reduceat(small.astype(np.int64), np.cumsum(parts) - parts, axis=0)
    return np.packbits((2 * sums > counts[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def spread(h: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def fingerprints(texts: list[str], size: int = WORDS, seed: int = SEED, wide: bool = False) -> np.ndarray:
    """The majority of each bit over the hashes of a text's shingles; if ``wide``, a second row holds 64 further bits."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        ws = [w for w in _space.split(t.translate(_upper) if not t.isascii() else t.lower()) if w]
        if not ws:
            continue
        if len(ws) <= size:
            hashes.append(digest(" ".join(ws).encode("utf-8", "surrogatepass"), seed))
            counts[k] = 1
            continue
        raw = [w.encode("utf-8", "surrogatepass") for w in ws]
        whole = memoryview(b" ".join(raw))
        ends = np.cumsum([len(w) + 1 for w in raw])
        begin = [0, *ends[: len(ws) - size].tolist()]
        stop = (ends[size - 1 :] - 1).tolist()
        hashes += [digest(whole[a:b], seed) for a, b in zip(begin, stop, strict=True)]
        counts[k] = len(begin)
    out = np.zeros((1 + wide, len(texts)), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        h = np.array(hashes, np.uint64)
        out[0, some] = majority(h, counts[some])
        if wide:
            out[1, some] = majority(spread(h), counts[some])
    return out if wide else out[0]


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "simhash", size: int = WORDS, seed: int = SEED, wide: bool = False) -> DataFrame:
    """Add ``out_col``, the 64 bits as a (signed) long; if ``wide``, also ``out_col``_more, 64 further bits."""

    def make():
        only_cache("simhash")

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            return [pa.array(x) for x in np.atleast_2d(fingerprints(texts, size, seed, wide)).view(np.int64)]

        return run

    return map_texts(df, text_col, [field(out_col, "long"), *[field(f"{out_col}_more", "long")] * wide], make)


def plan(segments: int, bits: int) -> list[tuple[int, int, int]]:
    """Shift, width and radius of each segment; radius -1 leaves a segment out."""
    edges = [64 * i // segments for i in range(segments + 1)]
    r, extra = divmod(bits, segments)
    return [(a, b - a, r if i <= extra else r - 1) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def probes(prints: DataFrame, segments: int, bits: int) -> DataFrame:
    """Rows (seg, slot, probe, fp, more, node): each fingerprint's own slot, and those that it looks up."""
    steps = [(s, shift, width, radius) for s, (shift, width, radius) in enumerate(plan(segments, bits)) if radius >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4000):
                b = whole.slice(k, 4000)
                fp = b.column(0).to_numpy().view(np.uint64)
                seg, slot, probe, row = [], [], [], []
                for s, shift, width, radius in steps:
                    own = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    for n in range(radius + 1):
                        for flip in combinations(range(width), n):
                            at = np.flatnonzero((own >> flip[-1]) & 1 == 0) if flip else np.arange(len(own))
                            mask = sum(1 << f for f in flip)
                            seg.append(np.full(len(at), s, np.int8))
                            slot.append(own[at] ^ mask)
                            probe.append(np.full(len(at), n > 0))
                            row.append(at)
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seg)), pa.array(np.concatenate(slot)), pa.array(np.concatenate(probe)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], names=["seg", "slot", "probe", "fp", "more", "node"])

    return prints.select("fp", "more", "node").mapInArrow(tidy(run), "seg byte, slot long, probe boolean, fp long, more long, node long")


def verify(rows: DataFrame, bits: int, more_bits: int = 64) -> DataFrame:
    """Links (a, b) within each block pair that connect all fingerprints of it that are linked.

    A slot with few owners gives each owner's links to the rows that look it up; any other gives a spanning forest.
    """

    def near(fp: np.ndarray, more: np.ndarray, i, j: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        return hit & (np.bitwise_count(more[i] ^ more[j]) <= more_bits) if more_bits < 64 else hit

    def forested(fp: np.ndarray, more: np.ndarray, node: np.ndarray, side: np.ndarray, cross: bool) -> list[tuple[int, int]]:
        found = forest(len(fp), lambda i, rest: near(fp, more, i, rest) & ((side[rest] != side[i]) | (not cross)))
        return [(int(node[i]), int(node[j])) for i, j in found]

    def owned(fp: np.ndarray, more: np.ndarray, node: np.ndarray, owner: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """``owner``: rows that own their slot, whose group begins at ``start`` and has ``n`` rows."""
        out: list[tuple[int, int]] = []
        ends = np.cumsum(n)
        at = 0
        while at < len(owner):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), side="right")))
            size = n[at:upto]
            i = np.repeat(owner[at:upto], size)
            j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at:upto], size)
            hit = near(fp, more, i, j) & (node[i] != node[j])
            out += list(zip(node[i[hit]].tolist(), node[j[hit]].tolist(), strict=True))
            at = upto
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            keys = [t.column(c).to_numpy() for c in ("seg", "slot", "bi", "bj")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            start = np.concatenate([[0], new])
            end = np.concatenate([new, [t.num_rows]])
            rest = None
            if not last:
                rest = t.slice(int(start[-1]))
                start, end = start[:-1], end[:-1]
            if not len(start):
                return None, rest
            fp, more, node, side = (t.column(c).to_numpy() for c in ("fp", "more", "node", "side"))
            own = ~t.column("probe").to_numpy(zero_copy_only=False)
            fp, more = fp.view(np.uint64), more.view(np.uint64)
            n = end - start
            owners = np.diff(np.concatenate([[0], np.cumsum(own.astype(np.int64))])[np.concatenate([start, end[-1:]])])
            few = (owners <= FEW) & (keys[2][start] == keys[3][start])
            group = np.repeat(np.arange(len(start)), n)
            who = np.flatnonzero(own[: end[-1]] & few[group])
            pairs = owned(fp, more, node, who, start[group[who]], n[group[who]])
            for a, b in zip(start[~few].tolist(), end[~few].tolist(), strict=True):
                pairs += forested(fp[a:b], more[a:b], node[a:b], side[a:b], keys[2][a] != keys[3][a])
            pairs = [(a, b) for a, b in pairs if a != b]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"]), rest

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 20_000:
                out, held = work(held.combine_chunks(), False)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out, _ = work(held.combine_chunks(), True)
            if out is not None:
                yield out

    keys = ["seg", "slot", "bi", "bj"]
    dealt = rows.select(*keys, "probe", "fp", "more", "node", "side").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_links(prints: DataFrame, bits: int = BITS, segments: int | None = None, block: int = BLOCK, more_bits: int = 64) -> DataFrame:
    """Links among distinct fingerprints (fp, more, node) that connect all that differ in at most ``bits`` bits of fp and
    ``more_bits`` of more."""
    if segments is None:
        segments = 3 if prints.count() <= THREE_SEGMENTS else 2
    found = probes(prints, segments, bits)
    return verify(blocked(found, ["seg", "slot"], "fp", block, F.count_if(~F.col("probe")) > 0), bits, more_bits).distinct()


def group(df: DataFrame, id_col: str = "doc_id", fp_col: str = "simhash", bits: int = BITS, segments: int | None = None, block: int = BLOCK, more_bits: int = 64) -> DataFrame:
    """Add component_id: the least id that is reachable over links of at most ``bits`` differing bits (and of at most
    ``more_bits`` in ``fp_col``_more, where that is less than 64)."""
    more = f"{fp_col}_more"
    parts = [fp_col, more] if more_bits < 64 else [fp_col]
    least = df.where(F.col(id_col).isNotNull()).groupBy(*parts).agg(F.min(id_col).cast("long").alias("node"))
    prints = staged(least.select(F.col(fp_col).alias("fp"), (F.col(more) if more_bits < 64 else F.lit(0).cast("long")).alias("more"), "node"), "fingerprints")
    comp = components(near_links(prints, bits, segments, block, more_bits), "simhash-links")
    lead = prints.join(comp, "node", "left").select(F.col("fp").alias(fp_col), *([F.col("more").alias(more)] if more_bits < 64 else []), F.coalesce("component", "node").alias("component_id"))
    out = df.drop("component_id").join(lead, parts, "left")
    return out.select(*[c for c in df.columns if c.lower() != "component_id"], "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, bits: int = BITS, seed: int = SEED, segments: int | None = None, more_bits: int = 64) -> DataFrame:
    """Id, simhash (long) and component_id of each document; texts are hashed once and staged as fingerprints."""
    wide = more_bits < 64
    small = df.select(F.col(id_col), F.col(text_col))
    made = staged(with_fingerprint(small, text_col, "simhash", size, seed, wide).drop(text_col), "simhash")
    return group(made, id_col, "simhash", bits, segments, more_bits=more_bits)


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
