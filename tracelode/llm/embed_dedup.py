"""Embedding near-duplicates by sorted projection passes.

In each pass a vector gets the signs of its products with random directions, concatenated, and all vectors are range-sorted
lexicographically by label and these hashes. Every vector is compared in double precision with a bounded window of neighbours
in that order, whatever their hashes, and with all that share its hashes: these make a run, and how many hashes lead depends on
the size of the label alone. Equal vectors of a label are one row with a count. A run of more than ``block`` vectors is cut into
blocks and every pair of blocks is compared, so that windows are bounded and no neighbour is left out.

A pair within a run is counted in the first pass whose run holds it, which both vectors' hashes tell without any table of
pairs; links come out as counts a vector and as a spanning forest a window. A pair that no pass has in a run is found as
neighbours only: it comes out as itself, once a pass that finds it, and is counted once. Passes are added until a pair at the
threshold is in no run with probability ``MISS`` at most; nearer pairs are missed less often still. Neighbours on both sides of
a partition's border are left to the other passes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and labels of one vector
link with nothing; vectors of another length than their neighbours link only with those of their length; a repeated id counts
once a row, its rows never link with each other, equal rows are one whose links count once, and its row count is that of the
input; a null id has no component; an empty table gives an empty one; equal vectors are known by a hash of 128 bits; columns
other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, tidy
from .components import blocked, components, forest

THRESHOLD = 0.98
BLOCK = 1024
#: Vectors that a run should hold when hashes spread them evenly.
WINDOW = 24
#: Probability that a pair just at the threshold is in no run.
MISS = 1e-6
SEED = 42
#: Rows that are compared at once where runs are short, and neighbours before them that each may meet too.
TILE = 128
NEIGHBOURS = 16


def schedule(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Leading hashes that make a run, and passes, for a label of so many vectors; the passes follow from the hashes."""
    bits = max(2, min(30, round(math.log2(max(2, vectors / WINDOW)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def directions(dim: int, bits: int, passes: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * passes))


def stored(df: DataFrame, vec_col: str) -> str:
    """Single precision stays so until it is computed with, which halves what is moved; all else is double."""
    return "f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; the largest component is taken out first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def distinct(df: DataFrame, id_col: str, vec_col: str, label_col: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that can link by id, label and a hash of 128 bits of their vector; the classes of equal vectors; one vector a class.

    A class (row, id, label, h1, h2) stands for all ids that have its vector and no other, by the least of them, ``row`` being their rows in all. An id with
    several vectors is in no class with others: its rows link with other ids alone, so each of its vectors stays for itself.
    """
    usable = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    v = F.col(vec_col).cast("array<float>" if kind == "f4" else "array<double>")
    keyed = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).select("id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    members = staged(keyed.groupBy("id", "label", "h1", "h2").agg(F.count("*").alias("times")), "members")
    several = staged(members.groupBy("id").agg(F.count("*").alias("k")).where("k > 1"), "several-vectors")
    lone = members.join(several.select("id"), "id", "left_anti")
    classes = lone.groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.sum("times").alias("row"))
    apart = members.join(several.select("id"), "id", "left_semi").select("label", "h1", "h2", "id", F.col("times").alias("row"))
    classes = staged(classes.unionByName(apart), "classes")
    # vectors move once, and only those of their classes' least ids
    vectors = keyed.join(classes, ["id", "label", "h1", "h2"]).groupBy("id", "label", "h1", "h2", "row").agg(F.first("v").alias("v"))
    return lone, classes, vectors


def hashed(src: DataFrame, classes: DataFrame, kind: str, threshold: float, miss: float, seed: int = SEED) -> DataFrame:
    """Rows (row, id, label, dim, vec, codes) of the vectors that can link: their components as given, and a hash a pass.

    Hashes and passes follow the size of a vector's own label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 4000):
                b = whole.slice(k, 4000)
                by: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
                plans = [schedule(n, threshold, miss) for n in b.column(4).to_pylist()]
                for i, v in enumerate(b.column(3)):
                    if v.is_valid and len(v) and not v.values.null_count:
                        x = v.values.to_numpy(zero_copy_only=False)
                        if np.isfinite(x).all() and x.any():
                            by.setdefault((len(x), *plans[i]), []).append((i, x))
                for (dim, bits, passes), got in by.items():
                    if (dim, bits) not in known:
                        known[dim, bits] = directions(dim, bits, passes, seed)
                    weights = (1 << np.arange(bits)[::-1]).astype(np.int64)
                    raw = np.array([v for _, v in got], kind)
                    x = unit(raw.astype(np.float64))
                    codes = ((x @ known[dim, bits] > 0).reshape(len(x), passes, bits) * weights).sum(axis=2).astype(np.int32)
                    at = pa.array([i for i, _ in got])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * passes), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.full(len(x), dim, np.int32)), pa.array([v.tobytes() for v in raw], pa.binary()), flat], names=["row", "id", "label", "dim", "vec", "codes"])

    sizes = staged(classes.groupBy("label").agg(F.count("*").alias("n")), "label-sizes")  # so that the join may split a large label
    return src.join(sizes, "label").select("row", "id", "label", "v", "n").mapInArrow(tidy(run), "row long, id long, label string, dim int, vec binary, codes array<int>")


def compare(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Of a pass's runs: (a, null, links of a found here) and (a, b, 0) for the links of a spanning forest.

    Of neighbours that share no hashes in any pass: (a, b, n, m, ka, kb), a pair that gives n links to a and m to b; ka and kb
    tell rows of one id apart.
    """
    keys = ["label", "dim", "pass", "code", "bi", "bj"]
    names = ["a", "b", "n", "m", "ka", "kb"]

    class Rows:
        """Consecutive rows of one dimension: units, codes (-1 beyond a label's last pass), runs and their label and pass."""

        def __init__(self, t: pa.Table, run: np.ndarray, order: np.ndarray):
            self.run, self.order = run, order
            self.ids, self.times = t.column("id").to_numpy(), t.column("row").to_numpy()
            self.side, self.pass_ = t.column("side").to_numpy(), t.column("pass").to_numpy()
            self.cross = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            self.vec = t.column("vec").to_pylist()
            self.x = unit(np.frombuffer(b"".join(self.vec), kind).reshape(len(run), -1).astype(np.float64))
            codes = t.column("codes").combine_chunks()
            sizes = codes.value_lengths().to_numpy(zero_copy_only=False)
            self.codes = np.full((len(run), int(sizes.max())), -1, np.int32)
            self.codes[np.arange(self.codes.shape[1]) < sizes[:, None]] = codes.flatten().to_numpy()

        def key(self, i: int) -> int:
            return int.from_bytes(hashlib.blake2b(self.vec[i], digest_size=8).digest(), "little", signed=True)

    def hits(r: Rows, a: np.ndarray, c: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs among rows a and c that count here: of one run for the first time, or (third: False) of none in any pass."""
        left, right, same = [], [], []
        for k in range(0, len(a), 256):
            part = a[k : k + 256]
            i, j = np.nonzero((r.x[part] @ r.x[c].T >= threshold) & (r.order[part][:, None] == r.order[c]))
            i, j = part[i], c[j]
            keep = (r.ids[i] != r.ids[j]) & (both | (i < j))
            i, j = i[keep], j[keep]
            equal = (r.codes[i] == r.codes[j]) & (r.codes[i] >= 0)
            known, inside = equal.any(axis=1), r.run[i] == r.run[j]
            keep = np.where(inside, equal.argmax(axis=1) == r.pass_[i], ~known)
            left.append(i[keep])
            right.append(j[keep])
            same.append(inside[keep])
        return tuple(map(np.concatenate, (left, right, same)))

    def tile(r: Rows, old: int, out: list[list]) -> None:
        """Compare all rows of a tile, the first ``old`` of which were in the tile before and have met each other."""
        everything = np.arange(len(r.run))
        if r.cross[-1]:  # a tile of its own: two blocks of a long run, each of which meets itself elsewhere
            if (r.side == r.side[0]).all():
                return
            i, j, same = hits(r, everything[r.side == 0], everything[r.side == 1], True)
        else:
            i, j, same = hits(r, everything, everything[old:], False)
        for p, q in zip(i[~same].tolist(), j[~same].tolist(), strict=True):
            if r.ids[p] > r.ids[q]:
                p, q = q, p
            for column, value in zip(out, (int(r.ids[p]), int(r.ids[q]), int(r.times[q]), int(r.times[p]), r.key(p), r.key(q)), strict=True):
                column.append(value)
        i, j = i[same], j[same]
        if not len(i):
            return
        counts = np.zeros(len(r.run), np.int64)
        np.add.at(counts, i, r.times[j])
        np.add.at(counts, j, r.times[i])
        linked, places = np.unique(np.concatenate([i, j]), return_inverse=True)
        near = np.zeros((len(linked), len(linked)), bool)
        i, j = places[: len(i)], places[len(i) :]
        near[i, j] = near[j, i] = True
        ids = r.ids[linked].tolist()
        tree = forest(len(linked), lambda p, rest: near[p, rest])
        new = [*ids, *(ids[p] for p, _ in tree)], [*([None] * len(ids)), *(ids[q] for _, q in tree)], [*counts[linked].tolist(), *([0] * len(tree))]
        for column, values in zip(out, (*new, *([[None] * len(new[0])] * 3)), strict=True):
            column += values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seen = 0  # rows at the start of ``held`` that have been compared with all before them

        def changes(t: pa.Table, columns: list[str]) -> np.ndarray:
            cut = np.ones(t.num_rows, bool)
            cut[1:] = False
            for name in columns:
                col = t.column(name).to_numpy(zero_copy_only=False)
                cut[1:] |= col[1:] != col[:-1]
            return cut

        def work(t: pa.Table, done: int, last: bool) -> tuple[pa.RecordBatch, pa.Table, int]:
            """Compare all tiles of whole runs; what is left are the last neighbours and the run that may go on."""
            fresh, group = changes(t, keys), changes(t, ["label", "dim", "pass"])
            lone, dims = t.column("bi").to_numpy() != t.column("bj").to_numpy(), t.column("dim").to_numpy()
            runs, order = np.cumsum(fresh), np.cumsum(group)
            starts = np.flatnonzero(fresh)
            end = t.num_rows if last else int(starts[-1])
            out: list[list] = [[] for _ in names]
            starts = starts[(starts >= done) & (starts < end)]
            slot = (starts - done) // TILE
            first = np.ones(len(starts), bool)
            before = starts - 1
            first[1:] = (slot[1:] != slot[:-1]) | lone[starts[1:]] | lone[before[1:]] | (dims[starts[1:]] != dims[before[1:]])
            edges = [*starts[first].tolist(), end]
            for at, upto in zip(edges, edges[1:], strict=False):
                back = at if lone[at] else max(0, at - NEIGHBOURS)
                while back < at and (order[back] != order[at] or lone[back]):
                    back += 1
                if upto - back > 1:
                    tile(Rows(t.slice(back, upto - back), runs[back:upto], order[back:upto]), at - back, out)
            back = max(0, end - NEIGHBOURS)
            kinds = [pa.int64()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names), t.slice(back), end - back

        for b in batches:
            for k in range(0, b.num_rows, 4000):
                t = pa.Table.from_batches([b.slice(k, 4000)])
                held = t if held is None else pa.concat_tables([held, t])
                if held.num_rows > 4000:
                    found, held, seen = work(held.combine_chunks(), seen, False)
                    yield found
        if held is not None and held.num_rows:
            yield work(held.combine_chunks(), seen, True)[0]

    dealt = rows.select(*keys, "side", "row", "id", "vec", "codes").repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per row of ``df``: its id, n_links, component_id and kept."""
    small, kind = df.select(F.col(id_col).cast("long").alias(id_col), vec_col, label_col), stored(df, vec_col)
    lone, classes, src = distinct(small, id_col, vec_col, label_col, kind)
    vectors = staged(hashed(src, classes, kind, threshold, miss, seed), "vectors")
    entries = vectors.select("label", "dim", F.posexplode("codes").alias("pass", "code"), "row", "id", "vec", "codes")
    found = staged(compare(blocked(entries, ["label", "dim", "pass", "code"], "id", block, least=1), threshold, kind), "vector-links")
    pairs = found.where("ka is not null").distinct()
    ends = found.where("b is null").select("a", "n").unionAll(pairs.select("a", "n")).unionAll(pairs.select("b", "m"))
    links = staged(ends.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links")), "class-links")
    # what a class has found goes for each of its ids, which link with each other besides
    several = classes.withColumnRenamed("id", "lead").join(vectors.select(F.col("id").alias("lead"), "label").distinct(), ["lead", "label"])
    copies = staged(lone.join(several, ["label", "h1", "h2"]).where("row > times").select("id", "lead", (F.col("row") - F.col("times")).alias("more")), "copies")
    beside = copies.where("id <> lead").join(links.withColumnRenamed("node", "lead"), "lead").select(F.col("id").alias("node"), "n_links")
    links = links.unionByName(copies.select(F.col("id").alias("node"), F.col("more").alias("n_links"))).unionByName(beside).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    comp = components(found.where("b is not null").select("a", "b").unionByName(copies.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))), "vector-components")
    discard(df.sparkSession, vectors)
    out = small.select(F.col(id_col).alias("node")).join(links, "node", "left").join(comp, "node", "left")
    return out.select(
        F.col("node").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
        F.coalesce(F.coalesce("component", "node") == F.col("node"), F.lit(True)).alias("kept"),
    )
