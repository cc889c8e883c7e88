"""Whitening of embeddings by matrix-free block Lanczos.

Vectors become whole numbers, ``floor(256 c)``, and each distinct one is fitted once. The covariance V of this fit list is never
formed: a pass over it multiplies the centred rows with a block of some columns and their transpose with the products, in
partial sums a task that Spark adds up, and only dim x block numbers reach the driver. Each new block is made orthogonal to all
before it, twice; columns that vanish there (a breakdown) are restarted with random directions orthogonal to the basis. The
Ritz pairs of the basis have their residuals from what the passes have returned; once those of the leading components are at
rounding level, or the basis spans the space, one more pass over the Ritz vectors measures eigenvalues and residuals anew, and
Lanczos starts again from these vectors where they do not hold. The trace comes from the deviations, which are exact.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; vectors of each length have a fit of their
own; vectors of no entries, and components whose variance is not above rounding level (all of a single distinct vector), have
no rows; there are as many components as the space has, up to ``COMPONENTS``; equal rows are fitted once and each has its rows
in the result; a null id is kept; the sign of a component makes its largest entry positive; a deviation beyond 38 digits is null;
an empty table gives an empty one; columns other than id and vector are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, tidy

COMPONENTS = 4
SCALE = 256
#: Columns of a block: as many equal eigenvalues are told apart at once.
BLOCK = 8
#: Rows that a task handles at once.
ROWS = 4096
#: Residual of a Ritz pair, relative to the largest eigenvalue, that counts as converged; and one below which it does so once
#: it does not fall any more.
RESIDUAL, ROUNDING = 1e-13, 1e-11
RESTARTS = 5
SEED = 42
WIDTHS = ((1, "<i1"), (2, "<i2"), (4, "<i4"), (8, "<i8"))


@dataclass
class Fit:
    """Of vectors of one length: distinct vectors, exact sums, components (columns), eigenvalues and the trace of V."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """floor(256 c) as int64; what is beyond its range is held at its ends."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    big, low = x >= 2.0**63, x <= -(2.0**63)
    out = np.where(big | low, 0.0, x).astype(np.int64)
    out[big], out[low] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it; equal vectors are packed alike."""
    out: list[bytes] = [b""] * len(x)
    low, high, left = x.min(axis=1), x.max(axis=1), np.ones(len(x), bool)
    for size, kind in WIDTHS:
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        head, raw, step = struct.pack("<BI", size, x.shape[1]), x[fits].astype(kind).tobytes(), size * x.shape[1]
        for k, i in enumerate(np.flatnonzero(fits).tolist()):
            out[i] = head + raw[k * step : (k + 1) * step]
        left &= ~fits
    return out


def unpacked(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows, as int64, of packed vectors of the same length and width."""
    heads = [r[:5] for r in raw]
    for head in dict.fromkeys(heads):
        size, dim = struct.unpack("<BI", head)
        at = [i for i, h in enumerate(heads) if h == head]
        yield np.array(at), np.frombuffer(b"".join([raw[i][5:] for i in at]), dict(WIDTHS)[size]).reshape(len(at), dim).astype(np.int64)


def numbered(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, x): the usable vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                col = b.column(1)
                sizes = np.where(col.is_valid().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
                flat, known = col.flatten(), np.concatenate([[0], np.cumsum(col.flatten().is_null().to_numpy(zero_copy_only=False))])
                values, ends = flat.to_numpy(zero_copy_only=False), np.cumsum(sizes)
                whole_rows = (sizes > 0) & (known[ends] == known[ends - sizes])
                for dim in np.unique(sizes[whole_rows]).tolist():
                    at = np.flatnonzero(whole_rows & (sizes == dim))
                    x = values[(ends[at] - dim)[:, None] + np.arange(dim)].astype(np.float64)
                    good = np.isfinite(x).all(axis=1)
                    at, x = at[good], x[good]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(packed(whole_numbers(x)) if len(at) else [], pa.binary())], names=["id", "dim", "x"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return src.mapInArrow(tidy(run), "id long, dim int, x binary")


def sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vectors and exact sums of each length: a row an entry of a length comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                for _, x in unpacked(whole.slice(k, ROWS).column(0).to_pylist()):
                    n, s = held.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                    exact = x.sum(axis=0) if np.abs(x.astype(np.float64)).max() < 2.0**50 else x.astype(object).sum(axis=0)
                    held[x.shape[1]] = (n + len(x), s + exact.astype(object))
        rows = [(dim, i, n, Decimal(int(v))) for dim, (n, s) in held.items() for i, v in enumerate(s)]
        dims, places, counts, values = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(places, pa.int32()), pa.array(counts, pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["dim", "place", "n", "s"])

    parts = fit_list.select("x").mapInArrow(tidy(run), "dim int, place int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "place").collect():
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def passes(fit_list: DataFrame, means: dict[int, np.ndarray]):
    """A function that multiplies the covariance of each length with a block: one pass for all lengths that it is given."""

    def multiply(blocks: dict[int, np.ndarray], counts: dict[int, int]) -> dict[int, np.ndarray]:
        width = max(b.shape[1] for b in blocks.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    for _, x in unpacked(whole.slice(k, ROWS).column(0).to_pylist()):
                        dim = x.shape[1]
                        if dim in blocks:
                            c = x - means[dim]
                            held[dim] = held.get(dim, 0.0) + c.T @ (c @ blocks[dim])
            for dim, y in held.items():
                wide = np.zeros((dim, width))
                wide[:, : y.shape[1]] = y
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), *[pa.array(wide[:, j]) for j in range(width)]], names=["dim", "place", *[f"y{j}" for j in range(width)]]
                )

        parts = fit_list.select("x").mapInArrow(tidy(run), "dim int, place int, " + ", ".join(f"y{j} double" for j in range(width)))
        rows = parts.groupBy("dim", "place").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).collect()
        out = {dim: np.zeros(b.shape) for dim, b in blocks.items()}
        for r in rows:
            out[r["dim"]][r["place"]] = r[2 : 2 + blocks[r["dim"]].shape[1]]
        return {dim: y / counts[dim] for dim, y in out.items()}

    return multiply


class Lanczos:
    """The basis of one length and the blocks that are to be multiplied next. It holds dim x dim numbers at most."""

    def __init__(self, dim: int, wanted: int, block: int = BLOCK, seed: int = SEED):
        self.dim, self.wanted, self.block = dim, min(wanted, dim), min(block, dim)
        self.rng = np.random.default_rng([seed, dim])
        self.restarts, self.done = 0, False
        self._begin(np.zeros((dim, 0)))

    def _begin(self, first: np.ndarray) -> None:
        self.q, self.aq = np.zeros((self.dim, 0)), np.zeros((self.dim, 0))
        self.next, self.checking, self.last = self._fresh(first, self.block), False, np.inf

    def _fresh(self, candidates: np.ndarray, columns: int) -> np.ndarray:
        """Unit columns orthogonal to the basis and to each other, from candidates and, where these break down, at random."""
        room = min(columns, self.dim - self.q.shape[1])
        out = np.zeros((self.dim, 0))
        queue = list(candidates.T)
        while out.shape[1] < room:
            v = queue.pop(0) if queue else self.rng.standard_normal(self.dim)
            size = np.linalg.norm(v)
            for _ in range(3):  # full reorthogonalisation, more than once
                v = v - self.q @ (self.q.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size and left > 0:
                out = np.column_stack([out, v / left])
        return out

    def take(self, product: np.ndarray) -> None:
        """The covariance times ``next``: go on, check the Ritz vectors, or end."""
        if self.checking:
            return self._check(product)
        self.q, self.aq = np.column_stack([self.q, self.next]), np.column_stack([self.aq, product])
        t = self.q.T @ self.aq
        theta, s = np.linalg.eigh((t + t.T) / 2)
        theta, s = theta[::-1][: self.wanted], s[:, ::-1][:, : self.wanted]
        ritz = self.q @ s
        residual = np.linalg.norm(self.aq @ s - ritz * theta, axis=0).max()
        level = max(theta[0], 0.0)
        converged = residual <= RESIDUAL * level or self.last / 2 < residual <= ROUNDING * level
        self.last = residual
        if self.q.shape[1] == self.dim or (self.q.shape[1] >= 2 * self.block and converged):
            self.next, self.checking = np.linalg.qr(ritz)[0], True
        else:
            self.next = self._fresh(product - self.q @ (self.q.T @ product), self.block)

    def _check(self, product: np.ndarray) -> None:
        t = self.next.T @ product
        theta, s = np.linalg.eigh((t + t.T) / 2)
        self.values, self.vectors = theta[::-1], (self.next @ s)[:, ::-1]
        residual = np.linalg.norm((product @ s)[:, ::-1] - self.vectors * self.values, axis=0).max()
        if residual <= ROUNDING * max(self.values[0], 0.0) or self.restarts == RESTARTS or self.dim <= self.block:
            self.done = True
        else:
            self.restarts += 1
            self._begin(self.vectors)


def deviations(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """Exact sums of (n x - S)^2 over the entries of each row: as int64 where all that is computed fits, else as Python's numbers."""
    reach = n * (int(np.abs(x.astype(np.float64)).max()) + 1) + max(map(abs, totals)) if x.size else 0
    if x.shape[1] * reach * reach < 2**62:
        return ((n * x - np.array(totals, np.int64)) ** 2).sum(axis=1)
    return ((n * x.astype(object) - np.array(totals, object)) ** 2).sum(axis=1)


def projected(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(id, dim, deviation, w): a number a component. Components are dim x 4 numbers a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {dim: (f.mean, f.vectors / np.sqrt(f.values)) for dim, f in fits.items()}
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                for at, x in unpacked(b.column(1).to_pylist()):
                    dim = x.shape[1]
                    mean, onto = ready[dim]
                    far = deviations(x, fits[dim].n, fits[dim].sums)
                    far = pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype == np.int64 else pa.array([Decimal(int(v)) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
                    w = (x - mean) @ onto
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * onto.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(x), dim, np.int32)), far, lists], names=["id", "dim", "deviation", "w"])

    return rows.select("id", "x").mapInArrow(tidy(run), "id long, dim int, deviation decimal(38,0), w array<double>")


def fit(fit_list: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> dict[int, Fit]:
    """Fit each length of the distinct vectors (x): the loop is over passes, its state dim x dim numbers at most."""
    totals = sums(fit_list)
    fits = {dim: Fit(n, s, np.zeros((dim, 0)), np.zeros(0)) for dim, (n, s) in totals.items()}
    if not fits:
        return fits
    multiply = passes(fit_list, {dim: f.mean for dim, f in fits.items()})
    states = {dim: Lanczos(dim, components, block) for dim, f in fits.items() if f.n > 1}
    while open_ := {dim: s for dim, s in states.items() if not s.done}:
        for dim, product in multiply({dim: s.next for dim, s in open_.items()}, {dim: f.n for dim, f in fits.items()}).items():
            states[dim].take(product)
    for dim, s in states.items():
        real = s.values > max(1e-12 * dim * max(s.values[0], 0.0), 0.0)
        vectors = s.vectors[:, real]
        top = np.abs(vectors).argmax(axis=0)
        fits[dim].vectors, fits[dim].values = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])]), s.values[real]
    seen = projected(fit_list.withColumn("id", F.lit(0).cast("long")), fits)
    w = [F.get("w", F.lit(i)) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    # covar_pop centres before it multiplies, and merges what tasks have found
    rows = seen.groupBy("dim").agg(F.sum(F.col("deviation").cast("double")).alias("far"), *[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    for r in rows:
        f = fits[r["dim"]]
        f.trace = r["far"] / f.n**3 if r["far"] is not None else 0.0
        f.identity_error = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(f.values)), default=0.0)
    return fits


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Per usable row and component: id, component, n, deviation (decimal), whitened, explained and identity_error."""
    rows = numbered(df, id_col, vec_col)
    fit_list = staged(rows.select("x").distinct(), "fit-list")
    fits = fit(fit_list, components, block)
    discard(df.sparkSession, fit_list)
    about = [(dim, i + 1, f.n, float(e / f.trace), f.identity_error) for dim, f in fits.items() for i, e in enumerate(f.values)]
    table = df.sparkSession.createDataFrame(about, "dim int, component int, n long, explained double, identity_error double")
    out = projected(rows, fits).select("id", "dim", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    # a row a component and length: four for the whole table, where all vectors are of one length
    return out.join(F.broadcast(table), ["dim", "component"]).select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
