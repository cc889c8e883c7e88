"""Periodic runs of words by harmonic grid probing.

A run is a stretch of consecutive words whose smallest period is q, that is at least ``max(LEAST_WORDS, LEAST_PERIODS * q)``
words long and that no neighbouring word extends. For each period p the words at 0, p, 2p, ... are compared with those one
period later, which costs n/p and n log n for all periods together. A run of period p holds four words of the grid at least,
so three equal pairs in a row are a survivor; it is extended to both sides by comparing chunks of growing size. Grid points
within a run found for a divisor of p are skipped: what has period p there has that divisor as its smallest period.

That a stretch has no smaller period follows from what has been found: by the theorem of Fine and Wilf such a period divides p,
and its own run has the same borders.

Defined cases: a null or empty text, and one of fewer than six words, has no runs; texts are read whole, however long;
runs that overlap count each; the strongest has the greatest exact length/period, then the smallest start, then the smallest
period; repeated rows have the same result each; extra columns pass through, one named like an output is replaced; an empty
table gives an empty one.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import field, map_texts
from .wordlists import numbered

#: What a run must hold.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words of the first chunk that is compared, and of the largest.
CHUNK, CHUNKS = 32, 1 << 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def stretch(w: np.ndarray, p: int, x: int) -> tuple[int, int]:
    """The longest [a, b) around ``x`` in which every word equals the one p later."""
    b, size = x, CHUNK
    while b < (end := len(w) - p):
        upto = min(b + size, end)
        same = w[b:upto] == w[b + p : upto + p]
        if not same.all():
            b += int(same.argmin())
            break
        b, size = upto, min(2 * size, CHUNKS)
    a, size = x, CHUNK
    while a > 0:
        low = max(0, a - size)
        same = (w[low:a] == w[low + p : a + p])[::-1]
        if not same.all():
            a -= int(same.argmin())
            break
        a, size = low, min(2 * size, CHUNKS)
    return a, b


def survivors(w: np.ndarray, p: int, same: np.ndarray) -> list[int]:
    """Words of the grid with which a run of period p may begin: those with three equal pairs in a row, whose next words equal
    those one period later too. All are compared at once, so that texts of few different words cost no extension each."""
    x = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * p
    for o in range(1, min((LEAST_PERIODS - 2) * p, CHUNK // 2) + 1):
        if not len(x):
            break
        x = x[w[x + o] == w[x + o + p]]
    return x.tolist()


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among numbered words, by start, then period."""
    n = len(w)
    found: list[tuple[int, int, int]] = []
    if n < LEAST_WORDS:
        return found
    known: set[tuple[int, int]] = set()
    of: dict[int, list[tuple[int, int]]] = {}  # borders of a period's runs
    due: dict[int, list[int]] = {}  # periods with runs, at the next of their multiples
    survivor = b"\1" * (LEAST_PERIODS - 1)
    for p in range(1, n // LEAST_PERIODS + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        for q in due.pop(p, ()):
            of[q] = [(s, e) for s, e in of[q] if e - s > (LEAST_PERIODS - 1) * p]  # a shorter one holds no survivor, now or later
            for s, e in of[q]:
                same[-(-s // p) : (e - 1) // p] = False
            if of[q]:
                due.setdefault(p + q, []).append(q)
        b = 0
        for x in survivors(w, p, same) if survivor in same.tobytes() else ():
            if x < b:
                continue
            a, b = stretch(w, p, x)
            length = b + p - a
            if length >= max(LEAST_WORDS, LEAST_PERIODS * p) and (a, b + p) not in known:
                known.add((a, b + p))
                found.append((a, length, p))
                of.setdefault(p, []).append((a, b + p))
        if p in of:
            due.setdefault(2 * p, []).append(p)
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False at the words that a run repeats: all of it but its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def with_runs(df: DataFrame, text_col: str = "text", runs_col: str = "runs", strongest_col: str = "strongest", collapsed_col: str = "collapsed") -> DataFrame:
    """Add all runs of a text (array of start, length and period), the strongest (null where there is none) and the text's
    words without what runs repeat, joined by single spaces."""
    kind = field("x", RUN).dataType
    arrow = pa.struct([(f.name, pa.int64()) for f in kind.fields])
    as_struct = lambda r: dict(zip(kind.names, r, strict=True)) if r else None

    def make():
        def run(_batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            words, numbers, _ = numbered(texts)
            runs = [find_runs(w) for w in numbers]
            joined = [" ".join(compress(ws, kept_words(len(ws), rs).tolist()) if rs else ws) for ws, rs in zip(words, runs, strict=True)]
            return [pa.array([list(map(as_struct, rs)) for rs in runs], pa.list_(arrow)), pa.array([as_struct(strongest(rs)) for rs in runs], arrow), pa.array(joined, pa.string())]

        return run

    return map_texts(df, text_col, [field(runs_col, f"array<{RUN}>"), field(strongest_col, RUN), field(collapsed_col, "string")], make)
