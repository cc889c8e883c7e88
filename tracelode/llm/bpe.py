"""Byte-level BPE encoding and decoding in padded numpy matrices.

Under the split pattern ``SPACED`` texts are first cut at single spaces between other characters, where it always cuts too;
distinct pieces are encoded once a worker and remembered in a cache of bounded bytes. Pieces go through matrices of rows of
similar length: in each round every row merges its leftmost pair of least rank, pairs are looked up in an open-addressing hash
table, and one compaction takes merged places and finished rows out. A row of ``WIDE`` bytes or more is a matrix of its own;
there a round merges all occurrences of the pair, as long as no pair that this makes has a lesser rank.

Defined cases: a null or empty text has no ids; equal texts have equal ids; pieces of any length are merged by matrices;
extra columns pass through, one named like an output is replaced; an empty table gives an empty one. Ids out of the
vocabulary raise when decoded, null ids decode to nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, field, map_texts, only_cache, tidy

#: A piece of so many bytes is a matrix of one row.
WIDE = 256
#: Fixed value: a split pattern that always cuts before a single space between other characters.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)


class Merges:
    """Merges of pairs of ids by rank. ``first`` has the id of each byte, ``last`` that of a piece's last byte, ``pairs`` the
    rank of each mergeable pair (left << 32 | right) and ``merged`` the id that each rank makes."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: dict[int, int], merged: np.ndarray):
        if (first < 0).any() or (last < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self.first, self.last, self.merged = first, last, merged
        self.whole: dict[bytes, bytes] = {}  # ids of pieces that are tokens, whatever the merges would do
        self._table(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.inner, self.final = self.pair_ranks(first[a], first[b]), self.pair_ranks(first[a], last[b])  # of two bytes

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            taken, first = np.unique(slot[left][free], return_index=True)
            who = left[free][first]
            self.keys[taken], self.values[taken] = keys[who], values[who]
            left = left[~np.isin(left, who)]
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each merged pair, NONE where the two don't merge (also where either is negative)."""
        key = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(key)
        found = np.where(self.keys[slot] == key, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != np.uint64(2**64 - 1))]
        return np.where((left < 0) | (right < 0), NONE, found)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian int32."""
        out: list[bytes | None] = list(map(self.whole.get, pieces)) if self.whole else [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces) + bytes(WIDE), np.uint8)
        starts = np.cumsum(sizes) - sizes
        open_ = np.fromiter((x is None for x in out), bool, len(out))
        for i in np.flatnonzero(open_ & (sizes >= WIDE)).tolist():
            out[i] = self._wide(pieces[i])
        for i in np.flatnonzero(sizes == 0).tolist():
            out[i] = b""
        narrow = np.flatnonzero(open_ & (sizes > 0) & (sizes < WIDE))
        widths = np.where(sizes[narrow] <= 16, sizes[narrow], (sizes[narrow] + 7) & -8)
        narrow = narrow[np.argsort(widths, kind="stable")]
        widths = np.sort(widths)
        edge = np.flatnonzero(np.concatenate([[True], widths[1:] != widths[:-1], [True]])) if len(widths) else np.zeros(0, np.int64)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            width = int(widths[a])
            for at in range(a, z, step := max(64, (1 << 18) // width)):
                part = narrow[at : min(at + step, z)]
                self._matrix(data[starts[part][:, None] + np.arange(width)], sizes[part].astype(np.int32), part, out)
        return out

    def encode_distinct(self, plans: Sequence[Sequence[str]]) -> dict[str, bytes]:
        """The ids of each different piece of some plans."""
        new = list({m for p in plans for m in p})
        return dict(zip(new, self.encode_pieces([x.encode("utf-8", "surrogatepass") for x in new]), strict=True))

    def _matrix(self, raw: np.ndarray, n: np.ndarray, places: np.ndarray, out: list[bytes | None]) -> None:
        """The ids of the first ``n`` bytes of each row of ``raw``, put into ``out`` at ``places``."""
        width, rows = raw.shape[1], np.arange(len(raw))
        ids = np.where(np.arange(width) < n[:, None], self.first[raw], np.int32(-1))
        ids[rows, n - 1] = self.last[raw[rows, n - 1]]
        ranks = np.full(ids.shape, NONE, np.int32)
        two = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        ranks[:, :-1] = np.where(np.arange(1, width) < n[:, None] - 1, self.inner[two], NONE)
        long = np.flatnonzero(n > 1)
        ranks[long, n[long] - 2] = self.final[two[long, n[long] - 2]]
        while len(rows):
            line = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            best = ranks[line, at]
            done = best == NONE
            keep = np.ones(ids.shape, bool)
            if done.any():
                size, w = n[done].tolist(), ids.shape[1]
                flat = ids[done].tobytes()
                for k, (i, z) in enumerate(zip(places[done].tolist(), size, strict=True)):
                    out[i] = flat[4 * w * k : 4 * (w * k + z)]
                live = ~done
                keep[done] = False
                line, at, best, n, places = line[live], at[live], best[live], n[live], places[live]
            rows = line
            if not len(rows):
                break
            # the right place of each pair goes, so that all rows get narrower by one
            ids[line, at] = self.merged[best]
            keep[line, at + 1] = False
            w = ids.shape[1] - 1
            ids, ranks = ids[keep].reshape(-1, w), ranks[keep].reshape(-1, w)
            n = n - 1
            line = np.arange(len(rows))
            mid = ids[line, at]
            ranks[line, at] = self.pair_ranks(mid, np.where(at + 1 < w, ids[line, np.minimum(at + 1, w - 1)], -1))
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.pair_ranks(ids[has, at[has] - 1], mid[has])

    def _wide(self, piece: bytes) -> bytes:
        """The ids of one long piece."""
        raw = np.frombuffer(piece, np.uint8)
        ids = self.first[raw]
        ids[-1] = self.last[raw[-1]]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # of pairs that overlap, as in aaa, the leftmost of each run counts, then every second one
            head = np.concatenate([[True], np.diff(at) > 1])
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) % 2 == 0]
            while True:
                new = ids.copy()
                new[at] = self.merged[best]
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                new = new[keep]
                now = at - np.arange(len(at))
                left, right = now[now > 0], now[now < len(new) - 1]
                before, after = self.pair_ranks(new[left - 1], new[left]), self.pair_ranks(new[right], new[right + 1])
                if len(at) == 1 or min(before.min(initial=NONE), after.min(initial=NONE)) > best:
                    break
                at = at[:1]  # a pair that comes first is made: one merge, as in a narrow row
            ranks = ranks[keep[1:]] if len(new) > 1 else ranks[:0]
            ranks[left - 1] = before
            ranks[right] = after
            ids = new
        return ids.tobytes()


class Vocabulary(Merges):
    """Ranks of a ``.tiktoken`` file, where a rank is an id: pairs are all two tokens whose bytes make a third."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        n = max(ranks.values(), default=-1) + 1
        tokens = [b""] * n
        for t, r in ranks.items():
            tokens[r] = t
        self.lens = np.fromiter(map(len, tokens), np.int64, n)
        self.starts = np.cumsum(self.lens) - self.lens
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        get = ranks.get
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        super().__init__(single, single, pairs, np.arange(n, dtype=np.int32))
        self.ranks = ranks
        self.whole = {t: r.to_bytes(4, "little") for t, r in ranks.items()}

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.lens):
            raise ValueError("an id is not in the vocabulary")
        n = self.lens[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.blob[at].tobytes()


class Encoder:
    """Whole texts to ids, with what a worker remembers between batches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.split, self.spaced = vocabulary, regex.compile(pattern), pattern == SPACED
        self.edge, self.odd = regex.compile(r"(?<=\S) (?=\S)"), regex.compile(r"\s\s|\A\s|\s\Z")
        self.first, self.rest = Remembered(), Remembered()  # starts of texts; parts after a space, without it

    def _parts(self, text: str) -> list[str]:
        if not self.spaced:
            return [text]
        return self.edge.split(text) if self.odd.search(text) else text.split(" ")

    def _learn(self, missing: list[str], before: str) -> list[bytes]:
        if self.spaced:
            # a part that is letters alone is one match
            plans = [(before + x,) if x.isascii() and x.isalpha() else self.split.findall(before + x) for x in missing]
        else:
            plans = [self.split.findall(x) for x in missing]
        known = self.v.encode_distinct(plans)
        return [known[p[0]] if len(p) == 1 else b"".join([known[m] for m in p]) for p in plans]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) if t else [] for t in texts]
        heads = list({p[0] for p in parts if p})
        first = dict(zip(heads, self.first.of(heads, lambda new: self._learn(new, "")), strict=True))
        tails = list(set().union(*[p[1:] for p in parts]))
        rest = dict(zip(tails, self.rest.of(tails, lambda new: self._learn(new, " ")), strict=True)).__getitem__
        return [first[p[0]] + b"".join(map(rest, p[1:])) if p else b"" for p in parts]


_held: dict[int, tuple[bytes, Vocabulary, dict[str, Encoder]]] = {}


def _vocabulary(content: bytes) -> tuple[bytes, Vocabulary, dict[str, Encoder]]:
    """Built once a worker process."""
    only_cache("bpe", _held.clear)
    key = hash(content)
    if key not in _held or _held[key][0] != content:
        _held.clear()
        _held[key] = (content, Vocabulary(content), {})
    return _held[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, text_col: str, vocab_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>). The rank file is read on the driver and broadcast: some MB for any corpus."""
    content = df.sparkSession.sparkContext.broadcast(_read(vocab_path))

    def make():
        _, vocabulary, encoders = _vocabulary(content.value)
        encoder = encoders.setdefault(pattern, None) or encoders.__setitem__(pattern, Encoder(vocabulary, pattern)) or encoders[pattern]

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            raw = encoder.encode(texts)
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))]

        return run

    return map_texts(df, text_col, [field(ids_col, "array<int>")], make)


def decode(df: DataFrame, ids_col: str, vocab_path: str, out_col: str = "decoded") -> DataFrame:
    """Add ``out_col`` (binary), the bytes of ``ids_col``; null ids count as none."""
    content = df.sparkSession.sparkContext.broadcast(_read(vocab_path))
    keep = [f for f in df.schema if f.name.lower() != out_col.lower()]
    schema = T.StructType([*keep, field(out_col, "binary")])
    at = [f.name for f in keep].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary, _ = _vocabulary(content.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                col = batch.column(at)
                ends, flat = np.asarray(col.offsets), np.asarray(col.values)
                raw = [vocabulary.decode(flat[a:b]) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], np.asarray(col.is_valid()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(tidy(run), schema)
