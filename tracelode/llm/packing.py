"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

1. Documents are tokenised and cut into pieces of at most ``capacity`` tokens (only longer ones are cut).
2. Pieces are range-sorted by length; the place of a piece among those of its length is its rank. Pieces of one length are
   interchangeable, so the sorted documents and the sorted gaps are both held as runs: a value and how many have it. There
   are at most ``capacity`` runs, whatever the corpus holds.
3. One round a length, longest first: the run of pieces sweeps to its successor, the least gap that holds it. Where more
   pieces than gaps meet there, ranks decide: the lowest ranks take that gap, the others sweep on to the next, and what
   finds no gap opens sequences. All gaps of the round are updated before the next one begins.
4. The matches, intervals of ranks, are applied to all pieces at once where they lie.

The sweeps therefore read counts of pieces and never the pieces. The driver holds at most ``capacity`` counts, the
positions of runs (partitions + ``capacity`` rows) and the intervals, whose number depends on ``capacity`` alone
(``MAX_INTERVALS``; more raise an error rather than drop anything).

Defined cases: a null or empty text is one piece, the end token; repeated rows are packed once each; equal lengths take
places in the order of id and piece; an empty table gives no piece; columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Merges
from .common import Remembered, discard, only_cache, shards_for, slices, staged, tidy

CAPACITY = 2048
#: Bound of the broadcast intervals; four numbers of 8 bytes each.
MAX_INTERVALS = 4_000_000
#: Fixed value: a split pattern under which letters alone are one match, and so is a sign after them.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = frozenset(".,;:!?)")
#: Pieces of documents that one partition of the sort holds.
SORT_ROWS = 200_000


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def _lower(s: str) -> str:
    return s.lower() if "\u03a3" not in s else "".join([c.lower() for c in s])  # a final sigma is no exception here


def memory_of(texts: pa.Array) -> bytes:
    """All bytes of some texts."""
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    return texts.buffers()[2].slice(int(ends[texts.offset]), int(ends[texts.offset + len(texts)] - ends[texts.offset])).to_pybytes() if len(texts) and texts.buffers()[2] else b""


class Tokens:
    """Whole texts to ids, as the ``tokenizers`` library has them, for a file whose model never looks across white space.

    For byte-level merges with word ends after NFC and lower-casing, distinct pieces go through the padded matrices of
    ``bpe``; any other file of that kind is left to the library, a distinct word at a time.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.content, self.library = content, None
        spec = json.loads(content)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.words = Remembered()
        self.merges = self._merges(spec)

    def _merges(self, spec: dict) -> Merges | None:
        steps, cuts, model = ((spec.get(x) or {}) for x in ("normalizer", "pre_tokenizer", "model"))
        kinds = [x.get("type") for x in steps.get("normalizers", [])], [x.get("type") for x in cuts.get("pretokenizers", [])]
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not plain or spec.get("post_processor"):
            return None
        split, level = cuts["pretokenizers"]
        if not split.get("invert") or split.get("behavior") != "Removed" or level.get("use_regex") or level.get("add_prefix_space"):
            return None
        self.split, self.letters = regex.compile(split["pattern"]["Regex"]), split["pattern"]["Regex"] == LETTERS
        vocab, end, chars = model["vocab"], model["end_of_word_suffix"], byte_characters()
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        pairs = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        first, last = (np.array([vocab.get(c + x, -1) for c in chars], np.int32) for x in ("", end))
        return Merges(first, last, pairs, merged)

    @property
    def tokenizer(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
        return self.library

    def _plan(self, word: str) -> tuple[str, ...] | list[str]:
        """The matches of the split pattern in a word."""
        if word.isascii():
            word = word.lower()
        elif max(word) < "\u0130":  # composed already, and no letter gets longer
            word = word.lower()
        else:
            return self.split.findall(_lower(unicodedata.normalize("NFC", word)))
        if self.letters:
            if word.isalpha():
                return (word,)
            if word[-1:] in SIGNS and word[:-1].isalpha():
                return word[:-1], word[-1]
        return self.split.findall(word)

    def _learn(self, missing: list[str]) -> list[bytes]:
        if self.merges:
            plans = [self._plan(x) for x in missing]
            known = self.merges.encode_distinct(plans)
            return [known[p[0]] if len(p) == 1 else b"".join([known[m] for m in p]) for p in plans]
        out: list[bytes] = []
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32).tobytes()
            edge = (np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(part) + 1)) * 4).tolist()
            out += [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        # \x1c to \x1f are white space to Arrow but not to the tokenizer
        apart = [x for x in (*self.special, "\x1c", "\x1d", "\x1e", "\x1f") if x.encode() in memory_of(texts)]
        whole = np.logical_or.reduce([np.zeros(len(texts), bool), *(pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in apart)])
        plain = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts) if apart else texts
        split = pc.utf8_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if known:
            values = self.words.of(known, self._learn)
            size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
            flat, which = np.frombuffer(b"".join(values), np.int32), words.indices.to_numpy()
            each = size[which]
            ends = np.cumsum(each)
            ids = flat[np.repeat((np.cumsum(size) - size)[which] - (ends - each), each) + np.arange(ends[-1])].tobytes()
            edge = (np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4).tolist()
        else:
            ids, edge = b"", [0] * (len(texts) + 1)
        return [self._whole(texts[i].as_py()) if w else ids[a:b] for i, (w, a, b) in enumerate(zip(whole.tolist(), edge[:-1], edge[1:], strict=True))]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


_held: dict[int, tuple[str, Tokens]] = {}


def _tokens(content: str) -> Tokens:
    only_cache("packing", _held.clear)
    key = hash(content)
    if key not in _held or _held[key][0] != content:
        _held.clear()
        _held[key] = (content, Tokens(content))
    return _held[key][1]


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row a piece: ``id_col``, piece, start, length, ids_crc32 and, if asked for, its ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    ids = df.schema[id_col]
    schema = T.StructType([T.StructField(id_col, ids.dataType), *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(content.value)
        for whole in batches:
            for batch in slices(whole, 1):
                coded = [x + end for x in tokens.encode(pc.fill_null(batch.column(1), ""))]
                cut = [(i, k, c[4 * capacity * k : 4 * capacity * (k + 1)]) for i, c in enumerate(coded) for k in range(-(-len(c) // (4 * capacity)))]
                cols = [batch.column(0).take(pa.array([i for i, _, _ in cut], pa.int32())), pa.array([k for _, k, _ in cut], pa.int32()), pa.array([k * capacity for _, k, _ in cut], pa.int64()), pa.array([len(c) // 4 for *_, c in cut], pa.int64()), pa.array([zlib.crc32(c) for *_, c in cut], pa.int64())]
                if keep_ids:
                    ends = np.cumsum([0, *(len(c) // 4 for *_, c in cut)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(c for *_, c in cut), np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def sweep(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Match runs of pieces to runs of gaps, longest pieces first.

    Returns the matches (length, first rank, first sequence, offset), each up to the next one's first rank, by length and
    rank, and the number of sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: intervals of sequences that have it, as (first, how many)
    order: list[int] = []  # gaps that some sequence has, ascending
    out: list[tuple[int, int, int, int]] = []
    used = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):  # no gap holds it: enough sequences for all that remain
                each = capacity // length
                opened = -(-left // each)
                give(capacity, used, opened)
                used += opened
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            take = min(left, n)
            out.append((length, rank, first, capacity - gap))
            give(gap - length, first, take)
            give(gap, first + take, n - take)
            rank += take
            left -= take
            if len(out) > MAX_INTERVALS:
                raise ValueError("more intervals than the documented bound")
    return np.array(sorted(out), np.int64).reshape(-1, 4), used


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, least_partitions: int = 1) -> DataFrame:
    """Add sequence_id and offset to pieces (``id_col``, piece, length and whatever else they carry)."""
    spark = pieces.sparkSession
    n = pieces.count()
    parts = shards_for(n, SORT_ROWS, least_partitions)
    low = (1 << 33) - 1
    # the position of a row is written with it, so that a lost task can't move rows between partitions
    ordered = staged(
        pieces.repartitionByRange(parts, F.col("length"), F.col(id_col), F.col("piece")).sortWithinPartitions("length", id_col, "piece")
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("__pos")),
        "pieces-by-length",
    )
    # at most partitions + capacity rows, as each partition holds a range of lengths
    runs = ordered.groupBy("length", "__part").agg(F.count("*").alias("n"), F.min("__pos").alias("at")).orderBy("length", "__part").collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in runs:
        if not 0 < r["length"] <= capacity:
            raise ValueError("a piece is empty or longer than a sequence")
        before[r["length"], r["__part"]] = counts.get(r["length"], 0) - r["at"]
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    matches, _ = sweep(counts, capacity)
    shared = spark.sparkContext.broadcast((before, matches))
    keep = [f for f in pieces.schema if f.name not in ("sequence_id", "offset")]
    schema = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, matches = shared.value
        big = np.int64(1) << np.int64(40)
        keys = matches[:, 0] * big + matches[:, 1]
        for b in batches:
            length, part, pos = (np.asarray(b.column(b.schema.names.index(x))).astype(np.int64) for x in ("length", "__part", "__pos"))
            pairs, which = np.unique(length << 32 | part, return_inverse=True)
            rank = pos + np.array([before[int(p) >> 32, int(p) & 0xFFFFFFFF] for p in pairs], np.int64)[which] if len(pairs) else pos
            m = matches[np.searchsorted(keys, length * big + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(f.name)) for f in keep), pa.array(m[:, 2] + rank - m[:, 1]), pa.array(m[:, 3])], names=schema.names)

    return ordered.select(*[f.name for f in keep], "__part", "__pos").mapInArrow(tidy(place), schema)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack whole documents. Tokens are made once and staged."""
    pieces = staged(tokenize(df, tokenizer_path, id_col, text_col, capacity, keep_ids=keep_ids), "pieces")
    out = pack(pieces, id_col, capacity)
    discard(df.sparkSession, pieces)
    return out
