"""Quality rules by the fertility of public tokenisers.

Each word of a text, with the space before it, is what a vocabulary encodes; distinct words are encoded once a worker and
remembered. Of each vocabulary a text gets its characters per token, the share of tokens that are single bytes for want of a
better one, and the entropy of its tokens in bits. What is usual differs with language, script and length, so the bands are
learned from the corpus: of each language, and of each script, and each class of length within them, the median and the median
deviation over all distinct texts that the base rules pass. A text is rejected if a measure is further from the median than
``WIDTH`` deviations and further than the least width of the measure. A text whose language is unknown, or has too few texts of
its length, is held against its script; if that has too few too, no band speaks against it.

Base rules: a text fails with fewer than 50 words, or if over half of its words are in windows of three words that it repeats.

Defined cases: a null text counts as the empty one, which has no words, null measures and fails; texts are read whole, however
long; equal texts count once in the bands, and each row has its verdict; a null language is unknown; a script without letters
is ``None``; extra columns pass through, one named like an output is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary
from .common import Remembered, discard, field, map_texts, only_cache, staged
from .wordlists import numbered

#: Characters that count as symbols, and what the base rules ask for.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5
#: Names and files of the vocabularies.
VOCABULARIES = (("bytes", "byte_bpe_multi_50k.tiktoken"), ("pieces", "piece_bpe_32k.model"))
#: Measures, the steps in which they are counted, how far from the median they may be whatever the deviations are (by so much,
#: and by such a share of the median), and whether a band is of a class of length.
MEASURES = (("chars_per_token", 0.01, 0.0, 0.12, False), ("byte_share", 0.002, 0.05, 0.0, False), ("entropy", 0.01, 0.0, 0.10, True))
#: Median deviations (as standard deviations of a normal distribution) that a measure may be away from the median.
WIDTH = 6.0
#: A least width grows by the share that so many words are of a text: one odd word moves a short text further.
SHORT_WORDS = 30
#: Texts that a band needs.
LEAST_TEXTS = 30
#: First code points of ranges of letters, and their script (None: no letter of a script).
SCRIPTS = (
    (0x0, None), (0x41, "Latin"), (0x5B, None), (0x61, "Latin"), (0x7B, None), (0xC0, "Latin"), (0x2B0, None), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"),
    (0x590, "Hebrew"), (0x600, "Arabic"), (0x780, None), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, None), (0xB80, "Tamil"), (0xC00, None), (0xE00, "Thai"), (0xE80, None),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, None), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, None), (0x3040, "Kana"), (0x3100, None), (0x3400, "Han"), (0xA000, None),
    (0xAC00, "Hangul"), (0xD7B0, None), (0xF900, "Han"), (0xFB00, None), (0x20000, "Han"), (0x32000, None),
)


def scripts_of(doc: np.ndarray, word: np.ndarray, times: np.ndarray, distinct: list[str], n_docs: int) -> list[str | None]:
    """The script that most letters of each document are of, from how often it has each distinct word."""
    points = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(distinct)), np.fromiter(map(len, distinct), np.int64, len(distinct)))
    place = np.searchsorted([a for a, _ in SCRIPTS], points, side="right") - 1
    names = sorted({SCRIPTS[i][1] for i in np.unique(place).tolist()} - {None})
    best, most = np.full(n_docs, -1), np.zeros(n_docs)
    for k, name in enumerate(names):
        letters = np.bincount(owner[np.isin(place, [i for i, (_, s) in enumerate(SCRIPTS) if s == name])], minlength=len(distinct))
        count = np.bincount(doc, letters[word] * times, n_docs)
        best, most = np.where(count > most, k, best), np.maximum(count, most)
    return [names[k] if k >= 0 else None for k in best.tolist()]


class BytePieces:
    """Words by a byte-level vocabulary of ranks; a byte beyond ASCII that is a token of its own stands for a missing one."""

    def __init__(self, content: bytes, pattern: str):
        self.vocabulary = Vocabulary(content)
        self.encoder, self.size = Encoder(self.vocabulary, pattern), len(self.vocabulary.lens)
        self.single = (self.vocabulary.lens == 1) & (self.vocabulary.blob[np.minimum(self.vocabulary.starts, len(self.vocabulary.blob) - 1)] >= 0x80)

    def ids(self, words: list[str]) -> list[bytes]:
        return self.encoder.rest.of(words, lambda new: self.encoder._learn(new, " "))


class ModelPieces:
    """Words by a model with byte fallback."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size, self.known = self.model.vocab_size(), Remembered()
        self.single = np.array([self.model.is_byte(i) for i in range(self.size)])

    def ids(self, words: list[str]) -> list[bytes]:
        return self.known.of(words, lambda new: [np.array(x, np.int32).tobytes() for x in self.model.encode(new, num_threads=1)])


_held: dict[str, BytePieces | ModelPieces] = {}


def runs_of(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of some consecutive groups of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def fertility(pieces: BytePieces | ModelPieces, doc: np.ndarray, word: np.ndarray, times: np.ndarray, distinct: list[str], chars: np.ndarray) -> list[np.ndarray]:
    """Characters per token, share of byte tokens and entropy of each document, from how often it has each distinct word."""
    raw = pieces.ids(distinct)
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    flat, starts = np.frombuffer(b"".join(raw), np.int32), np.cumsum(sizes) - sizes
    each = sizes[word]
    token = flat[np.repeat(starts[word], each) + runs_of(each)]
    key, place = np.unique(np.repeat(doc, each) * pieces.size + token, return_inverse=True)
    count = np.bincount(place, np.repeat(times, each), len(key))
    of, n = key // pieces.size, len(chars)
    total = np.bincount(of, count, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.bincount(of, count * np.log2(count), n)
        single = np.bincount(of, count * pieces.single[key % pieces.size], n)
        return [chars / total, single / total, np.log2(total) - spread / total]


def repeated_words(doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that are in windows of three words which it has twice or more."""
    if len(word) < 3:
        return np.zeros(n_docs, np.int64)
    size = int(word.max()) + 1
    whole = (doc[2:] == doc[:-2]).nonzero()[0]
    key = np.unique(doc[:-2] * size + word[:-2], return_inverse=True)[1]
    for k in (1, 2):  # ranks of longer and longer windows, so that keys stay small whole numbers
        key = np.unique(key * size + word[k : len(word) - 2 + k], return_inverse=True)[1]
    key = key[whole]
    again = whole[np.bincount(key)[key] > 1] if len(key) else whole
    hit = np.zeros(len(word), bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def with_measures(df: DataFrame, text_col: str, files: Sequence[tuple[str, str]], pattern: str, drop: Sequence[str] = ()) -> DataFrame:
    """Add the counts of the base rules, the script, and the measures of each vocabulary (name, file)."""
    spark = df.sparkSession
    held = []
    for name, path in files:
        with open(path, "rb") as f:  # some MB for any corpus
            held.append((name, path, spark.sparkContext.broadcast(f.read())))

    def make():
        only_cache("fertility", _held.clear)
        for _, path, content in held:
            if path not in _held:
                _held[path] = BytePieces(content.value, pattern) if path.endswith(".tiktoken") else ModelPieces(content.value)

        def run(_batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            n = len(texts)
            _, numbers, distinct = numbered(texts)
            lens = np.array([len(x) for x in numbers], np.int64)
            doc, word = np.repeat(np.arange(n), lens), np.concatenate([*numbers, np.zeros(0, np.int32)]).astype(np.int64)
            sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
            chars = np.bincount(doc, sizes[word], n).astype(np.int64)
            key, times = np.unique(doc * max(1, len(distinct)) + word, return_counts=True)
            pairs = key // max(1, len(distinct)), key % max(1, len(distinct)), times
            lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
            out = [
                pa.array(lens), pa.array(chars), pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
                pa.array([len(x) - len(set(x)) for x in lines], pa.int64()), pa.array(repeated_words(doc, word, n)), pa.array(scripts_of(*pairs, distinct, n), pa.string()),
            ]
            for _, path, _ in held:
                out += [pa.array(x, mask=lens == 0) for x in fertility(_held[path], *pairs, distinct, chars)]
            return out

        return run

    counts = [field(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    measures = [field(f"{name}_{m}", "double") for name, *_ in files for m, *_ in MEASURES]
    return map_texts(df, text_col, [*counts, field("script", "string"), *measures], make, drop)


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * n)


def length_class() -> Column:
    """Two classes each time the length doubles."""
    return F.floor(2 * F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def bands(texts: DataFrame, group: str, keys: Sequence[str], names: Sequence[str], least: int = LEAST_TEXTS) -> DataFrame:
    """Of each ``keys``: median and median deviation of each measure, in columns that begin with ``group``. Measures are counted
    in steps, so that what the medians hold is bounded."""
    rounded = [(F.round(F.col(c) / kind(c)[1]) * kind(c)[1]).alias(c) for c in names]
    counted = texts.where(F.col(group).isNotNull()).select(*keys, *rounded)
    middle = counted.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile(c, 0.5).alias(f"{group}_{c}_mid") for c in names]).where(F.col("n") >= least).drop("n")
    middle = staged(middle, "band-medians")  # Spark knows its size and broadcasts it if that is small
    away = [F.percentile(F.round(F.abs(F.col(c) - F.col(f"{group}_{c}_mid")), 4), 0.5).alias(f"{group}_{c}_mad") for c in names]
    return staged(counted.join(middle, list(keys)).groupBy(*keys).agg(*[F.first(f"{group}_{c}_mid").alias(f"{group}_{c}_mid") for c in names], *away), "bands")


def kind(column: str) -> tuple:
    """The measure that a column is of."""
    return next(m for m in MEASURES if column.endswith(f"_{m[0]}"))


def verdicts(measured: DataFrame, lang_col: str, names: Sequence[str], width: float = WIDTH) -> DataFrame:
    """Add base_failed and kept to measured rows that have ``text_hash``."""
    rows = measured.withColumn("base_failed", base_failed()).withColumn("class", length_class())
    once = rows.where(~F.col("base_failed")).select("text_hash", lang_col, "script", "class", *names).distinct()
    out = rows
    for group in (lang_col, "script"):
        for keys, of in (([group], [c for c in names if not kind(c)[4]]), ([group, "class"], [c for c in names if kind(c)[4]])):
            out = out.join(bands(once, group, keys, of), keys, "left")
    inside = []
    for c in names:
        _, _, by, share, _ = kind(c)
        mid, mad = (F.coalesce(f"{lang_col}_{c}_{k}", f"script_{c}_{k}") for k in ("mid", "mad"))
        inside.append(F.coalesce(F.abs(F.col(c) - mid) <= F.greatest(width * 1.4826 * mad, (by + share * mid) * (1 + SHORT_WORDS / F.greatest("n_words", F.lit(1)))), F.lit(True)))
    return out.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, inside))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabularies: Sequence[tuple[str, str]] = (), pattern: str = "", width: float = WIDTH) -> DataFrame:
    """Per row: id, the counts of the base rules, base_failed, kept, script and all measures. ``vocabularies`` are (name, path)."""
    small = df.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    measured = staged(with_measures(small, "text", vocabularies, pattern, ["text"]), "measures")
    names = [f"{v}_{m}" for v, _ in vocabularies for m, *_ in MEASURES]
    out = verdicts(measured, "lang", names, width)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *names)
