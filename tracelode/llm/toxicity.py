"""A toxicity classifier with counterfactual regularisation.

Logistic regression on the presence of words and of their beginnings (``PREFIXES`` letters), so that forms of a word that no
label shows still tell. Besides the loss on labels, each labelled text that names a group is paired
with the same text naming another group of the same kind, and each benign text with itself plus a neutral mention; the
squared change of the score within a pair is penalised. What a text says of a group then carries the score, the group's
name alone does not.

Learning is bounded: at most ``SAMPLE_ROWS`` labelled rows, taken by the order of a hash of the id, and ``MAX_FEATURES``
features, chosen on that sample by how far their share among toxic texts stands from that among the others. Scoring reads every
text whole. Ids, sources, languages and labels are never inputs of a score.

Defined cases: a null or empty text gets the score of a text with no known word; labels other than 0 and 1, null ids and
rows of the held-out fold are not learned from; an id labelled twice is toxic if either says so; repeated rows have equal
scores and are learned from once, by the least text of the id; without labels of both kinds the score is the share of toxic labels (0 without any); an empty table gives an empty one; extra columns
pass through, ones named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, only_cache, staged, tidy

#: Labelled rows that are learned from, at most; the broadcast ids take 8 bytes each.
SAMPLE_ROWS = 20_000
MAX_FEATURES = 4_096
#: A word is a feature from so many sampled texts and standard errors on.
LEAST_TEXTS, LEAST_Z = 4, 5.0
PENALTY, RIDGE = 4.0, 2e-5
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
#: Words that a worker remembers the features of before it starts anew.
CACHE_WORDS = 100_000
#: Longer words are not remembered.
LONGEST = 64

# Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrants", "refugees", "foreigners"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transsexuelle"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("alte", "junge", "behinderte", "blinde", "gehörlose"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("immigrés", "réfugiés", "étrangers"),
    ("vieux", "jeunes", "handicapés", "aveugles", "sourds"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("viejos", "jóvenes", "discapacitados", "ciegos", "sordos"),
)

_words = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_words.findall(text.lower()))


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def forms(word: str) -> set[str]:
    """A word and its beginnings, which ``^`` marks."""
    return {word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)}


def features(found: set[str]) -> set[str]:
    return {f for w in found for f in forms(w)}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self._hits: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_hits": {}}

    def score(self, text: str) -> float:
        w, hits = self.weights, self._hits
        if not w:
            return float(1 / (1 + np.exp(-np.clip(self.bias, -40, 40))))
        if len(hits) > CACHE_WORDS:
            hits.clear()
        seen: set[str] = set()
        for x in words(text):
            h = hits.get(x)
            if h is None:
                h = tuple(sorted(forms(x) & w.keys()))
                if len(x) <= LONGEST:
                    hits[x] = h
            if h:
                seen.update(h)
        z = self.bias + sum([w[x] for x in sorted(seen)])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def swapped(found: set[str]) -> list[set[str]]:
    """The words of the texts that name another group of the same kind instead, for each term and each other one of its kind."""
    out = []
    for kind in IDENTITY:
        for term in kind:
            if term in found:
                out += [(found - {term}) | {other} for other in kind if other not in found]
    return out


def fit(rows: list[tuple[set[str], int]], chosen: list[str], penalty: float = PENALTY, ridge: float = RIDGE, rounds: int = 300) -> Model:
    """Adam on the penalised loss over all rows at once. ``rows``: the words of a text that have a known form, and its label."""
    n = len(rows)
    y = np.array([t for _, t in rows], float)
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        return Model({}, 40.0 if share else -40.0)
    terms = [t for kind in IDENTITY for t in kind]
    names = list(dict.fromkeys([*chosen, *terms]))
    at = {w: i for i, w in enumerate(names)}

    pairs: list[tuple[int, set[str]]] = []  # a row, and the words of its counterfactual
    for i, (found, label) in enumerate(rows):
        pairs += [(i, x) for x in swapped(found)]
        if not label and terms:
            pairs.append((i, found | {terms[i % len(terms)]}))  # a neutral mention

    def flat(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        idx = [sorted({at[f] for f in features(s) if f in at}) for s in sets]
        return np.repeat(np.arange(len(idx)), [len(x) for x in idx]), np.array([j for x in idx for j in x], np.int64)

    r, c = flat([f for f, _ in rows])
    pr, pc = flat([f for _, f in pairs])
    base = np.array([i for i, _ in pairs], np.int64)
    w, b = np.zeros(len(names)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(r, w[c], n))))
        g = (p - y) / n
        if len(pairs):
            q = 1 / (1 + np.exp(-(b + np.bincount(pr, w[pc], len(pairs)))))
            d = 2 * penalty * (p[base] - q) / len(pairs)
            g += np.bincount(base, d * p[base] * (1 - p[base]), n)
            gq = -d * q * (1 - q)
        else:
            gq = np.zeros(0)
        gw = np.bincount(c, g[r], len(w)) + np.bincount(pc, gq[pr], len(w)) + ridge * w
        gb = g.sum() + gq.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.15 * min(1.0, 3 * (1 - (step - 1) / rounds))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model({x: float(w[i]) for x, i in at.items() if w[i]}, float(b))


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at once: each makes thousands of strings."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the bounded sample. Only the chosen words of the sampled texts come to the driver."""
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    sample = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    chosen = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).join(F.broadcast(sample), id_col)
    chosen = chosen.groupBy(id_col).agg(F.first("__y").alias("__y"), F.min("__text").alias("__text"))  # rows that repeat an id are one example

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(words(t or "")) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["y", "words"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [features(set(w)) for w in b.column(1).to_pylist()]
            y = np.repeat(b.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array([x for f in found for x in f], pa.string())], names=["y", "w"])

    bags = staged(chosen.select("__y", "__text").mapInArrow(tidy(split), "y int, words array<string>"), "toxicity-sample")
    totals = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    best: list[str] = []
    if n0 and n1:
        share = n1 / (n0 + n1)
        z = (F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
        counted = bags.mapInArrow(tidy(spread), "y int, w string").groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
        far = counted.where(F.col("n") >= LEAST_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(MAX_FEATURES)
        best = [r["w"] for r in far.collect()]
    known = spark.sparkContext.broadcast({*best, *(t for kind in IDENTITY for t in kind)})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            kept = [[x for x in w if not known.value.isdisjoint(forms(x))] for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.string()))], names=["y", "words"])

    rows = bags.mapInArrow(tidy(pick), "y int, words array<string>").collect()
    ordered = sorted((tuple(r["words"]), r["y"]) for r in rows)  # sums then don't depend on the order of tasks
    return fit([(set(w), t) for w, t in ordered], best)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``: 0 to 1, higher where toxic is likelier."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        only_cache("toxicity")
        m = shared.value

        def run(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            return [pa.array([m.score(t) for t in texts], pa.float64())]

        return run

    return map_texts(df, text_col, [field(score_col, "double")], make)
