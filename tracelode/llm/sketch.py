"""Document fingerprints: threshold-scaled sketches, made of DataFrame functions alone.

Every hash of a shingle below a fixed fraction of the hash range is retained, so a sketch grows with its text, two sketches
merge by union, and the share of one within another estimates containment however unequal the texts are.

Beside it stands the least hash of all, which tells texts apart of which nothing is retained: it serves the fingerprint and
the likeness of two empty sketches, and never merges or containment.

Defined cases: a null text counts as the empty one, whose sketch is empty and whose least hash is null; a text of fewer words than
a shingle is one shingle; the order of documents is by id, and each row of an id is paired with one row of the next, the one
whose text has the least hash; a null id has no next document and is the next of none; equal texts have equal sketches; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shards_for, staged

#: One hash of so many is retained.
SCALE = 8
WORDS = 5
#: Ids that one partition orders.
ORDER_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, scale: int = SCALE, size: int = WORDS) -> Column:
    """struct(kept, least): the retained hashes of ``text``, ascending and distinct, and the least hash of all."""
    below = -(1 << 63) + (1 << 64) // scale

    def hashes(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
        return F.when(F.size(ws) >= size, each).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))

    def retain(hs: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(F.filter(hs, lambda h: h < F.lit(below)))).alias("kept"), F.array_min(hs).alias("least"))

    # one-element arrays bind a value to a name, so that it is computed once and not at each use
    bound = F.transform(F.array(words(F.coalesce(text, F.lit("")))), lambda ws: F.transform(F.array(hashes(ws)), retain)[0])
    return bound[0]


def fingerprint(sketched: Column) -> Column:
    """A sketch as text: 16 hex digits a hash; where none is retained, a minus sign and the least hash."""
    digits = lambda k: F.lpad(F.hex(k), 16, "0")
    alone = F.when(sketched["least"].isNotNull(), F.concat(F.lit("-"), digits(sketched["least"]))).otherwise(F.lit(""))
    return F.when(F.size(sketched["kept"]) > 0, F.array_join(F.transform(sketched["kept"], digits), "")).otherwise(alone)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; of two sketches without a hash, whether the least hashes are the same."""
    x, y = a["kept"], b["kept"]
    both = F.size(F.array_intersect(x, y))
    none = (F.size(x) == 0) & (F.size(y) == 0)
    return F.when(none, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(both / (F.size(x) + F.size(y) - both)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a`` that is found in ``b``; 1 where ``a`` is empty."""
    x, y = a["kept"], b["kept"]
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x)).cast("double")


def merge(sketches: Column) -> Column:
    """Aggregate: the sketch of all texts of a group together."""
    return F.struct(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches["kept"])))).alias("kept"), F.min(sketches["least"]).alias("least"))


def with_sketch(df: DataFrame, text_col: str = "text", out_col: str = "sketch", scale: int = SCALE) -> DataFrame:
    return df.withColumn(out_col, sketch(F.col(text_col), scale))


def next_ids(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each distinct id and the next one in descending order; the last is followed by the first.

    Ids are range-partitioned and written, so that the partition of each is fixed; only the highest id of each partition,
    a row a partition, is brought together.
    """
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    parts = shards_for(ids.count(), ORDER_ROWS)
    placed = staged(ids.repartitionByRange(parts, F.col("id").desc()).select("id", F.spark_partition_id().alias("part")), "ordered-ids")
    tops = placed.groupBy("part").agg(F.max("id").alias("top"))
    after = tops.select("part", F.coalesce(F.lead("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy(F.lit(0)))).alias("after"))
    inside = placed.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id"))))
    return inside.join(F.broadcast(after), "part").select(F.col("id").alias(id_col), F.coalesce("next_id", "after").alias("next_id"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text, sketch, and of the next document its sketch and as many characters as half of the longest text of the id has.

    One exchange of texts by id serves both sides; what comes from the next document moves as the part that is needed.
    """
    docs = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    named = docs.where(F.col(id_col).isNotNull())  # the same rows and columns on both sides, or the exchange is made twice
    halves = named.groupBy(id_col).agg(F.max(half).alias("half"))
    pairs = next_ids(df, id_col).join(halves, id_col).select(F.col(id_col).alias("to_id"), F.col("next_id").alias(id_col), "half")
    made = named.select(id_col, "text", sketch(F.col("text")).alias("sketch"))
    told = F.struct(F.xxhash64("text").alias("v"), F.substring("text", F.lit(1), F.col("half")).alias("part"), F.col("sketch"))
    sent = made.join(pairs, id_col).groupBy(id_col, "to_id").agg(F.min(told).alias("one"))  # a row for each id, however often it stands
    sent = sent.select(F.col("to_id").alias(id_col), F.col("one.part").alias("next_part"), F.col("one.sketch").alias("next_sketch"))
    out = made.join(sent, id_col, "left")
    lone = docs.where(F.col(id_col).isNull()).select(id_col, "text", sketch(F.col("text")).alias("sketch"))
    return out.unionByName(lone, allowMissingColumns=True)
