"""Screening of a corpus: candidates linked by similar titles, and criteria as ordered rules of which the first that speaks is kept.

Titles count as sets of terms. Equal sets are one before any pair is made; sets that share ``similarity`` of their terms share one of their
rarest terms, so these are the keys by which pairs meet (prefix filtering, which misses none), and only then sets are compared.

Defined cases: a null title or one without terms is linked with nothing and is left out as untitled; a candidate is a duplicate if
a linked one has a lesser id, whatever becomes of that one; repeated rows of an id are one candidate each and not duplicates of each
other; a null date passes no date rule but the missing-date one; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def linked_titles(candidates: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(title_key, least_id): of each set of terms the least id of a candidate (cand_id, title) with an equal or similar one."""
    terms = F.array_sort(F.array_distinct(X.tokens(F.col("title"))))
    keyed = candidates.select("cand_id", terms.alias("ts")).where(F.size("ts") > 0)
    sets = keyed.groupBy("ts").agg(F.min("cand_id").alias("own_id")).withColumn("title_key", F.array_join("ts", " "))
    each = sets.select("title_key", F.size("ts").alias("n"), F.explode("ts").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    ranked = each.join(df, "term").groupBy("title_key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("by_df"))
    # two sets of a and b terms, a <= b, that share t of their union share t of b at least
    prefix = F.slice("by_df", F.lit(1), F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1)
    keys = ranked.select("title_key", "n", F.explode(F.transform(prefix, lambda x: x["term"])).alias("term"))
    a, b = (keys.toDF(f"{s}_key", f"{s}_n", "term") for s in ("a", "b"))
    pairs = a.join(b, "term").where((F.col("a_key") < F.col("b_key")) & (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n"))).select("a_key", "b_key").distinct()
    held = lambda s: sets.select(F.col("title_key").alias(f"{s}_key"), F.col("ts").alias(f"{s}_ts"), F.col("own_id").alias(f"{s}_id"))
    both = pairs.join(held("a"), "a_key").join(held("b"), "b_key")
    shared = F.size(F.array_intersect("a_ts", "b_ts"))
    near = both.where(shared >= similarity * (F.size("a_ts") + F.size("b_ts") - shared))
    ends = near.select(F.col("a_key").alias("title_key"), F.col("b_id").alias("least_id")).unionByName(near.select(F.col("b_key").alias("title_key"), F.col("a_id").alias("least_id"))).unionByName(sets.select("title_key", F.col("own_id").alias("least_id")))
    return ends.groupBy("title_key").agg(F.min("least_id").alias("least_id"))


def screened(candidates: DataFrame, rules: list[tuple[str, Column]], similarity: float = 0.8) -> DataFrame:
    """Candidates (cand_id, title and what the rules read) with ``reason``: untitled, duplicate, or the first of ``rules`` (name, condition that
    leaves out) that holds; null for those that stay."""
    key = F.array_join(F.array_sort(F.array_distinct(X.tokens(F.coalesce("title", F.lit(""))))), " ")
    found = candidates.withColumn("title_key", key).join(linked_titles(candidates, similarity), "title_key", "left")
    reason = F.when(F.col("title_key") == "", "untitled").when(F.col("least_id") < F.col("cand_id"), "duplicate")
    for name, out in rules:
        reason = reason.when(F.coalesce(out, F.lit(False)), name)
    return found.withColumn("reason", reason).drop("title_key", "least_id")


def funnel(rows: DataFrame, by: str = "source", date: str = "date") -> DataFrame:
    """Candidates by source and reason, with their first and last dates."""
    return rows.groupBy(by, F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
