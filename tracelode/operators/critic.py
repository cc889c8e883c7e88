"""The seven checks of a review as one rule table: a row a record and check.

A record cites a block and a span of its document. Spans find their block by a join on buckets of characters, never by range.
What a label claims is held against the text of the cited block by rules (label, check_name, must, must_not), patterns of which
either may be null. Counter-evidence is a block of the same document other than the cited one that matches a label's ``counter``
rule; it is searched once a document and label, in documents that have records alone.

Defined cases: a label without a rule for a check passes it as not applicable; a record whose block does not exist fails
every applicable check; repeated records are one; a null document or span is not found; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The checks, in their order. The second to sixth and the first go by rules on the cited text.
CHECKS = ("entailment", "direction", "equation", "temporal", "endpoint", "evidence", "contradiction")
BY_TEXT = CHECKS[:5]
BUCKET = 2_000


def spans_to_blocks(spans: DataFrame, blocks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For spans (record_id, doc_id, char_start, char_end): the blocks that hold them whole, as (record_id, found_id, quoted)."""
    touched = F.sequence(F.floor(F.col("b.char_start") / bucket), F.floor(F.greatest(F.col("b.char_end") - 1, F.col("b.char_start")) / bucket))
    placed = blocks.alias("b").select("b.doc_id", F.col("evidence_id").alias("found_id"), F.col("char_start").alias("from"), F.col("char_end").alias("to"), "text", F.explode(touched).alias("bucket"))
    asked = spans.select("record_id", "doc_id", "char_start", "char_end", F.floor(F.col("char_start") / bucket).alias("bucket"))
    inside = asked.join(placed, ["doc_id", "bucket"]).where((F.col("from") <= F.col("char_start")) & (F.col("char_end") <= F.col("to")))
    return inside.select("record_id", "found_id", X.slice_text(F.col("text"), F.col("char_start") - F.col("from"), F.col("char_end") - F.col("from")).alias("quoted"))


def counter_evidence(records: DataFrame, blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, label, counter_ids): blocks that speak against a label which the document was given."""
    pairs = records.select("doc_id", "label").distinct().join(rules.where("check_name = 'contradiction'").select("label", F.col("must_not").alias("counter")), "label")
    text = blocks.select("doc_id", "evidence_id", "text").join(records.select("doc_id").distinct(), "doc_id", "left_semi")
    return text.join(pairs, "doc_id").where(F.rlike("text", F.col("counter"))).groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("evidence_id")).alias("counter_ids"))


def critic_checks(records: DataFrame, blocks: DataFrame, rules: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(record_id, check_name, applicable, passed) for records (record_id, doc_id, label, evidence_id, char_start, char_end, quote)
    against blocks (doc_id, evidence_id, char_start, char_end, text)."""
    once = records.select("record_id", "doc_id", "label", "evidence_id", "char_start", "char_end", "quote").distinct()
    cited = once.join(blocks.select("evidence_id", F.col("doc_id").alias("block_doc"), F.col("text").alias("cited")), "evidence_id", "left")
    own = F.coalesce(F.col("block_doc") == F.col("doc_id"), F.lit(False))
    # rules as one row a label: a column a check, so that no record is multiplied by them
    table = rules.groupBy("label").agg(*[F.first(F.when(F.col("check_name") == c, F.struct("must", "must_not")), ignorenulls=True).alias(c) for c in CHECKS])
    ruled = cited.join(table, "label", "left")

    def by_rule(check: str):
        rule = F.col(check)
        holds = F.coalesce(F.rlike("cited", rule["must"]), F.lit(True)) & ~F.coalesce(F.rlike("cited", rule["must_not"]), F.lit(False))
        return F.struct(F.lit(check).alias("check_name"), rule.isNotNull().alias("applicable"), (rule.isNull() | (own & holds)).alias("passed"))

    by_text = ruled.select("record_id", F.explode(F.array(*map(by_rule, BY_TEXT))).alias("c")).select("record_id", "c.*")
    found = spans_to_blocks(once, blocks, bucket)
    exact = once.select("record_id", "evidence_id", "quote").join(found, "record_id", "left")
    same = (F.col("found_id") == F.col("evidence_id")) & (F.col("quoted") == F.col("quote")) & (F.col("quote") != "")
    evidence = exact.groupBy("record_id").agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("passed")).select("record_id", F.lit("evidence").alias("check_name"), F.lit(True).alias("applicable"), "passed")
    against = once.select("record_id", "doc_id", "label", "evidence_id").join(counter_evidence(once, blocks, rules), ["doc_id", "label"], "left").join(table.select("label", F.col("contradiction").isNotNull().alias("applicable")), "label", "left")
    free = F.size(F.coalesce(F.array_remove("counter_ids", F.col("evidence_id")), F.array().cast("array<string>"))) == 0
    contradiction = against.select("record_id", F.lit("contradiction").alias("check_name"), F.coalesce("applicable", F.lit(False)).alias("applicable"), free.alias("passed"))
    return by_text.unionByName(evidence).unionByName(contradiction)
