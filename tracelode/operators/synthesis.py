"""Claims and their support, gaps, the trace graph, the priority index and its sensitivity, frozen inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, NOT_ADDRESSED
from .metrics import six


def verified_only(records: DataFrame) -> DataFrame:
    """Only accepted records without an open adjudication may feed a synthesis."""
    return records.where((F.col("decision") == "accept") & ~F.coalesce(F.col("adjudication_required"), F.lit(True)))


def claim_support(claims: DataFrame, blocks: DataFrame, least: int = CONFIG.min_evidence) -> DataFrame:
    """Distinct existing evidence and documents behind each claim, counter-evidence, and what is unmet."""
    base = claims.select("claim_id", F.array_distinct("supporting").alias("s"), F.size(F.array_distinct(F.coalesce("contradicting", F.array().cast("array<string>")))).alias("n_contradicting"))
    cited = base.select("claim_id", F.explode_outer("s").alias("evidence_id"))
    found = cited.join(blocks.select("evidence_id", "doc_id"), "evidence_id", "left").groupBy("claim_id").agg(F.count("doc_id").alias("n_evidence"), F.count_distinct("doc_id").alias("n_docs"), F.count_if(F.col("evidence_id").isNotNull() & F.col("doc_id").isNull()).alias("n_dangling"))
    return found.join(base.select("claim_id", "n_contradicting"), "claim_id").withColumn("enough_evidence", F.col("n_evidence") >= least).withColumn("single_document", F.col("n_docs") <= 1)


def universal_gap(records: DataFrame) -> DataFrame:
    """Dimensions that no document addresses."""
    return records.groupBy("dimension").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("label") == NOT_ADDRESSED, F.lit(False))).alias("is_gap")).where("is_gap").drop("is_gap")


def trace_edges(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges claim -> block -> document."""
    cited = claims.select("claim_id", F.explode(F.array_distinct("supporting")).alias("evidence_id"))
    first = cited.select(F.col("claim_id").alias("src_id"), F.lit("claim").alias("src_kind"), F.col("evidence_id").alias("dst_id"), F.lit("block").alias("dst_kind"), F.lit("supported_by").alias("relation"))
    used = blocks.join(cited.select("evidence_id").distinct(), "evidence_id", "left_semi")
    second = used.select(F.col("evidence_id").alias("src_id"), F.lit("block").alias("src_kind"), F.col("doc_id").alias("dst_id"), F.lit("document").alias("dst_kind"), F.lit("part_of").alias("relation"))
    return first.unionByName(second)


def trace(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each claim with the documents that it rests on: two joins, no recursion."""
    cited = claims.select("claim_id", F.explode(F.array_distinct("supporting")).alias("evidence_id"))
    return cited.join(blocks.select("evidence_id", "doc_id"), "evidence_id").groupBy("claim_id", "doc_id").agg(F.count("*").alias("n_blocks"))


def scarcity(records: DataFrame) -> DataFrame:
    """1 less the share of assessed documents with a positive label, by direction (ours)."""
    return records.groupBy("direction").agg(six(1 - F.avg(F.col("positive").cast("double"))).alias("esi"))


def momentum(years: DataFrame) -> DataFrame:
    """Slope of the yearly share, scaled to 0..1 over directions (ours): (direction, year, share)."""
    slope = years.groupBy("direction").agg(F.coalesce(F.regr_slope("share", "year"), F.lit(0.0)).alias("b"))
    w = Window.partitionBy(F.lit(0))
    low, high = F.min("b").over(w), F.max("b").over(w)
    return slope.withColumn("tgm", six(F.when(high > low, (F.col("b") - low) / (high - low)).otherwise(0.5))).drop("b")


def integration(scores: DataFrame) -> DataFrame:
    """Mean of 0..3 scores over 3 (ours)."""
    return scores.groupBy("direction").agg(six(F.avg("score") / 3).alias("lci"))


def frdi(components: DataFrame, weights: DataFrame) -> DataFrame:
    """w1 * scarcity + w2 * momentum + w3 * integration for each scheme and year basis, with ranks; weights must sum to 1.

    A missing component leaves the index missing, ranked last.
    """
    bad = weights.where(F.abs(F.col("w1") + F.col("w2") + F.col("w3") - 1) > 1e-9).count()
    if bad:
        raise ValueError("weights of a scheme don't sum to 1")
    value = six(F.col("w1") * F.col("esi") + F.col("w2") * F.col("tgm") + F.col("w3") * F.col("lci"))
    out = components.crossJoin(F.broadcast(weights)).withColumn("frdi", value)
    return out.withColumn("rank", F.rank().over(Window.partitionBy("scheme", "year_basis").orderBy(F.desc_nulls_last("frdi"))))


def frdi_sensitivity(scored: DataFrame) -> DataFrame:
    """Over all scenarios: highest and lowest rank, scenarios led and scenarios closed, by direction."""
    w = Window.partitionBy("scheme", "year_basis")
    return scored.withColumn("last", F.max("rank").over(w)).groupBy("direction").agg(F.count("*").alias("n_scenarios"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.count_if(F.col("rank") == 1).alias("n_first"), F.count_if(F.col("rank") == F.col("last")).alias("n_last"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties by their mean rank."""
    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    return pairs.select(mean_rank(a).alias("x"), mean_rank(b).alias("y")).agg(six(F.corr("x", "y")).alias("rho"))


def figure_data(matrix: DataFrame, dimensions: tuple[str, ...] = CONFIG.dimensions) -> DataFrame:
    """Label counts by dimension from a label matrix, in long form, as a heat map reads them."""
    long = matrix.unpivot(["doc_id"], list(dimensions), "dimension", "label")
    return long.groupBy("dimension", F.coalesce("label", F.lit("not_produced")).alias("label")).agg(F.count("*").alias("n"))


def row_digest(columns: list[str]) -> Column:
    """The leading 60 bits of a row's hash, as a number whose sums don't depend on the order of rows."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def sixty_bits(total: Column) -> Column:
    return F.pmod(F.coalesce(total, F.lit(0).cast("decimal(38,0)")), F.lit(1 << 60).cast("decimal(38,0)")).cast("long")


def freeze(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and one hash that doesn't depend on their order: of each row's hash the sum of the leading 60 bits, modulo 2**60."""
    return df.agg(F.count("*").alias("n_rows"), sixty_bits(F.sum(row_digest(columns))).alias("digest"))


def verify(df: DataFrame, columns: list[str], frozen: DataFrame) -> DataFrame:
    """Whether the table is still the one that was frozen."""
    return freeze(df, columns).crossJoin(frozen.select(F.col("n_rows").alias("rows_then"), F.col("digest").alias("digest_then"))).withColumn("unchanged", (F.col("n_rows") == F.col("rows_then")) & (F.col("digest") == F.col("digest_then")))


def freeze_tree(df: DataFrame, key: str, columns: list[str], width: int = 16, fan: int = 8, levels: int = 4) -> DataFrame:
    """A tree of digests by ranges of a whole-number key: (level, range_no, n_rows, digest). Level 0 are ranges of ``width`` keys, a range of the next
    level is ``fan`` of them, and so on. A parent's digest is the sum of its children's, so the table is read once, and changes add up."""
    node = df.groupBy(F.floor(F.col(key) / width).cast("long").alias("range_no")).agg(F.count("*").alias("n_rows"), sixty_bits(F.sum(row_digest(columns))).alias("digest"))
    out = node.select(F.lit(0).alias("level"), "*")
    for level in range(1, levels):
        step = fan**level
        node_up = node.groupBy(F.floor(F.col("range_no") / step).cast("long").alias("range_no")).agg(F.sum("n_rows").alias("n_rows"), sixty_bits(F.sum(F.col("digest").cast("decimal(38,0)"))).alias("digest"))
        out = out.unionByName(node_up.select(F.lit(level).alias("level"), "*"))
    return out


def advanced(tree: DataFrame, gone: DataFrame, came: DataFrame, key: str, columns: list[str], width: int = 16, fan: int = 8, levels: int = 4) -> DataFrame:
    """The tree after some rows have gone and others have come, from those rows alone."""
    less = freeze_tree(gone, key, columns, width, fan, levels).select("level", "range_no", (-F.col("n_rows")).alias("n_rows"), (-F.col("digest")).alias("digest"))
    every = tree.unionByName(less).unionByName(freeze_tree(came, key, columns, width, fan, levels))
    return every.groupBy("level", "range_no").agg(F.sum("n_rows").alias("n_rows"), sixty_bits(F.sum(F.col("digest").cast("decimal(38,0)"))).alias("digest")).where("n_rows > 0")


def changed_ranges(then: DataFrame, now: DataFrame, fan: int = 8, levels: int = 4) -> DataFrame:
    """Ranges of level 0 that two trees don't agree on: (range_no, rows_then, rows_now). From the top down only children of differing ranges are compared."""
    differ = None
    for level in range(levels - 1, -1, -1):
        a, b = (t.where(F.col("level") == level).select("range_no", F.col("n_rows").alias(f"rows_{n}"), F.col("digest").alias(f"digest_{n}")) for t, n in ((then, "then"), (now, "now")))
        if differ is not None:
            above = differ.select(F.col("range_no").alias("above"))
            a, b = (x.join(above, F.floor(F.col("range_no") / fan) == F.col("above"), "left_semi") for x in (a, b))
        both = a.join(b, "range_no", "full_outer")
        differ = both.where(~(F.col("rows_then").eqNullSafe(F.col("rows_now")) & F.col("digest_then").eqNullSafe(F.col("digest_now"))))
    return differ.select("range_no", F.coalesce("rows_then", F.lit(0)).alias("rows_then"), F.coalesce("rows_now", F.lit(0)).alias("rows_now"))


def changed_rows(then: DataFrame, now: DataFrame, ranges: DataFrame, key: str, columns: list[str], width: int = 16) -> DataFrame:
    """Keys that have gone, come or changed, looked for in the given ranges alone: (key, change)."""
    def of(df: DataFrame, name: str) -> DataFrame:
        inside = df.withColumn("range_no", F.floor(F.col(key) / width).cast("long")).join(ranges.select("range_no"), "range_no", "left_semi")
        return inside.groupBy(key).agg(sixty_bits(F.sum(row_digest(columns))).alias(name))

    both = of(then, "then").join(of(now, "now"), key, "full_outer")
    change = F.when(F.col("then").isNull(), "came").when(F.col("now").isNull(), "gone").when(F.col("then") != F.col("now"), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "change")


def reach(edges: DataFrame, roots: DataFrame, hops: int, stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Nodes within so many hops of each root over typed edges (src_id, src_kind, dst_id, dst_kind): (root_id, node_id, kind, hop), the fewest hops.

    ``roots`` are (node_id, kind). Every hop is a join with what the last one reached for the first time, so cycles end.
    """
    front = roots.select(F.col("node_id").alias("root_id"), "node_id", "kind", F.lit(0).alias("hop")).distinct()
    seen = front
    for hop in range(1, hops + 1):
        step = front.join(edges.select(F.col("src_id").alias("node_id"), F.col("src_kind").alias("kind"), "dst_id", "dst_kind"), ["node_id", "kind"])
        step = step.select("root_id", F.col("dst_id").alias("node_id"), F.col("dst_kind").alias("kind")).distinct().join(seen, ["root_id", "node_id", "kind"], "left_anti")
        front = stage(step.withColumn("hop", F.lit(hop)), f"hop-{hop}")
        seen = seen.unionByName(front)
    return seen


def loose_ends(nodes: DataFrame, edges: DataFrame, reached: DataFrame, goal: str) -> DataFrame:
    """Nodes (node_id, kind) that are at fault: orphans, which no edge leads to and no root is, and dead ends, roots that reach no ``goal``."""
    roots = reached.where("hop = 0").select("node_id", "kind")
    led = edges.select(F.col("dst_id").alias("node_id"), F.col("dst_kind").alias("kind"))
    orphans = nodes.join(led.unionByName(roots), ["node_id", "kind"], "left_anti").withColumn("fault", F.lit("orphan"))
    there = reached.where(F.col("kind") == goal).select(F.col("root_id").alias("node_id"))
    return orphans.unionByName(roots.join(there, "node_id", "left_anti").withColumn("fault", F.lit("dead end")))
