"""Lexical and dense indexes, their ranked lists and fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ARMS, CONFIG, CONTROLS, Config
from ..functions import text as X
from ..functions import vectors as V
from ..sources.tables import staged
from . import chunking as C
from . import protocol as P
from .dense import cosine_topk

#: Rows of a side that is broadcast, at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 10_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(blocks: DataFrame, id_col: str = "evidence_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf)."""
    return blocks.select(F.col(id_col).alias("id"), F.explode(X.tokens(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))


def doc_lengths(blocks: DataFrame, id_col: str = "evidence_id", text_col: str = "text") -> DataFrame:
    return blocks.select(F.col(id_col).alias("id"), F.size(X.tokens(F.col(text_col))).alias("len"))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column, variant: str = CONFIG.bm25_variant) -> Column:
    if variant == "smoothed":
        return F.log(1 + (n - df + 0.5) / (df + 0.5))
    if variant == "plain":
        return F.log((n - df + 0.5) / (df + 0.5))
    raise ValueError(f"unknown variant {variant}")


def bm25_topk(queries: DataFrame, blocks: DataFrame, k: int = CONFIG.top_k, id_col: str = "evidence_id", text_col: str = "text", config: Config = CONFIG) -> DataFrame:
    """(query_id, id, score, rank) of the best blocks for each query (query_id, text).

    Terms that no query has leave the index before anything is counted or shuffled: blocks are tokenised, filtered by the
    query's terms (broadcast where they are few) and only then grouped. Corpus totals need one more pass over lengths. A repeated query
    term counts once. Scores are rounded before ranking, ties go by id.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    sized = blocks.select(F.col(id_col).alias("id"), X.tokens(F.col(text_col)).alias("ts"))
    totals = sized.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    hits = sized.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(small_side(wanted), "term", "left_semi")
    hits = hits.groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = terms.join(df, "term").crossJoin(F.broadcast(totals))
    weight = scored.select("query_id", "term", idf(F.col("n"), F.col("df"), config.bm25_variant).alias("idf"), "avgdl")
    norm = config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("len") / F.col("avgdl"))
    rows = hits.join(weight, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * F.col("tf") * (config.bm25_k1 + 1) / (F.col("tf") + norm)), 6).alias("score"))
    return top(rows, k)


def overlap_topk(queries: DataFrame, blocks: DataFrame, k: int = CONFIG.top_k, id_col: str = "evidence_id", text_col: str = "text") -> DataFrame:
    """A plain lexical channel: how many distinct terms of a query a block has."""
    terms = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    held = blocks.select(F.col(id_col).alias("id"), F.explode(X.tokens(F.col(text_col))).alias("term")).join(small_side(terms.select("term").distinct()), "term", "left_semi").distinct()
    return top(held.join(terms, "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def rrf_fusion(channels: list[DataFrame], k: int = CONFIG.rrf_k, top_k: int | None = None) -> DataFrame:
    """Reciprocal ranks (query_id, id, rank) summed over channels; an id twice in a channel counts by its best rank."""
    every = None
    for i, c in enumerate(channels):
        one = c.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).withColumn("channel", F.lit(i))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.count("*").alias("n_channels"))
    return top(fused, top_k) if top_k else top(fused, 2**31 - 1)


def weighted_fusion(channels: list[tuple[DataFrame, float]], top_k: int) -> DataFrame:
    """Scores scaled to 0..1 within query and channel, then summed by weight."""
    every = None
    for c, weight in channels:
        w = Window.partitionBy("query_id")
        span = F.max("score").over(w) - F.min("score").over(w)
        one = c.select("query_id", "id", (F.when(span > 0, (F.col("score") - F.min("score").over(w)) / span).otherwise(1.0) * weight).alias("score"))
        every = one if every is None else every.unionByName(one)
    return top(every.groupBy("query_id", "id").agg(F.round(F.sum("score"), 8).alias("score")), top_k)


def metadata_filter(blocks: DataFrame, **equal) -> DataFrame:
    """Keep rows whose columns have the given value, or one of several; plain comparisons, so that the scan takes them."""
    for name, value in equal.items():
        blocks = blocks.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return blocks


class HybridIndex:
    """Blocks (evidence_id, doc_id, ord, text, n_words) with a lexical and a dense channel."""

    def __init__(self, blocks: DataFrame, config: Config = CONFIG, embed=None):
        self.blocks, self.config, self.source = blocks, config, blocks
        self.embed = embed or (lambda t: V.hashed_terms(t, config.dense_dim))

    def bm25(self, queries: DataFrame, k: int, blocks: DataFrame) -> DataFrame:
        return bm25_topk(queries, blocks, k, config=self.config)

    def dense(self, queries: DataFrame, k: int, blocks: DataFrame) -> DataFrame:
        vectors = blocks.select(F.col("evidence_id").alias("id"), self.embed(F.col("text")).alias("v"))
        return cosine_topk(queries.select(F.col("query_id").cast("string").alias("query_id"), self.embed(F.col("text")).alias("v")), vectors, k)

    def hybrid_search(self, queries: DataFrame, filters: dict | None = None, k: int | None = None, channel: str = "hybrid") -> DataFrame:
        """(query_id, id, score, rank) after metadata filters, both channels and fusion."""
        k = k or self.config.top_k
        blocks = metadata_filter(self.blocks, **(filters or {}))
        queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
        if channel == "bm25":
            return self.bm25(queries, k, blocks)
        if channel == "dense":
            return self.dense(queries, k, blocks)
        return rrf_fusion([self.bm25(queries, k, blocks), self.dense(queries, k, blocks)], self.config.rrf_k, k).drop("n_channels")

    def context(self, queries: DataFrame, filters: dict | None = None, k: int | None = None) -> DataFrame:
        """Hits, their neighbours and the windows that fit each budget."""
        return self.assembled(self.hybrid_search(queries, filters, k), self.blocks)

    def assembled(self, hits: DataFrame, blocks: DataFrame) -> DataFrame:
        placed = hits.join(blocks.select(F.col("evidence_id").alias("id"), "doc_id", "ord"), "id")
        near = C.neighbor_expand(placed, blocks, self.config.neighbor_radius)
        best = placed.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
        ranked = near.join(best, ["query_id", "doc_id"]).join(blocks.select("evidence_id", F.col("n_words").alias("n_tokens")), "evidence_id")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "distance", "doc_id", "ord")))
        return C.context_windows(ranked, blocks, self.config.context_budgets)


def dimension_pass(index: HybridIndex, dimensions: DataFrame, k: int = CONFIG.top_k, filters: dict | None = None) -> DataFrame:
    """One query a dimension (dimension, text), all in one job: (dimension, id, score, rank)."""
    found = index.hybrid_search(dimensions.select(F.col("dimension").alias("query_id"), "text"), filters, k)
    return found.withColumnRenamed("query_id", "dimension")


#: What stands for a query where a document is read for all of them at once.
EVERY = "all"


def ablation_matrix(index: HybridIndex, queries: DataFrame, k: int = CONFIG.top_k, a: str = "dry_run", b: str = "dry_run", options_a: dict | None = None, options_b: dict | None = None) -> DataFrame:
    """What each arm reads and what its agents say of it: a row an arm, step, query, document and pass.

    Steps: ``direct`` is a document as it is, without retrieval (under a budget in the arm's control); ``retrieval`` a hit of a query, in all of its reading
    windows; ``coverage`` all reading windows of every document, which arms with the coverage pass read besides their hits. Direct and coverage steps
    are asked for all queries at once (no query_id, no rank). The first agent extracts in every arm; the critic arm goes through review, revision and last
    review, its control ends after one review. A document without a word has no windows, and is read by the direct arm alone.

    A channel is searched once and a call made once, whatever number of arms share it.
    """
    if index.source is None:
        raise ValueError("arms need the blocks with their texts")
    lists = {c: staged(index.hybrid_search(queries, k=k, channel=c), f"arm-{c}") for c in ("bm25", "dense")}  # each is searched once; ``k`` rows a query
    lists["hybrid"] = staged(rrf_fusion(list(lists.values()), index.config.rrf_k, k).drop("n_channels"), "arm-hybrid")
    docs = index.source.select(F.col("evidence_id").alias("doc_id"), "text")
    windows = staged(C.text_windows(docs), "arm-windows")

    def log(contexts: DataFrame, passes: int, dimensions: tuple[str, ...] | None = None, stage: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
        return P.four_passes(contexts, a, b, stage, options_a, options_b, dimensions=dimensions, passes=passes)

    def written(df: DataFrame, name: str) -> DataFrame:
        """Contexts that lie in files already are not written once more."""
        return df if name == "windows" else staged(df, name)

    def read(pairs: DataFrame) -> DataFrame:
        return windows.join(small_side(pairs.withColumnRenamed("id", "doc_id").withColumnRenamed("query_id", "dimension")), "doc_id")

    reviewed = lists["hybrid"].select("query_id", "id")
    others = lists["bm25"].unionByName(lists["dense"]).select("query_id", "id").distinct().join(reviewed, ["query_id", "id"], "left_anti")
    hits = log(read(reviewed), 4).unionByName(log(read(others), 1))
    logs = {"direct": log(docs, 1, (EVERY,), written), "budget": log(C.text_starts(docs), 1, (EVERY,)), "coverage": log(windows, 4, (EVERY,), written)}
    columns = ("label", "decision", "state", "n_windows", "n_unread", "failure_reason", "input_hash")
    out = None
    for arm, coverage, channel, critic in (*ARMS, *CONTROLS):
        mode = "A-only" if not critic else "A+B" if arm == "G5-round" else "A+B+A+B"
        steps = []
        if channel in lists:
            ranks = lists[channel].select("query_id", "id", "rank")
            steps.append(("retrieval", hits.withColumnsRenamed({"dimension": "query_id", "doc_id": "id"}).join(ranks, ["query_id", "id"])))
        for name in [x for x in (channel, "coverage" if coverage else None) if x in logs]:
            whole = logs[name].withColumn("query_id", F.lit(None).cast("string")).withColumn("rank", F.lit(None).cast("int")).withColumnRenamed("doc_id", "id")
            steps.append(("coverage" if name == "coverage" else "direct", whole))
        for step, rows in steps:
            one = P.up_to_pass(rows, mode).select(F.lit(arm).alias("arm"), F.lit(step).alias("step"), "query_id", "id", "rank", F.lit(coverage).alias("coverage"), F.lit(critic).alias("critic"), "pass", "agent", *columns)
            out = one if out is None else out.unionByName(one)
    return out


def retrieval_manifest(ranked: DataFrame, run_id: str, channel: str, config: Config = CONFIG) -> DataFrame:
    params = F.create_map(F.lit("config_sha256"), F.lit(config.digest()), F.lit("version"), F.lit(config.version))
    return ranked.select(F.lit(run_id).alias("run_id"), F.col("query_id").cast("string").alias("query_id"), F.lit(channel).alias("channel"), F.col("id").cast("string").alias("evidence_id"), "score", "rank", params.alias("params"))


def qa_context(ranked: DataFrame, blocks: DataFrame, most: int = CONFIG.qa_blocks) -> DataFrame:
    """What an outside question answerer is sent: at most so many blocks without layout risk."""
    safe = blocks.where(~F.col("formula_layout_risk")).select(F.col("evidence_id").alias("id"), "text")
    kept = ranked.join(safe, "id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return kept.where(F.col("place") <= most)
