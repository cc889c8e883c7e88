"""A persisted index: texts are read once, and searches read postings of their own terms and stored vectors.

Postings are rows of blocks: all that a term has in one block of documents, in folders by a hash of the term and sorted by term
within. A block holds about ``BLOCK`` documents of similar length, and its rows carry the greatest frequency and the least
length in them, which bound every score in it whatever the parameters are. A frequent term is as many rows as it has blocks, so
no key holds more than a block.

A search reads the folders of its terms and deals their rows by block. A task keeps the best ``k`` of each query that it has met;
in a block it opens postings only for queries whose bound, over all their terms, reaches the k-th score so far, and adds the products
of weights and postings to a matrix of queries and the block's documents. The result is exact, and only the best leave a task.

Defined cases: a null text has no postings and no length; a null id is left out of postings; ids are keys, rows that repeat one
are one document; queries without a known term have no rows; an empty table gives an empty index. Columns besides id and text are kept as metadata for
filters, under which all statistics are those of the documents that pass.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import CONFIG, Config
from ..functions import text as X
from ..sources.tables import exists, move, remove, staged
from . import dense
from .retrieval import HybridIndex, idf, metadata_filter, small_side, top

BLOCK = 128
#: Tokens from which on a task makes blocks of the documents that it holds.
GROUP = 2_000_000
#: Tokens of a folder of postings.
FOLDER_TOKENS = 4_000_000
FOLDERS = 4_096
#: Terms that are stated in the scan's filter, and weights of queries' terms that a task holds at once.
STATED, WEIGHTS = 1_000, 1_000_000
#: Scores are rounded to six digits before they are ranked, so bounds leave as much room.
MARGIN = 1e-5


def build(blocks: DataFrame, path: str, id_col: str = "evidence_id", text_col: str = "text", config: Config = CONFIG, embed=None) -> None:
    """Write the index of ``blocks`` below ``path``; ``stats`` is written last, so an index with it is whole.

    Texts are read once. Terms are counted where a text lies and put into blocks where its counts lie, so that what is exchanged are finished rows, once.
    """
    spark = blocks.sparkSession
    meta = [c for c in blocks.columns if c not in (id_col, text_col)]
    given = [embed(F.col(text_col)).alias("v")] if embed else []
    scanned = blocks.select(F.col(id_col).alias("evidence_id"), *meta, *given, X.tokens(F.col(text_col), config.token_pattern).alias("ts"))
    counted(scanned.select("evidence_id", *meta, F.size("ts").alias("len"), *[c for c in scanned.columns if c == "v"], "ts"), config.dense_dim).write.parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    n, avgdl, total = forward.agg(F.count("*"), F.avg("len"), F.sum("len")).first()
    folders = min(FOLDERS, 2 ** max(4, math.ceil(math.log2(max(1, (total or 0) / FOLDER_TOKENS)))))
    rows = in_blocks(one_row_an_id(forward.where("len > 0 AND evidence_id IS NOT NULL").select("evidence_id", "len", "terms", "tfs")))
    dealt = rows.withColumn("folder", folder(F.col("term"), folders)).hint("rebalance", "folder").sortWithinPartitions("folder", "term", "block")
    postings = F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lens").alias("len")).alias("postings")
    dealt.select("term", "block", "df", "max_tf", "min_len", postings, "folder").write.partitionBy("folder").parquet(f"{path}/postings")
    forward.drop("terms", "tfs").write.parquet(f"{path}/docs")
    remove(spark, f"{path}/forward")
    spark.createDataFrame([(n, avgdl, folders)], "n long, avgdl double, folders int").coalesce(1).write.parquet(f"{path}/stats")


def counted(tokens: DataFrame, dim: int) -> DataFrame:
    """Rows with tokens (ts) as rows with their distinct terms and counts (terms, tfs), and the vector of ``hashed_tokens`` where they have no other (v)."""
    told = "v" in tokens.columns
    kept = [c for c in tokens.columns if c != "ts"]
    schema = T.StructType([*[tokens.schema[c] for c in kept], *([] if told else [T.StructField("v", T.ArrayType(T.DoubleType()))]), *T._parse_datatype_string("terms array<string>, tfs array<int>")])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b.column(b.schema.get_field_index("ts"))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(ts), 0), np.int64)
            words = ts.flatten().dictionary_encode()
            known, doc = words.dictionary, np.repeat(np.arange(len(ts)), sizes)
            code = np.asarray(words.indices, np.int64)
            key, times = np.unique(doc * max(1, len(known)) + code, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(ts) + 1) * max(1, len(known))), pa.int32())
            made = [pa.ListArray.from_arrays(ends, known.take(pa.array(key % max(1, len(known))))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
            if not told:
                slot = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in known.to_pylist()], np.int64)
                spread = np.bincount(doc * dim + slot[code], minlength=len(ts) * dim).reshape(-1, dim).astype(float)
                size = np.sqrt((spread * spread).sum(axis=1))[:, None]
                flat = pa.array((spread / np.where(size > 0, size, 1)).ravel())
                made.insert(0, pa.ListArray.from_arrays(pa.array(np.arange(len(ts) + 1) * dim, pa.int32()), flat))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *[x.cast(f.type) for x, f in zip(made, list(types)[len(kept) :], strict=True)]], schema=types)

    return tokens.mapInArrow(run, schema)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Rows (evidence_id, len, terms, tfs) that repeat an id and a length as one, their counts added up. Where none does, no terms are moved."""
    keys = ["evidence_id", "len"]
    twice = staged(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-ids")
    if twice.isEmpty():
        return rows
    each = rows.join(twice, keys, "left_semi").select(*keys, F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x"))
    summed = each.groupBy(*keys, F.col("x.term").alias("term")).agg(F.sum("x.tf").cast("int").alias("tf"))
    listed = summed.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    return rows.join(twice, keys, "left_anti").unionByName(listed.select(*keys, F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs")))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Documents (evidence_id, len, terms, tfs) as rows of blocks (term, block, df, max_tf, min_len, ids, tfs, lens).

    A task takes some ``GROUP`` tokens of its documents at a time and cuts them, in the order of their lengths, into blocks of ``BLOCK``.
    """
    kind = rows.schema["evidence_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"term string, block string, df long, max_tf int, min_len int, ids array<{kind}>, tfs array<int>, lens array<int>")
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group = TaskContext.get().partitionId(), 0

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, length, terms, tfs = (x.chunk(0) for x in table.columns)
            length = np.asarray(length, np.int64)
            order = np.argsort(length, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = terms.flatten().dictionary_encode()
            n_blocks = -(-len(order) // BLOCK)
            at = np.repeat(place, np.asarray(pc.list_value_length(terms), np.int64))
            key = (np.asarray(words.indices, np.int64) * n_blocks + at // BLOCK) * BLOCK + at % BLOCK
            by = np.argsort(key)
            row, at, tf = key[by] // BLOCK, at[by], np.asarray(tfs.flatten(), np.int32)[by]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lens, ends = length[order][at].astype(np.int32), pa.array(np.r_[starts, len(row)], pa.int32())
            names = pa.array([f"{part}-{group}-{k}" for k in range(n_blocks)])
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(order[at])), pa.array(tf), pa.array(lens))]
            columns = [words.dictionary.take(pa.array(row[starts] // n_blocks)), names.take(pa.array(row[starts] % n_blocks)), pa.array(np.diff(np.r_[starts, len(row)])), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(lens, starts)), *lists]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, types, strict=True)], schema=types)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += pc.sum(b.column(1)).as_py()
            if size >= GROUP:
                yield made(held)
                held, size, group = [], 0, group + 1
        if held:
            yield made(held)

    return rows.mapInArrow(run, schema)


def opened(spark: SparkSession, path: str, source: DataFrame, **options) -> SearchIndex:
    """The index at ``path``; where there is none it is built aside and moved there as a whole."""
    if not exists(spark, f"{path}/stats/_SUCCESS"):
        aside = f"{path}-{uuid.uuid4().hex}"
        build(source, aside, **options)
        move(spark, aside, path)
    return SearchIndex(spark, path, source)


def folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


class SearchIndex(HybridIndex):
    """An index that ``build`` has written. ``source`` are the blocks with their texts, for contexts alone."""

    def __init__(self, spark: SparkSession, path: str, source: DataFrame | None = None, config: Config = CONFIG, embed=None):
        super().__init__(spark.read.parquet(f"{path}/docs"), config, embed)
        self.spark, self.path, self.source = spark, path, source
        self.n, self.avgdl, self.folders = spark.read.parquet(f"{path}/stats").first()

    def postings(self, terms: DataFrame) -> DataFrame:
        """Rows of the terms asked for: their folders are all that is read, and few terms are stated in the scan's filter."""
        folders = [r[0] for r in terms.select(folder(F.col("term"), self.folders)).distinct().collect()]  # ``FOLDERS`` numbers at most
        kind = self.blocks.schema["evidence_id"].dataType.simpleString()
        columns = f"term string, block string, df long, max_tf int, min_len int, postings array<struct<id: {kind}, tf: int, len: int>>, folder int"
        known = self.spark.read.schema(columns).parquet(f"{self.path}/postings").where(F.col("folder").isin(folders))
        stated = [r[0] for r in terms.limit(STATED + 1).collect()]
        return known.where(F.col("term").isin(stated)) if len(stated) <= STATED else known.join(small_side(terms), "term", "left_semi")

    def bm25(self, queries: DataFrame, k: int, blocks: DataFrame | None = None) -> DataFrame:
        terms = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text"), self.config.token_pattern))).alias("term"))
        found = self.postings(terms.select("term").distinct())
        n, avgdl = F.lit(self.n), F.lit(self.avgdl).cast("double")
        if blocks is not None and blocks is not self.blocks:
            found, n, avgdl = self._passing(found, blocks)
        df = found.groupBy("term").agg(F.sum("df").alias("df"))
        return self.ranked(found.withColumn("avgdl", avgdl), terms.join(df, "term").select("query_id", "term", idf(n, F.col("df"), self.config.bm25_variant).alias("idf")), k)

    def overlap(self, queries: DataFrame, k: int) -> DataFrame:
        """How many distinct terms of a query a document has."""
        terms = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text"), self.config.token_pattern))).alias("term"))
        found = self.postings(terms.select("term").distinct()).withColumn("avgdl", F.lit(None).cast("double"))
        return self.ranked(found, terms.withColumn("idf", F.lit(1.0)), k)

    def ranked(self, found: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """Weights (query_id, term, idf) against blocks, so many at once that a task can hold them."""
        weights = staged(weights, "weights")
        parts = -(-weights.count() // WEIGHTS)
        if parts <= 1:
            return top(self.scored(found, weights, k), k)
        part = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(parts))
        return top(reduce(DataFrame.unionByName, [self.scored(found, weights.where(part == i), k) for i in range(parts)]), k)

    def scored(self, found: DataFrame, weights: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each query that a task has met; without a mean length (avgdl) a term counts as it is."""
        rows = weights.collect()
        ids = sorted({r["query_id"] for r in rows})
        number = {q: i for i, q in enumerate(ids)}
        by_term: dict[str, list[tuple[int, float]]] = {}
        for r in rows:
            by_term.setdefault(r["term"], []).append((number[r["query_id"]], r["idf"]))
        held = self.spark.sparkContext.broadcast((ids, {t: (np.array([i for i, _ in x]), np.array([w for _, w in x])) for t, x in by_term.items()}))
        kinds = f"query_id {weights.schema['query_id'].dataType.simpleString()}, id {self.blocks.schema['evidence_id'].dataType.simpleString()}, score double"
        types = to_arrow_schema(T._parse_datatype_string(kinds))
        k1, norm = self.config.bm25_k1, self.config.bm25_b

        def part(tf: np.ndarray, length: np.ndarray, avgdl: float | None) -> np.ndarray:
            if avgdl is None:
                return np.ones(np.shape(tf))
            return tf * (k1 + 1) / (tf + k1 * (1 - norm + norm * length / avgdl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, of = held.value
            least = np.full(len(names), -np.inf)  # the k-th score of each query so far
            query, score, found_ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

            def block(rows: list[tuple]) -> None:
                nonlocal query, score, found_ids
                bound = np.zeros(len(names))
                for term, max_tf, min_len, avgdl, *_ in rows:
                    qs, w = of[term]
                    bound[qs] += np.maximum(w * part(max_tf, min_len, avgdl), 0)
                live = (bound > 0) & (bound >= least - MARGIN)
                if not live.any():
                    return
                docs: dict = {}
                places = [np.array([docs.setdefault(i, len(docs)) for i in r[4]]) for r in rows]
                slot = np.cumsum(live) - 1
                sums, seen = np.zeros((int(live.sum()), len(docs))), np.zeros((int(live.sum()), len(docs)), bool)
                for (term, _, _, avgdl, _, tf, length), at in zip(rows, places, strict=True):
                    qs, w = of[term]
                    keep = live[qs]
                    cells = np.ix_(slot[qs[keep]], at)
                    sums[cells] += np.outer(w[keep], part(tf, length, avgdl))
                    seen[cells] = True
                sums = np.round(sums, 6)
                q, at = np.nonzero(seen & (sums >= least[live][:, None] - MARGIN))
                query, score = np.r_[query, np.flatnonzero(live)[q]], np.r_[score, sums[q, at]]
                found_ids = np.r_[found_ids, np.array(list(docs), object)[at]]
                order = np.unique(found_ids, return_inverse=True)[1] if len(found_ids) else np.zeros(0, np.int64)
                kept = dense.best(query, score, order, k)
                query, score, found_ids = query[kept], score[kept], found_ids[kept]
                full = np.flatnonzero(np.bincount(query, minlength=len(names)) == k)
                low = np.full(len(names), np.inf)
                np.minimum.at(low, query, score)
                least[full] = low[full]

            rows, last = [], None
            for b in batches:
                lists = b.column(b.schema.get_field_index("postings"))
                ends, flat = np.asarray(lists.offsets), lists.values
                ids_, tf, length = flat.field("id").to_pylist(), flat.field("tf").to_numpy().astype(float), flat.field("len").to_numpy().astype(float)
                columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "term", "max_tf", "min_len", "avgdl")]
                for i, (name, term, max_tf, min_len, avgdl) in enumerate(zip(*columns, strict=True)):
                    if name != last and rows:
                        block(rows)
                        rows = []
                    last = name
                    if term in of:
                        x, z = ends[i], ends[i + 1]
                        rows.append((term, max_tf, min_len, avgdl, ids_[x:z], tf[x:z], length[x:z]))
            if rows:
                block(rows)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query.tolist()], types.field(0).type), pa.array(found_ids.tolist(), types.field(1).type), pa.array(score)], names=types.names)

        dealt = found.select("block", "term", "max_tf", "min_len", "avgdl", "postings").repartition("block").sortWithinPartitions("block")
        return dealt.mapInArrow(run, kinds)

    def _passing(self, found: DataFrame, blocks: DataFrame) -> tuple[DataFrame, Column, Column]:
        """Postings of the documents that pass a filter, and the statistics of those."""
        n, avgdl = blocks.agg(F.count("*"), F.avg("len")).first()
        each = found.select("term", "block", F.explode("postings").alias("p")).join(blocks.select(F.col("evidence_id").alias("__id")), F.col("p.id") == F.col("__id"), "left_semi")
        kept = each.groupBy("term", "block").agg(F.count("*").alias("df"), F.max("p.tf").alias("max_tf"), F.min("p.len").alias("min_len"), F.collect_list("p").alias("postings"))
        return kept, F.lit(n), F.lit(avgdl).cast("double")

    def dense(self, queries: DataFrame, k: int, blocks: DataFrame | None = None) -> DataFrame:
        vectors = (self.blocks if blocks is None else blocks).select(F.col("evidence_id").alias("id"), "v")
        return dense.cosine_topk(queries.select(F.col("query_id").cast("string").alias("query_id"), self.embed(F.col("text")).alias("v")), vectors, k)

    def context(self, queries: DataFrame, filters: dict | None = None, k: int | None = None) -> DataFrame:
        if self.source is None:
            raise ValueError("contexts need the blocks with their texts")
        return self.assembled(self.hybrid_search(queries, filters, k), metadata_filter(self.source, **(filters or {})))
