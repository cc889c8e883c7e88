"""Exact nearest vectors by blocks: one matrix product a pair of blocks, and bounded lists of the best that are merged.

Vectors and queries are packed into rows of many, so that what is joined are blocks and never single vectors. A task keeps the
best ``k`` of each query that it has met; only these leave it. Scores are rounded before they are ranked, ties go by id.
Defined cases: zero vectors, vectors with null or non-finite components and those of another length than a query match nothing;
a repeated id counts once a row; an empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block at most, and its bytes; queries whose best a task remembers at once.
VECTORS, QUERIES, BYTES, HELD = 1024, 1024, 1 << 20, 65_536


def packed(df: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    """Blocks (dim, ids, data): unit vectors in double precision, of one length a block."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vs = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids]), pa.array([np.array(vs).tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not v.is_valid or v.values.null_count or not len(v):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.sqrt(x @ x)
                if not np.isfinite(size) or size == 0:
                    continue
                ids, vs = held.setdefault(len(x), ([], []))
                ids.append(i)
                vs.append(x / size)
                if len(ids) == max(1, min(rows, BYTES // (8 * len(x)))):
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return df.select(id_col, F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, f"dim int, ids array<{kind.simpleString()}>, data binary")


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each query, by falling score, then by id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """(query_id, id, score, rank): every query (query_id, v) against every vector (id, v)."""
    asked = packed(queries, "query_id", "v", QUERIES).toDF("q_dim", "q_ids", "q_data")
    pairs = packed(vectors, "id", "v", VECTORS).crossJoin(asked).where("dim = q_dim")  # of blocks
    q_kind, kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, np.ndarray, np.ndarray, np.ndarray]] = {}  # by query block: its ids; query, score and id of the best so far

        def told() -> Iterator[pa.RecordBatch]:
            for q_ids, q, s, i in held.values():
                yield pa.RecordBatch.from_arrays([pa.array([q_ids[x] for x in q.tolist()]), pa.array(i.tolist()), pa.array(s)], names=["query_id", "id", "score"])
            held.clear()

        for b in batches:
            for dim, ids, data, q_ids, q_data in zip(*[b.column(c).to_pylist() for c in ("dim", "ids", "data", "q_ids", "q_data")], strict=True):
                s = np.round(np.frombuffer(q_data).reshape(-1, dim) @ np.frombuffer(data).reshape(-1, dim).T, decimals) + 0.0
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                at_q, at = np.nonzero(s >= least[:, None])
                key = (dim, q_ids[0], len(q_ids), hash(q_data))
                _, q, old, i = held.get(key, (q_ids, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)))
                q, new, i = np.r_[q, at_q], np.r_[old, s[at_q, at]], np.r_[i, np.array(ids, object)[at]]
                keep = best(q, new, np.unique(i, return_inverse=True)[1] if len(i) else np.zeros(0, np.int64), k)
                held[key] = (q_ids, q[keep], new[keep], i[keep])
            if sum(len(x[0]) for x in held.values()) > HELD:
                yield from told()
        yield from told()

    scored = pairs.mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)
