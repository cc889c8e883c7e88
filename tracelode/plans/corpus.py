"""Queries over the corpus tables: chunks, indexes, retrieval, metrics. Each has DuckDB SQL of its own beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import text as X
from ..operators import chunking as C
from ..operators import critic as K
from ..operators import index as I
from ..operators import metrics as M
from ..operators import protocol as P
from ..operators import retrieval as R
from ..operators import screening as N
from ..operators import synthesis as S
from ..operators import validate as V
from ..sources.tables import checkpointed, html_pages, shared_folder, staged, state_of, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = rf"""
    q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark),
    d AS (SELECT doc_id AS id, {TOK} AS ts FROM documents),
    t AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM d),
    p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score
           FROM q JOIN p USING (term) JOIN f USING (term), t GROUP BY query_id, id),
    bm25 AS (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM bs QUALIFY rank <= 10)"""
OVERLAP = """
    os AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM q JOIN p USING (term) GROUP BY query_id, id),
    ov AS (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM os QUALIFY rank <= 10)"""
DENSE = rf"""
    dt AS (SELECT doc_id AS id, unnest({TOK}) AS term FROM documents),
    dv AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM dt GROUP BY ALL),
    qt AS (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark),
    qv AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM qt GROUP BY ALL),
    dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM dv GROUP BY id), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY query_id),
    ds AS (SELECT query_id, id, round(coalesce(s, 0) / (qn.n * dn.n), 6) AS score FROM qn CROSS JOIN dn
           LEFT JOIN (SELECT query_id, id, sum(qv.c * dv.c) AS s FROM qv JOIN dv USING (slot) GROUP BY query_id, id) USING (query_id, id)),
    dense AS (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM ds QUALIFY rank <= 10)"""
HYBRID = """
    hs AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, id, rank FROM bm25 UNION ALL SELECT query_id, id, rank FROM dense) GROUP BY query_id, id),
    hybrid AS (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM hs QUALIFY rank <= 10)"""
WORDS = r"len(list_filter(regexp_split_to_array(trim({0}), '\s+'), lambda x: x <> ''))"
CHUNKS = (
    r"""
    l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    l1 AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM l0),
    l2 AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS base, """
    + WORDS.format("line")
    + r""" AS n FROM l1),
    l3 AS (SELECT *, CASE WHEN n > 240 THEN regexp_extract_all(line, '(?s)(?:\s*\S+){1,240}\s*') ELSE [line] END AS ps FROM l2),
    l4 AS (SELECT doc_id, line_no, base, unnest(range(0, len(ps))) AS piece_no, unnest(ps) AS piece FROM l3),
    us AS (SELECT doc_id, (base + sum(length(piece)) OVER (PARTITION BY doc_id, line_no ORDER BY piece_no) - length(piece))::INT AS cs, length(piece)::INT AS cl, """
    + WORDS.format("piece")
    + r"""::INT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, piece_no) AS u FROM l4),
    fold AS (
        SELECT doc_id, u, cs, cl, n, 0 AS no, n AS acc FROM us WHERE u = 1
        UNION ALL
        SELECT x.doc_id, x.u, x.cs, x.cl, x.n,
            CASE WHEN f.acc > 0 AND x.n > 0 AND (f.acc >= 180 OR f.acc + x.n > 240) THEN f.no + 1 ELSE f.no END,
            CASE WHEN f.acc > 0 AND x.n > 0 AND (f.acc >= 180 OR f.acc + x.n > 240) THEN x.n ELSE f.acc + x.n END
        FROM fold f JOIN us x ON x.doc_id = f.doc_id AND x.u = f.u + 1
    ),
    chunks AS (SELECT doc_id, no AS chunk_no, min(cs) AS char_start, max(cs + cl) AS char_end, sum(n)::INT AS n_words FROM fold GROUP BY doc_id, no HAVING sum(n) > 0)"""
)
RISK = r"(1000.0 * len(regexp_extract_all({0}, '[=±×÷∑∏∫√∂∇≤≥≈≠∈∞αβγδεθλμσφω^_{{}}\\|<>+*/]')) / length({0}))"
BLOCKS = CHUNKS + r""",
    blocks AS (SELECT printf('%s-ZA-S01-C%03d', doc_id::VARCHAR, chunk_no) AS evidence_id, doc_id::VARCHAR AS doc_id, chunk_no AS ord, char_start, char_end, n_words,
        substr(text, char_start + 1, char_end - char_start) AS text, sha256(text) AS source_sha256 FROM chunks JOIN documents USING (doc_id))"""


# ---- pieces of Spark


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def items_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return C.text_chunks(docs_of(spark, d).select("doc_id", "text")).select("doc_id", "chunk_no", "char_start", "char_end", "n_words")


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    return C.evidence_blocks(docs_of(spark, d).select("doc_id", "text"))


def index_of(spark: SparkSession, d: str) -> I.SearchIndex:
    """The index of all documents: built where the shared folder has none of this state of the table, else opened."""
    docs = docs_of(spark, d).select(F.col("doc_id").alias("evidence_id"), "text", "lang", "source")
    return I.opened(spark, f"{shared_folder(spark)}/index/{CONFIG.digest()[:16]}-{state_of(spark, docs)[:32]}", docs)


def bm25_of(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).bm25(items_of(spark, d), CONFIG.top_k)


def overlap_of(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).overlap(items_of(spark, d), CONFIG.top_k)


def log_of(spark: SparkSession, d: str) -> DataFrame:
    """Turns as passes: mechanics of the protocol only."""
    c = table(spark, d, "conversations").where("role <> 'system'")
    return c.select(F.col("conv_id").alias("doc_id"), F.lit("D01").alias("dimension"), F.col("turn").cast("int").alias("pass"), F.when(F.col("role") == "user", "A").otherwise("B").alias("agent"), F.concat(F.lit("L"), (F.char_length("text") % 3).cast("string")).alias("label"))


LOG = "log AS (SELECT conv_id AS doc_id, 'D01' AS dimension, turn::INT AS pass, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS agent, 'L' || (length(text) % 3)::VARCHAR AS label FROM conversations WHERE role <> 'system')"


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: mechanics of the call log only."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("long")
    return e.select("event_type", "ts", F.col("value").alias("latency"), k.alias("input_tokens"), (k % 7).alias("output_tokens"), (F.col("event_id") % 3).cast("int").alias("retries"), F.when(F.col("event_type") == "error", F.lit("error")).alias("failure_reason"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("input_hash"), k.cast("string").alias("output_hash"))


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    arms = F.explode(F.array(*map(F.lit, range(6)))).alias("a")
    x = docs_of(spark, d).select("doc_id", "source", arms)
    return x.select(F.concat(F.lit("G"), F.col("a").cast("string")).alias("arm"), F.col("doc_id"), F.col("source").alias("dimension"), ((F.col("doc_id") * (F.col("a") + 3)) % 17 / F.lit(17.0)).alias("score"))


SCORES = "scores AS (SELECT 'G' || a::VARCHAR AS arm, doc_id, source AS dimension, ((doc_id * (a + 3)) % 17) / 17.0::DOUBLE AS score FROM documents, range(0, 6) r(a))"


def records_of(spark: SparkSession, d: str) -> DataFrame:
    dim = F.format_string("D%02d", (F.col("doc_id") % 10 + 1).cast("int"))
    return docs_of(spark, d).select(F.col("source").alias("doc_id"), dim.alias("dimension"), F.col("lang").alias("label"))


RECORDS = "records AS (SELECT source AS doc_id, printf('D%02d', (doc_id % 10 + 1)::INT) AS dimension, lang AS label FROM documents)"


# ---- retrieval


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_of(spark, d)


@query(f"WITH x AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.term_stats(R.postings(docs_of(spark, d), "doc_id"))


@query(f"SELECT doc_id AS id, len({TOK})::INT AS len FROM documents")
def bm25_doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return R.doc_lengths(docs_of(spark, d), "doc_id")


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0)
    SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.cosine_topk(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), v)


@query(f"WITH {BM25}, {OVERLAP}, s AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, count(*) AS n_channels FROM (SELECT query_id, id, rank FROM bm25 UNION ALL SELECT query_id, id, rank FROM ov) GROUP BY query_id, id) SELECT query_id, id, score, n_channels, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf_fusion([bm25_of(spark, d), overlap_of(spark, d)])


@query(f"""WITH {BM25}, {OVERLAP},
    n AS (SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END * 0.7 AS s FROM bm25 WINDOW w AS (PARTITION BY query_id)
          UNION ALL SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END * 0.3 FROM ov WINDOW w AS (PARTITION BY query_id)),
    s AS (SELECT query_id, id, round(sum(s::DOUBLE), 8) AS score FROM n GROUP BY query_id, id)
    SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM s QUALIFY rank <= 10""")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_fusion([(bm25_of(spark, d), 0.7), (overlap_of(spark, d), 0.3)], CONFIG.top_k)


@query(f"WITH {BM25}, {DENSE}, {HYBRID} SELECT query_id::VARCHAR AS query_id, id, score, rank FROM hybrid")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).hybrid_search(items_of(spark, d))


ARM_READS = """
    aw AS (SELECT doc_id::BIGINT AS id, ord, text, floor(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1800)::INT AS window_no,
        char_end, sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord) AS used FROM blocks),
    win AS (SELECT id, window_no, string_agg(text, chr(10) ORDER BY ord) AS text FROM aw GROUP BY ALL), starts AS (SELECT id, max(char_end) AS stop FROM aw WHERE used <= 1800 GROUP BY id),
    lists AS (SELECT 'dense' AS channel, query_id, id, rank FROM dense UNION ALL SELECT 'bm25', query_id, id, rank FROM bm25 UNION ALL SELECT 'hybrid', query_id, id, rank FROM hybrid),
    reads AS (SELECT channel, 'retrieval' AS step, query_id::VARCHAR AS query_id, id, rank, text FROM lists JOIN win USING (id)
        UNION ALL SELECT 'coverage', 'coverage', NULL, id, NULL, text FROM win
        UNION ALL SELECT 'direct', 'direct', NULL, doc_id, NULL, coalesce(text, '') FROM documents
        UNION ALL SELECT 'budget', 'direct', NULL, id, NULL, substr(text, 1, stop) FROM starts JOIN documents ON doc_id = id),
    arms(arm, channel, coverage, critic, passes) AS (VALUES ('G0', 'direct', false, false, 1), ('G0-budget', 'budget', false, false, 1), ('G1', 'dense', false, false, 1), ('G2', 'bm25', false, false, 1), ('G3', 'hybrid', false, false, 1),
        ('G4', 'hybrid', true, false, 1), ('G4', 'coverage', true, false, 1), ('G5', 'hybrid', true, true, 4), ('G5', 'coverage', true, true, 4), ('G5-round', 'hybrid', true, true, 2), ('G5-round', 'coverage', true, true, 2)),
    ps(pass, agent) AS (VALUES (1, 'A'), (2, 'B'), (3, 'A'), (4, 'B')),
    calls AS (SELECT channel, step, query_id, id, rank, pass, agent, count(*) AS n, min(sha256('pass ' || pass || ', agent ' || agent || chr(10) || coalesce(query_id, 'all') || chr(10) || text || chr(10) || chr(10))) AS input_hash
        FROM reads, ps WHERE pass <= (SELECT max(passes) FROM arms WHERE arms.channel = reads.channel) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {BM25}, {DENSE}, {HYBRID}, {BLOCKS}, {ARM_READS}
    SELECT arm, step, query_id, id, rank, coverage, critic, pass, agent, NULL::VARCHAR AS label, NULL::VARCHAR AS decision, CASE agent WHEN 'A' THEN 'unanswered' END AS state, n AS n_windows, n AS n_unread,
        'dry_run: no model was called' AS failure_reason, input_hash FROM arms JOIN calls USING (channel) WHERE pass <= passes""")
def ablation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All arms and both controls over all documents, by the dry run: prompts are real, answers are none."""
    return R.ablation_matrix(index_of(spark, d), items_of(spark, d))


@query(f"WITH {BM25} SELECT 'run-1' AS run_id, query_id::VARCHAR AS query_id, 'bm25' AS channel, id::VARCHAR AS evidence_id, score, rank, '{CONFIG.digest()}' AS config_sha256 FROM bm25")
def retrieval_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = R.retrieval_manifest(bm25_of(spark, d), "run-1", "bm25")
    return m.withColumn("config_sha256", F.col("params")["config_sha256"]).drop("params")


@query(f"""WITH {BM25}, k AS (SELECT b.query_id, b.id, b.rank FROM bm25 b JOIN documents x ON x.doc_id = b.id WHERE NOT (length(text) > 0 AND {RISK.format('text')} >= 20))
    SELECT query_id, id, rank, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS place FROM k QUALIFY place <= 5""")
def qa_context(spark: SparkSession, d: str) -> DataFrame:
    blocks = docs_of(spark, d).select(F.col("doc_id").alias("evidence_id"), "text", X.formula_risk(F.col("text")).alias("formula_layout_risk"))
    return R.qa_context(bm25_of(spark, d), blocks).select("query_id", "id", "rank", "place")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND n_chars >= 500")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.metadata_filter(docs_of(spark, d), lang="en", source=["src1", "src2", "src3"]).where("n_chars >= 500").select("doc_id", "source", "n_chars")


@query("SELECT item_id, doc_id AS id, (instr(d.text, b.text) - 1)::INT AS quote_start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return V.find_quotes(table(spark, d, "benchmark"), docs_of(spark, d), "doc_id")


@query(f"""WITH {BM25}, rel AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    h AS (SELECT rel.query_id, count(*) FILTER (rank <= 1) / count(*) AS r1, count(*) FILTER (rank <= 5) / count(*) AS r5, count(*) FILTER (rank <= 10) / count(*) AS r10 FROM rel LEFT JOIN bm25 USING (query_id, id) GROUP BY rel.query_id)
    SELECT k, round(avg(r), 6) AS recall, count(*) AS n_queries FROM (SELECT 1 AS k, r1 AS r FROM h UNION ALL SELECT 5, r5 FROM h UNION ALL SELECT 10, r10 FROM h) GROUP BY k""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rel = V.find_quotes(table(spark, d, "benchmark"), docs_of(spark, d), "doc_id").select(F.col("item_id").alias("query_id"), "id")
    return M.recall_at_k(bm25_of(spark, d), rel)


@query(f"""WITH {BM25}, e AS (SELECT DISTINCT source, lang FROM documents), r AS (SELECT DISTINCT source, lang, 1 AS hit FROM bm25 JOIN documents ON doc_id = id WHERE rank = 1)
    SELECT count(*) AS n_sections, round(avg(coalesce(hit, 0)), 6) AS coverage, round(avg(1 - coalesce(hit, 0)), 6) AS unread_share FROM e LEFT JOIN r USING (source, lang)""")
def section_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d).select(F.col("source").alias("doc_id"), F.col("lang").alias("section"), F.col("doc_id").alias("id"))
    return M.section_coverage(docs, docs.join(bm25_of(spark, d).where("rank = 1").select("id"), "id", "left_semi"))


@query(f"""WITH {BM25}, i AS (SELECT query_id, rank, id, len({TOK})::BIGINT AS n FROM bm25 JOIN documents ON doc_id = id), u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS used FROM i)
    SELECT query_id, budget, count(*) AS n_blocks, sum(n)::BIGINT AS n_tokens FROM u, (VALUES (800), (1200), (1800)) b(budget) WHERE used <= budget GROUP BY query_id, budget""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    n = docs_of(spark, d).select(F.col("doc_id").alias("id"), F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    ranked = bm25_of(spark, d).join(n, "id").withColumnRenamed("id", "evidence_id")
    return C.context_budget(ranked).groupBy("query_id", "budget").agg(F.count("*").alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"))


# ---- chunks


@query(f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks")
def chunk_greedy(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d)


@query("WITH w AS (SELECT doc_id, " + WORDS.format("text") + " AS n FROM documents), p AS (SELECT doc_id, unnest(range(0, n)) AS i FROM w) SELECT doc_id, (i // 180)::INT AS chunk_no, count(*)::INT AS n_words FROM p GROUP BY ALL")
def chunk_grid(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_grid(docs_of(spark, d))


@query(f"WITH RECURSIVE {CHUNKS} SELECT count(*) AS n_blocks, round(quantile_cont(n_words, 0.5), 6) AS median_words, round(avg(n_words), 6) AS mean_words, min(n_words) AS min_words, max(n_words) AS max_words, count(*) FILTER (n_words < 40) AS n_short, count(*) FILTER (n_words < 80) AS n_brief FROM chunks")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_stats(chunks_of(spark, d))


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, n_words FROM chunks WHERE n_words < 40")
def short_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).where(F.col("n_words") < CONFIG.short_words).select("doc_id", "chunk_no", "n_words")


@query(f"WITH RECURSIVE {BLOCKS} SELECT evidence_id, sha256(text) AS text_sha256, sha256('01' || chr(10) || text) AS retrieval_sha256, source_sha256 FROM blocks")
def block_hashes(spark: SparkSession, d: str) -> DataFrame:
    return blocks_of(spark, d).select("evidence_id", "text_sha256", "retrieval_sha256", "source_sha256")


@query(f"""WITH RECURSIVE {BLOCKS}, w AS (SELECT *, floor(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1800)::INT AS window_no FROM blocks)
    SELECT doc_id, window_no, count(*) AS n_blocks, sum(n_words)::BIGINT AS n_words FROM w GROUP BY doc_id, window_no""")
def coverage_pass(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_pass(blocks_of(spark, d)).groupBy("doc_id", "window_no").agg(F.count("*").alias("n_blocks"), F.sum("n_words").alias("n_words"))


@query(f"""WITH RECURSIVE {BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(evidence_id), evidence_id) AS r, count(*) OVER (PARTITION BY doc_id) AS n,
        n_words < 40 OR (length(text) > 0 AND {RISK.format('text')} >= 20) AS must_include FROM blocks)
    SELECT evidence_id, must_include FROM s WHERE r <= ceil(n * 0.1) OR must_include""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.stratified_sample(blocks_of(spark, d), ("doc_id",)).select("evidence_id", "must_include")


@query(f"""WITH RECURSIVE {BLOCKS}, h AS (SELECT 'q' AS query_id, doc_id, ord FROM blocks WHERE contains(text, 'idiot'))
    SELECT h.query_id, b.doc_id, b.ord::INT AS ord, min(abs(b.ord - h.ord))::INT AS distance, b.evidence_id FROM h JOIN blocks b ON b.doc_id = h.doc_id AND abs(b.ord - h.ord) <= 1 GROUP BY ALL""")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    blocks = blocks_of(spark, d)
    hits = blocks.where(F.contains("text", F.lit("idiot"))).select(F.lit("q").alias("query_id"), "doc_id", "ord")
    return C.neighbor_expand(hits, blocks).select("query_id", "doc_id", "ord", "distance", "evidence_id")


@query(f"SELECT doc_id, round({RISK.format('text')}, 6) AS density, {RISK.format('text')} >= 20 AS risk FROM documents WHERE length(text) > 0")
def formula_risk(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs_of(spark, d).where(F.char_length(t) > 0).select("doc_id", F.round(X.formula_density(t), 6).alias("density"), X.formula_risk(t).alias("risk"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return C.dedup_exact(docs_of(spark, d).select("doc_id", X.sha256(F.col("text")).alias("text_sha256")), ("text_sha256",), ("doc_id",)).select("doc_id", "text_sha256")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id::VARCHAR) AS first_path FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_files(spark: SparkSession, d: str) -> DataFrame:
    return V.dup_files(docs_of(spark, d).select(X.sha256(F.col("text")).alias("sha256"), F.col("doc_id").cast("string").alias("path")))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')) AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return html_pages(table(spark, d, "pages")).select("page_id", "title", "text")


# ---- metrics and protocol


@query("""WITH p AS (SELECT doc_id AS item_id, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS label FROM documents WHERE lang = 'en')
    SELECT coalesce(l.doc_id, p.item_id) AS item_id, l.quality AS gold, p.label AS predicted, CASE WHEN l.quality IS NULL THEN 'unexpected' WHEN p.label IS NULL THEN 'missing' WHEN l.quality = p.label THEN 'correct' ELSE 'wrong' END AS status
    FROM labels l FULL JOIN p ON l.doc_id = p.item_id""")
def gold_join(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("label"))
    predicted = docs_of(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") >= 300).cast("int").alias("label"))
    return M.gold_join(gold, predicted)


@query("""WITH x AS (SELECT l.quality AS g, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id)),
    ls AS (SELECT g AS l FROM x UNION SELECT p FROM x), f AS (SELECT l, (SELECT count(*) FROM x WHERE g = l AND p = l) AS tp, (SELECT count(*) FROM x WHERE g = l) AS ng, (SELECT count(*) FROM x WHERE p = l) AS np FROM ls)
    SELECT count(*) AS n_labels, round(avg(2 * tp / (ng + np)), 6) AS macro_f1, (SELECT round(avg((g = p)::INT), 6) FROM x) AS accuracy FROM f""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").join(docs_of(spark, d).select("doc_id", (F.col("n_chars") >= 300).cast("int").alias("predicted")), "doc_id").select(F.col("quality").alias("gold"), "predicted")
    return M.macro_f1(pairs)


@query("""WITH x AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM x),
    m AS (SELECT sum(na * nb) / max(t.n * t.n) AS pe FROM (SELECT a AS l, count(*) AS na FROM x GROUP BY a) JOIN (SELECT b AS l, count(*) AS nb FROM x GROUP BY b) USING (l), t)
    SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM t, m""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return M.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH c AS (SELECT doc_id AS i, quality AS l FROM labels UNION ALL SELECT doc_id, toxic FROM labels), u AS (SELECT i, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY i) AS m FROM c WHERE l IS NOT NULL GROUP BY i, l QUALIFY m > 1),
    o AS (SELECT sum(n * (m - n) / (m - 1)) AS d, sum(n) AS t FROM u), v AS (SELECT sum(k * k) AS sq FROM (SELECT sum(n) AS k FROM u GROUP BY l))
    SELECT t::BIGINT AS n, round(1 - d / ((t * t - sq) / (t - 1)), 6) AS alpha FROM o, v""")
def krippendorff_alpha(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.explode(F.array("quality", "toxic")).alias("label"))
    return M.krippendorff_alpha(codes)


@query("""WITH e AS (SELECT event_type, value AS l, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 3 AS r FROM events)
    SELECT event_type, count(*) AS n_calls, sum(k)::BIGINT AS input_tokens, sum(k % 7)::BIGINT AS output_tokens, round(quantile_cont(l, 0.5), 6) AS latency_p50, round(quantile_cont(l, 0.95), 6) AS latency_p95, sum(r)::BIGINT AS retries, round(avg((event_type = 'error')::INT), 6) AS failure_rate FROM e GROUP BY event_type""")
def call_cost_latency(spark: SparkSession, d: str) -> DataFrame:
    return M.call_cost_latency(calls_of(spark, d), ("event_type",))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS k FROM events GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS n_repeated, round(avg((k = 1)::INT), 6) AS identical_share FROM e""")
def repeatability(spark: SparkSession, d: str) -> DataFrame:
    return M.repeatability(calls_of(spark, d))


DRAW = "('0x' || substr(md5('42:' || {0}::VARCHAR || ':' || {1}::VARCHAR), 1, 8))::BIGINT % {2}"


@query(f"""WITH s AS (SELECT source, sum(n_chars) AS s, count(n_chars) AS c FROM documents GROUP BY source), x AS (SELECT row_number() OVER (ORDER BY source) - 1 AS idx, s, c FROM s), n AS (SELECT count(*) AS n FROM x),
    k AS (SELECT i, {DRAW.format('i', 'j', 'n')} AS idx FROM n, range(0, 200) a(i), range(0, n) b(j)), m AS (SELECT i, sum(s) / sum(c) AS m FROM k JOIN x USING (idx) GROUP BY i)
    SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT round(sum(s) / sum(c), 6) FROM x) AS mean FROM m""")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return M.cluster_bootstrap(docs_of(spark, d), "source", "n_chars")


@query(f"""WITH {SCORES}, p AS (SELECT a.dimension AS c, sum(a.score - b.score) AS s FROM scores a JOIN scores b USING (doc_id, dimension) WHERE a.arm = 'G4' AND b.arm = 'G3' GROUP BY a.dimension),
    f AS (SELECT i, sum(CASE WHEN {DRAW.format('i', 'c', '2')} = 0 THEN s ELSE -s END) AS t FROM p, range(1, 201) r(i) GROUP BY i), z AS (SELECT sum(s) AS t0 FROM p)
    SELECT round((1 + count(*) FILTER (abs(t) >= abs(t0) - 1e-12)) / (1 + count(*)), 6) AS p_value FROM f, z""")
def randomization_test(spark: SparkSession, d: str) -> DataFrame:
    """Differences in seventeenths, of which all scores are multiples: whole numbers, so that ties are told apart from near ties at any size."""
    s = scores_of(spark, d).withColumn("seventeenths", F.round(F.col("score") * 17).cast("long"))
    a, b = (s.where(F.col("arm") == x).select("doc_id", "dimension", F.col("seventeenths").alias(x)) for x in ("G4", "G3"))
    return M.randomization_test(a.join(b, ["doc_id", "dimension"]).select(F.col("dimension").alias("cluster"), (F.col("G4") - F.col("G3")).alias("diff")))


@query(f"""WITH {SCORES}, c(h, l) AS (VALUES ('G4', 'G3'), ('G3', 'G1'), ('G3', 'G2'), ('G5', 'G4'))
    SELECT h || '-' || l AS contrast, count(*) AS n_pairs, round(avg(a.score - b.score), 6) AS mean_diff FROM c JOIN scores a ON a.arm = h JOIN scores b ON b.arm = l AND a.doc_id = b.doc_id AND a.dimension = b.dimension GROUP BY h, l""")
def arm_contrast(spark: SparkSession, d: str) -> DataFrame:
    return M.arm_contrast(scores_of(spark, d))


@query(f"WITH {SCORES} SELECT doc_id, dimension, count(*) AS n, round(avg(score), 6) AS mean FROM scores GROUP BY GROUPING SETS ((doc_id), (dimension), ())")
def metric_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return M.metric_breakdown(scores_of(spark, d))


@query(f"WITH {RECORDS} SELECT dimension, label, count(*) AS n FROM records GROUP BY ALL")
def label_freq(spark: SparkSession, d: str) -> DataFrame:
    return M.label_freq(records_of(spark, d))


@query(f"WITH {RECORDS} SELECT doc_id, " + ", ".join(f"max(label) FILTER (dimension = '{x}') AS {x}" for x in CONFIG.dimensions) + " FROM records GROUP BY doc_id")
def label_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.label_matrix(records_of(spark, d))


@query(f"WITH {RECORDS}, m AS (SELECT doc_id, dimension, max(label) AS label FROM records GROUP BY ALL), g AS (SELECT DISTINCT r.doc_id, x.dimension FROM records r, (SELECT unnest([{', '.join(repr(x) for x in CONFIG.dimensions)}]) AS dimension) x) SELECT dimension, coalesce(label, 'not_produced') AS label, count(*) AS n FROM g LEFT JOIN m USING (doc_id, dimension) GROUP BY ALL")
def figure_data(spark: SparkSession, d: str) -> DataFrame:
    return S.figure_data(M.label_matrix(records_of(spark, d)))


@query("SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY CUBE (source, lang)")
def corpus_cube(spark: SparkSession, d: str) -> DataFrame:
    return M.corpus_cube(docs_of(spark, d))


FINAL = f"""{LOG}, fin AS (SELECT doc_id, dimension, max(pass) AS passes, arg_max(label, pass) AS final_label, arg_max(label, pass) FILTER (agent = 'A') AS last_a, arg_max(label, pass) FILTER (agent = 'B') AS last_b FROM log GROUP BY ALL),
    fs AS (SELECT *, last_a IS DISTINCT FROM last_b AS adjudication_required FROM fin)"""


@query(f"WITH {FINAL} SELECT * FROM fs")
def protocol_final_state(spark: SparkSession, d: str) -> DataFrame:
    return P.protocol_final_state(log_of(spark, d))


@query(f"WITH {FINAL} SELECT * FROM fs WHERE adjudication_required")
def adjudication_queue(spark: SparkSession, d: str) -> DataFrame:
    return P.adjudication_queue(log_of(spark, d))


@query(f"WITH {LOG} SELECT m AS mode, count(*) AS n FROM log, (VALUES ('A-only', 1), ('A+B', 2), ('A+B+A+B', 4)) v(m, p) WHERE pass <= p GROUP BY m")
def critic_ablation(spark: SparkSession, d: str) -> DataFrame:
    log, out = log_of(spark, d), None
    for mode in ("A-only", "A+B", "A+B+A+B"):
        one = P.up_to_pass(log, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {FINAL}, r AS (SELECT doc_id, dimension, agent, label, row_number() OVER (PARTITION BY doc_id, dimension, agent ORDER BY pass) AS k FROM log)
    SELECT count(*) AS n, round(avg((a.label = b.label)::INT), 6) AS agreement, round(avg((fs.final_label <> a.label)::INT), 6) AS correction_rate, round(avg(fs.adjudication_required::INT), 6) AS unresolved_rate
    FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.agent = 'A' AND b.agent = 'B' AND a.k = 1 AND b.k = 1 JOIN fs ON fs.doc_id = a.doc_id""")
def ab_agreement(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    first = lambda a: C.dedup_exact(log.where(F.col("agent") == a), ("doc_id", "dimension"), ("pass",))
    final = P.protocol_final_state(log).select("doc_id", "dimension", F.col("final_label").alias("label"), F.col("adjudication_required").alias("unresolved"))
    return M.ab_agreement(first("A"), first("B"), final)


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels")
    return V.split_leakage(x.where("quality = 1"), x.where("toxic = 1"), "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_version(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ("user_id",), "event_id")


@query("""SELECT count(*) AS n_rows, (sum(('0x' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), n_chars::VARCHAR)), 1, 15))::HUGEINT) % (1::HUGEINT << 60))::BIGINT AS digest, true AS unchanged FROM documents""")
def freeze_verify(spark: SparkSession, d: str) -> DataFrame:
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs_of(spark, d)
    return S.verify(docs, cols, S.freeze(docs, cols)).select("n_rows", "digest", "unchanged")


# ---- further checks and metrics


@query("""WITH q AS (SELECT item_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS quote FROM benchmark)
    SELECT item_id, doc_id AS id, (instr(d.text, quote) - 1)::INT AS quote_start FROM q JOIN documents d ON contains(d.text, quote)""")
def short_quote_match(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("text"))
    return V.find_quotes(quotes, docs_of(spark, d), "doc_id")


@query("""SELECT source AS dimension, count(*) AS n, round(avg((l.quality IS NOT NULL AND l.quality = (n_chars >= 300)::INT)::INT), 6) AS precision
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars IS NOT NULL GROUP BY source""")
def dimension_precision(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold"))
    pairs = docs_of(spark, d).select("doc_id", F.col("source").alias("dimension"), (F.col("n_chars") >= 300).cast("int").alias("predicted")).join(gold, "doc_id", "left")
    return M.precision_by(pairs)


@query(f"""WITH {LOG}, g AS (SELECT doc_id, dimension FROM log GROUP BY ALL HAVING count(DISTINCT label) > 1),
    f AS (SELECT DISTINCT x.doc_id, x.dimension FROM log x JOIN log y ON x.doc_id = y.doc_id AND x.dimension = y.dimension AND y.pass = x.pass + 1 WHERE x.label <> y.label)
    SELECT count(*) AS n_cases, count(f.doc_id) AS n_flagged, round(avg((f.doc_id IS NOT NULL)::INT), 6) AS recall FROM g LEFT JOIN f USING (doc_id, dimension)""")
def contradiction_recall(spark: SparkSession, d: str) -> DataFrame:
    log, keys = log_of(spark, d), ["doc_id", "dimension"]
    gold = log.groupBy(*keys).agg(F.count_distinct("label").alias("k")).where("k > 1")
    after = log.select(*keys, (F.col("pass") - 1).alias("pass"), F.col("label").alias("next"))
    return M.case_recall(gold, log.join(after, [*keys, "pass"]).where("label <> next"))


@query("""SELECT count(*) AS n_claims, round(avg((h.item_id IS NULL)::INT), 6) AS unsupported_rate
    FROM benchmark LEFT JOIN (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) h USING (item_id)""")
def unsupported_claim_rate(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    found = V.find_quotes(items, docs_of(spark, d), "doc_id").select(F.col("item_id").alias("claim_id"))
    return M.unsupported_rate(items.select(F.col("item_id").alias("claim_id")), found)


@query("""WITH f AS (SELECT item_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    x AS (SELECT item_id, EXISTS (SELECT 1 FROM f WHERE f.item_id = b.item_id AND f.id = b.item_id) AS here, EXISTS (SELECT 1 FROM f WHERE f.item_id = b.item_id) AS anywhere FROM benchmark b)
    SELECT count(*) AS n_cited, count_if(anywhere AND NOT here)::BIGINT AS n_misattributed, count_if(NOT anywhere)::BIGINT AS n_nowhere, round(avg((anywhere AND NOT here)::INT), 6) AS misattributed_share FROM x""")
def misattributed_share(spark: SparkSession, d: str) -> DataFrame:
    """Each item cites the document of its own number: mechanics of attribution only."""
    items = table(spark, d, "benchmark")
    return M.misattributed_share(items.select("item_id", F.col("item_id").alias("id")), V.find_quotes(items, docs_of(spark, d), "doc_id"))


@query("""WITH e AS (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events), p AS (SELECT event_type, length(event_type)::DOUBLE AS a, 2.0::DOUBLE * length(event_type) AS b FROM events GROUP BY event_type HAVING event_type <> 'error')
    SELECT e.event_type, count(*) AS n_calls, round(sum((k * a + (k % 7) * b) / 1e6), 6) AS cost, count_if(a IS NULL OR k IS NULL)::BIGINT AS n_unpriced FROM e LEFT JOIN p ON e.event_type = p.event_type GROUP BY e.event_type""")
def call_cost(spark: SparkSession, d: str) -> DataFrame:
    calls = calls_of(spark, d)
    price = F.length("event_type").cast("double")
    prices = calls.where("event_type <> 'error'").select("event_type").distinct().select("event_type", price.alias("input_price"), (2 * price).alias("output_price"))
    return M.call_cost(calls, prices, ("event_type",))


@query("SELECT DISTINCT conv_id AS call_id FROM conversations WHERE conv_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'error')")
def manifest_fk(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("call_id"))
    return V.manifest_fk(table(spark, d, "conversations").select(F.col("conv_id").alias("call_id")).distinct(), manifest)


@query(f"SELECT lang, count(*) AS n, count_if({RISK.format('text')} >= 20)::BIGINT AS n_risk FROM documents WHERE length(text) > 0 GROUP BY lang")
def formula_risk_count(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d).where(F.char_length("text") > 0)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.formula_risk(F.col("text"))).alias("n_risk"))


@query(f"WITH RECURSIVE {BLOCKS} SELECT 'G0' AS arm, doc_id, evidence_id, ord, tokens FROM (SELECT doc_id, evidence_id, ord, sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS tokens FROM blocks) WHERE tokens <= 1800")
def direct_context(spark: SparkSession, d: str) -> DataFrame:
    return C.direct_context(blocks_of(spark, d))


DIMENSION_ITEMS = "(SELECT * FROM benchmark WHERE item_id < 10)"


@query(f"WITH {BM25}, {DENSE}, {HYBRID} SELECT 'D' || lpad((query_id + 1)::VARCHAR, 2, '0') AS dimension, id, score, rank FROM hybrid".replace("FROM benchmark", f"FROM {DIMENSION_ITEMS}"))
def dimension_pass(spark: SparkSession, d: str) -> DataFrame:
    """The ten dimensions' queries are the first ten benchmark items here, for the study gives no wording; all documents are searched."""
    asked = items_of(spark, d).where("query_id < 10").select(F.concat(F.lit("D"), F.lpad((F.col("query_id") + 1).cast("string"), 2, "0")).alias("dimension"), "text")
    return R.dimension_pass(index_of(spark, d), asked)


@query("""
    WITH l AS (SELECT doc_id, unnest(range(0, len(ls)))::INT AS ord, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    s AS (SELECT *, length(text) % 6 AS size FROM l), z AS (SELECT doc_id, size, sum(length(text)) AS chars FROM s GROUP BY ALL),
    b AS (SELECT doc_id, size AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, size) = 1),
    r AS (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC)::INT AS depth FROM z JOIN b USING (doc_id) WHERE size > body),
    h AS (SELECT doc_id, ord, text AS title, depth FROM s JOIN r USING (doc_id, size)), e AS (SELECT doc_id, max(ord) AS final FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id, x.ord, max(y.ord) AS parent_ord FROM h x LEFT JOIN h y ON x.doc_id = y.doc_id AND y.ord < x.ord AND y.depth < x.depth GROUP BY ALL)
    SELECT doc_id, ord, title, depth, parent_ord, coalesce(lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) - 1, final)::INT AS last_ord FROM h JOIN p USING (doc_id, ord) JOIN e USING (doc_id)""")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents; a line's length modulo 6 stands in for the size of its letters, which the tables do not hold."""
    lines = docs_of(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return C.section_tree(C.font_depth(lines.withColumn("size", F.char_length("text") % 6)))


TITLES = ("Introduction", "Coupled model", "Simulation", "Case study", "References", "Plain words", "Notes", "Limits")
MARKED = rf"""
    h0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls, {list(TITLES)} AS ts FROM documents WHERE text IS NOT NULL),
    h1 AS (SELECT doc_id, flatten(list_transform(range(0, len(ls)), lambda i: CASE WHEN i % 3 = 0 THEN [CASE WHEN (doc_id + i) % 4 = 0 THEN '# ' WHEN (doc_id + i) % 4 = 1 THEN '2.' || (i % 5) || ' ' WHEN (doc_id + i) % 4 = 2 THEN '1.2.' || (i % 7) || ' ' ELSE '####### ' END
        || ts[1 + (doc_id + i) % 8], ls[i + 1]] ELSE [ls[i + 1]] END)) AS ls FROM h0),
    h2 AS (SELECT doc_id, unnest(range(0, len(ls)))::INT AS ord, unnest(ls) AS text FROM h1),
    h3 AS (SELECT *, (1 + ord // 40)::INT AS page, CASE WHEN regexp_matches(text, '^#{{1,6}}\s+\S') THEN length(regexp_extract(text, '^(#{{1,6}})\s+\S', 1))
        WHEN regexp_matches(text, '^\d{{1,3}}(?:\.\d{{1,3}})*\.?\s+\p{{Lu}}') THEN len(string_split(regexp_extract(text, '^(\d{{1,3}}(?:\.\d{{1,3}})*)\.?\s+\p{{Lu}}', 1), '.')) END AS depth FROM h2),
    s0 AS (SELECT doc_id, ord, text AS title, depth FROM h3 WHERE depth IS NOT NULL),
    s1 AS (SELECT * , CASE WHEN regexp_matches(lower(title), 'abstract|introduction|background|summary') THEN 'A' WHEN regexp_matches(lower(title), 'model|architecture|mechanism|coupling|equation|method|framework') THEN 'B'
        WHEN regexp_matches(lower(title), 'metric|simulation|warning|control|result|evaluation|experiment') THEN 'C' WHEN regexp_matches(lower(title), 'case|social|discussion|limit|conclusion|community') THEN 'D' END AS own
        FROM s0 WHERE NOT regexp_matches(lower(title), '^\W*(references|bibliography|acknowledge?ments?|author bio|biograph)')),
    s2 AS (SELECT x.doc_id, x.ord, max(y.ord) AS parent FROM s1 x LEFT JOIN s1 y ON y.doc_id = x.doc_id AND y.ord < x.ord AND y.depth < x.depth GROUP BY ALL),
    s3 AS (SELECT doc_id, ord, parent, own AS zone FROM s1 JOIN s2 USING (doc_id, ord) UNION ALL SELECT u.doc_id, u.ord, p.parent, q.own FROM s3 u JOIN s2 p ON p.doc_id = u.doc_id AND p.ord = u.parent JOIN s1 q ON q.doc_id = u.doc_id AND q.ord = u.parent WHERE u.zone IS NULL),
    s4 AS (SELECT doc_id, ord AS section_ord, coalesce(max(zone), 'D') AS zone FROM s3 GROUP BY ALL),
    n0 AS (SELECT *, max(CASE WHEN depth IS NOT NULL THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS section_ord FROM h3),
    n1 AS (SELECT n0.*, s0.title, CASE WHEN n0.section_ord IS NULL THEN 'D' ELSE s4.zone END AS zone FROM n0 LEFT JOIN s4 USING (doc_id, section_ord) LEFT JOIN s0 ON s0.doc_id = n0.doc_id AND s0.ord = n0.section_ord),
    n2 AS (SELECT doc_id || '|' || zone AS doc_id, section_ord, title, page, text, ord, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, zone ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_char FROM n1 WHERE zone IS NOT NULL),
    zones AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM n2 GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE {MARKED}, {CHUNKS.replace('FROM documents', 'FROM zones')}
    SELECT printf('%s-Z%s-S%02d-C%03d', split_part(c.doc_id, '|', 1), split_part(c.doc_id, '|', 2), coalesce(l.section_ord, 0), chunk_no) AS evidence_id, split_part(c.doc_id, '|', 2) AS zone, l.section_ord::INT AS section_ord, l.title AS section_title, l.page,
        char_start, char_end, n_words, sha256(substr(z.text, char_start + 1, char_end - char_start)) AS text_sha256, sha256(z.text) AS zone_sha256
    FROM chunks c ASOF JOIN n2 l ON l.doc_id = c.doc_id AND c.char_start >= l.at_char JOIN zones z ON z.doc_id = c.doc_id""")
def sectioned_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with headings put before every third line, numbered, marked and of seven marks (no heading), whose words set, inherit and exclude zones."""
    titles = F.array(*map(F.lit, TITLES))

    def heading(i: Column) -> Column:
        k = F.col("doc_id") + i
        mark = F.when(k % 4 == 0, F.lit("# ")).when(k % 4 == 1, F.concat(F.lit("2."), (i % 5).cast("string"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("1.2."), (i % 7).cast("string"), F.lit(" "))).otherwise(F.lit("####### "))
        return F.concat(mark, F.get(titles, (k % 8).cast("int")))

    marked = F.flatten(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(i % 3 == 0, F.array(heading(i), line)).otherwise(F.array(line))))
    lines = docs_of(spark, d).where("text is not null").select("doc_id", F.posexplode(marked).alias("ord", "text"))
    lines = lines.select("doc_id", "ord", (1 + F.floor(F.col("ord") / 40)).cast("int").alias("page"), "text", C.numbered_depth(F.col("text")).alias("depth"))
    return C.sectioned_blocks(checkpointed(lines)).select("evidence_id", "zone", "section_ord", "section_title", "page", "char_start", "char_end", "n_words", "text_sha256", "zone_sha256")


@query(f"""WITH p(pass, agent) AS (VALUES (1, 'A'), (2, 'B'), (3, 'A'), (4, 'B')), x AS (SELECT unnest({list(CONFIG.dimensions)}) AS dimension)
    SELECT doc_id, dimension, pass, agent, NULL::VARCHAR AS label, NULL::VARCHAR AS decision, 'dry_run: no model was called' AS failure_reason,
        sha256('pass ' || pass || ', agent ' || agent || chr(10) || dimension || chr(10) || coalesce(text, '') || chr(10) || chr(10)) AS input_hash
    FROM documents, x, p""")
def four_passes(spark: SparkSession, d: str) -> DataFrame:
    """Every document and dimension through all four calls of the dry run: prompts are real, answers are none."""
    log = P.four_passes(docs_of(spark, d).select("doc_id", "text"), stage=staged, dimensions=CONFIG.dimensions)
    return log.select("doc_id", "dimension", "pass", "agent", "label", "decision", "failure_reason", "input_hash")


READ = (1, 2, 5)
MERGED = "count(*) AS nw, count_if(NOT answered)::BIGINT AS nu, count_if(stated)::BIGINT AS ns, min(label) FILTER (stated) AS lo, max(label) FILTER (stated) AS hi"
RECORD = "CASE WHEN ns = 0 AND nu < nw THEN 'Not_Stated_In_Text' WHEN lo = hi THEN lo END AS label, CASE WHEN lo <> hi THEN 'conflict' WHEN ns > 0 THEN 'stated' WHEN nu = nw THEN 'unanswered' ELSE 'not_stated' END AS state"
DECIDED = "CASE WHEN bool_or(d = 'reject') THEN 'reject' WHEN bool_or(d = 'revise') THEN 'revise' WHEN bool_or(d = 'accept') THEN 'accept' ELSE 'insufficient_evidence' END AS decision"


@query(f"""WITH RECURSIVE {BLOCKS}, w AS (SELECT *, floor(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1800)::INT AS window_no FROM blocks),
    win AS (SELECT doc_id, window_no, sum(n_words)::BIGINT AS n FROM w GROUP BY ALL), x AS (SELECT *, printf('D%02d', k) AS dimension FROM win, (VALUES {', '.join(f'({k})' for k in READ)}) v(k)),
    a1 AS (SELECT *, n % 11 <> 0 AS answered, n % 11 <> 0 AND (n + window_no + k) % 3 <> 0 AS stated, 'L' || ((n + k) % 2)::VARCHAR AS label FROM x),
    m1 AS (SELECT doc_id, dimension, nw, nu, {RECORD} FROM (SELECT doc_id, dimension, {MERGED} FROM a1 GROUP BY ALL)),
    m2 AS (SELECT doc_id, dimension, {DECIDED} FROM (SELECT *, CASE (n + k) % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'revise' WHEN 2 THEN 'insufficient_evidence' ELSE 'reject' END AS d FROM x) GROUP BY ALL),
    a3 AS (SELECT *, n % 11 <> 0 AS answered, n % 11 <> 0 AS stated, 'L' || (k % 2)::VARCHAR AS label FROM x),
    m3 AS (SELECT doc_id, dimension, nw, nu, {RECORD} FROM (SELECT doc_id, dimension, {MERGED} FROM a3 GROUP BY ALL)),
    m4 AS (SELECT doc_id, dimension, {DECIDED} FROM (SELECT *, CASE WHEN n % 5 <> 0 THEN 'accept' ELSE 'insufficient_evidence' END AS d FROM x) GROUP BY ALL)
    SELECT doc_id, dimension, 1 AS pass, 'A' AS agent, label, NULL AS decision, state, nw AS n_windows, nu AS n_unread FROM m1
    UNION ALL SELECT doc_id, dimension, 2, 'B', CASE m2.decision WHEN 'accept' THEN m1.label WHEN 'revise' THEN 'L9' END, m2.decision, NULL, nw, 0 FROM m1 JOIN m2 USING (doc_id, dimension)
    UNION ALL SELECT doc_id, dimension, 3, 'A', label, NULL, state, nw, nu FROM m3
    UNION ALL SELECT doc_id, dimension, 4, 'B', CASE m4.decision WHEN 'accept' THEN m3.label END, m4.decision, NULL, nw, 0 FROM m3 JOIN m4 USING (doc_id, dimension)""")
def coverage_extraction(spark: SparkSession, d: str) -> DataFrame:
    """All windows of all documents through the four passes, with answers recorded beforehand: what they say is derived from the
    windows by arithmetic, so that windows conflict, quotes fail, calls go unanswered and reviews change labels."""
    windows = staged(C.text_windows(docs_of(spark, d).select("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("string")), "reading-windows")
    n, w, k = F.col("n_words"), F.col("window_no"), F.col("k")
    x = windows.select("doc_id", "window_no", "n_words", F.substring("text", 1, 12).alias("head"), F.explode(F.array(*map(F.lit, READ))).alias("k"))
    quote = lambda ok: F.when(ok, F.col("head")).otherwise(F.lit("never said anywhere"))
    told = lambda label, q: F.when(n % 11 != 0, F.to_json(F.struct(F.concat(F.lit("L"), label.cast("string")).alias("label"), q.alias("quote"))))
    review = lambda d: F.to_json(F.struct(d.alias("decision"), F.lit("L9").alias("corrected_label")))
    first = F.when((n + k) % 4 == 0, "accept").when((n + k) % 4 == 1, "revise").when((n + k) % 4 == 2, "insufficient_evidence").otherwise("reject")
    answers = F.array(told((n + k) % 2, quote((n + w + k) % 3 != 0)), review(first), told(k % 2, quote(F.lit(True))), review(F.when(n % 5 != 0, "accept").otherwise("insufficient_evidence")))
    rows = x.select("doc_id", "window_no", F.format_string("D%02d", "k").alias("dimension"), F.posexplode(answers).alias("at", "content"))
    stored = staged(rows.select(P.call_id(F.col("doc_id"), F.col("dimension"), F.col("window_no"), F.col("at") + 1).alias("call_id"), "content").where("content is not null"), "answers")
    log = P.four_passes(windows, "replay", "replay", staged, {"answers": stored}, {"answers": stored}, dimensions=tuple(f"D{k:02d}" for k in READ))
    return log.select("doc_id", "dimension", "pass", "agent", "label", "decision", "state", "n_windows", "n_unread")


# Fixed values of the checks' query (ours): a label's claims as patterns of what its block must and must not hold.
RULES = (
    ("L0", "entailment", "[Tt]he|[Dd]er|[Ll]a|[Ll]e", None), ("L1", "entailment", "en", None), ("L2", "entailment", "[a-z]{6}", None),
    ("L0", "direction", "on.*er", None), ("L1", "direction", "er.*on", None), ("L0", "equation", r"[=+*|]", None), ("L2", "equation", "[0-9]", None),
    ("L1", "temporal", "[0-9]+", "!!"), ("L2", "endpoint", "a", "ou"), ("L0", "contradiction", None, "idiot|worthless"), ("L1", "contradiction", None, "###|!!"),
)
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in RULES) + ") t(label, check_name, must, must_not))"


@query(rf"""WITH RECURSIVE {BLOCKS}, {RULES_SQL},
    r AS (SELECT evidence_id AS record_id, doc_id, 'L' || (n_words % 3)::VARCHAR AS label, CASE WHEN ord % 5 = 4 THEN printf('%s-ZA-S01-C%03d', doc_id, ord + 1) ELSE evidence_id END AS evidence_id,
        char_start + 2 AS char_start, char_start + 22 AS char_end, CASE WHEN n_words % 7 = 0 THEN 'an altered quotation' ELSE substr(text, 3, 20) END AS quote FROM blocks WHERE ord % 3 <> 1 AND char_end - char_start >= 22),
    c AS (SELECT r.*, b.text AS cited FROM r LEFT JOIN blocks b ON b.evidence_id = r.evidence_id),
    k AS (SELECT unnest(['entailment', 'direction', 'equation', 'temporal', 'endpoint']) AS check_name),
    t AS (SELECT record_id, k.check_name, u.label IS NOT NULL AS applicable, u.label IS NULL OR (cited IS NOT NULL AND coalesce(regexp_matches(cited, must), true) AND NOT coalesce(regexp_matches(cited, must_not), false)) AS passed
          FROM c CROSS JOIN k LEFT JOIN rules u ON u.label = c.label AND u.check_name = k.check_name),
    e AS (SELECT record_id, 'evidence' AS check_name, true AS applicable, bool_or(coalesce(b.evidence_id = r.evidence_id AND substr(b.text, r.char_start - b.char_start + 1, 20) = r.quote, false)) AS passed
          FROM r LEFT JOIN blocks b ON b.doc_id = r.doc_id AND b.char_start <= r.char_start AND r.char_end <= b.char_end GROUP BY record_id),
    x AS (SELECT r.record_id, 'contradiction' AS check_name, u.label IS NOT NULL AS applicable, count(b.evidence_id) = 0 AS passed
          FROM r LEFT JOIN rules u ON u.label = r.label AND u.check_name = 'contradiction' LEFT JOIN blocks b ON b.doc_id = r.doc_id AND b.evidence_id <> r.evidence_id AND regexp_matches(b.text, u.must_not) GROUP BY ALL)
    SELECT * FROM t UNION ALL SELECT * FROM e UNION ALL SELECT * FROM x""")
def critic_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records derived from blocks, some of which cite the next block or alter their quote, through the seven checks."""
    blocks = checkpointed(blocks_of(spark, d))
    later = X.evidence_id(F.col("doc_id"), F.lit("A"), F.lit("01"), F.col("ord") + 1)
    quote = F.when(F.col("n_words") % 7 == 0, F.lit("an altered quotation")).otherwise(F.substring("text", 3, 20))
    records = blocks.where("ord % 3 <> 1 AND char_end - char_start >= 22").select(
        F.col("evidence_id").alias("record_id"), "doc_id", F.concat(F.lit("L"), (F.col("n_words") % 3).cast("string")).alias("label"), F.when(F.col("ord") % 5 == 4, later).otherwise(F.col("evidence_id")).alias("evidence_id"),
        (F.col("char_start") + 2).alias("char_start"), (F.col("char_start") + 22).alias("char_end"), quote.alias("quote"),
    )
    return K.critic_checks(records, blocks, spark.createDataFrame(list(RULES), "label string, check_name string, must string, must_not string"))


@query(r"""WITH p AS (SELECT page_id AS cand_id, regexp_extract(url, '^https?://([^/]+)', 1) AS source, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')) AS title,
        trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, (2000 + page_id % 27)::INT AS date FROM pages),
    t AS (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'))) AS ts FROM p),
    l AS (SELECT a.cand_id, min(b.cand_id) AS least FROM t a JOIN t b ON len(a.ts) > 0 AND len(b.ts) > 0 AND len(list_intersect(a.ts, b.ts)) >= 0.8::DOUBLE * (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) GROUP BY 1),
    r AS (SELECT t.*, CASE WHEN len(ts) = 0 THEN 'untitled' WHEN least < t.cand_id THEN 'duplicate' WHEN date < 2005 THEN 'too early' WHEN date > 2024 THEN 'after cut-off' WHEN length(text) < 400 THEN 'too short' WHEN NOT regexp_matches(lower(text), 'th.*er') THEN 'off topic' END AS reason FROM t LEFT JOIN l USING (cand_id))
    SELECT source, coalesce(reason, 'included') AS reason, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM r GROUP BY ALL""")
def corpus_screening(spark: SparkSession, d: str) -> DataFrame:
    """Pages as candidates: hosts as sources, headings as titles, a year by arithmetic."""
    pages = html_pages(table(spark, d, "pages"))
    rows = pages.select(F.col("page_id").alias("cand_id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"), "title", "text", (2000 + F.col("page_id") % 27).cast("int").alias("date"))
    rules = [("too early", F.col("date") < 2005), ("after cut-off", F.col("date") > 2024), ("too short", F.char_length("text") < 400), ("off topic", ~F.lower("text").rlike("th.*er"))]
    return N.funnel(N.screened(checkpointed(rows), rules))


BOUNDS = M.poisson_bounds()


@query(f"""WITH {SCORES}, c(h, l) AS (VALUES {', '.join(map(str, M.CONTRASTS))}),
    s AS (SELECT h || '-' || l AS contrast, a.doc_id AS cluster, sum(a.score - b.score) AS s, count(*) AS c FROM c JOIN scores a ON a.arm = h JOIN scores b ON b.arm = l AND a.doc_id = b.doc_id AND a.dimension = b.dimension GROUP BY ALL),
    w AS (SELECT contrast, i, s, c, len(list_filter({BOUNDS}, lambda b: b <= u)) AS w FROM (SELECT *, {DRAW.format('i', 'cluster', M.HASHES)} AS u FROM s, range(1, 201) r(i))),
    m AS (SELECT contrast, i, sum(w * s) / sum(w * c) AS m FROM w WHERE w > 0 GROUP BY ALL),
    t AS (SELECT contrast, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(least(1.0, 2 * least((count_if(m <= 1e-12) + 1) / (count(*) + 1), (count_if(m >= -1e-12) + 1) / (count(*) + 1))), 6) AS p_value FROM m GROUP BY contrast),
    k AS (SELECT *, row_number() OVER (ORDER BY p_value, contrast) AS k, count(*) OVER () AS n FROM t), h AS (SELECT *, round(max(least(1.0, p_value * (n - k + 1))) OVER (ORDER BY k), 6) AS adjusted FROM k),
    z AS (SELECT contrast, count(*) AS n_clusters, sum(c)::BIGINT AS n_pairs, round(sum(s) / sum(c), 6) AS mean_diff FROM s GROUP BY contrast)
    SELECT contrast, n_clusters, n_pairs, mean_diff, low, high, p_value, adjusted FROM z JOIN h USING (contrast)""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return M.paired_bootstrap(scores_of(spark, d))


FROZEN = ["doc_id", "text", "lang", "source", "n_chars"]


@query("""WITH a AS (SELECT doc_id // 16 AS range_no, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id // 16 AS range_no, count(*) FILTER (doc_id % 89 <> 5) AS n, count_if(doc_id % 89 = 5)::BIGINT AS gone, count_if(doc_id % 97 = 3 AND doc_id % 89 <> 5)::BIGINT AS changed FROM documents GROUP BY 1)
    SELECT range_no, a.n AS rows_then, b.n AS rows_now, gone AS n_gone, changed AS n_changed FROM a JOIN b USING (range_no) WHERE gone + changed > 0""")
def freeze_changes(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a later state of them in which some texts differ and some rows are gone: ranges by the trees, rows in those ranges alone."""
    then = docs_of(spark, d).select(*FROZEN)
    text = F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = then.where("doc_id % 89 <> 5").withColumn("text", text)
    ranges = staged(S.changed_ranges(staged(S.freeze_tree(then, "doc_id", FROZEN), "tree"), staged(S.freeze_tree(now, "doc_id", FROZEN), "tree")), "ranges")
    rows = S.changed_rows(then, now, ranges, "doc_id", FROZEN).groupBy(F.floor(F.col("doc_id") / 16).cast("long").alias("range_no"))
    found = rows.agg(F.count_if(F.col("change") == "gone").alias("n_gone"), F.count_if(F.col("change") == "changed").alias("n_changed"))
    return ranges.join(found, "range_no").select("range_no", "rows_then", "rows_now", "n_gone", "n_changed")


GRAPH = """c AS (SELECT 'K' || item_id AS id, text FROM benchmark), e AS (
        SELECT DISTINCT c.id AS src_id, 'claim' AS src_kind, b.evidence_id AS dst_id, 'block' AS dst_kind FROM c JOIN blocks b ON contains(b.text, c.text)
        UNION ALL SELECT evidence_id, 'block', doc_id, 'document' FROM blocks
        UNION ALL SELECT doc_id::VARCHAR, 'document', first::VARCHAR, 'document' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE first < doc_id
        UNION ALL SELECT doc_id::VARCHAR, 'document', source, 'source' FROM documents),
    reach AS (SELECT id AS root_id, id AS node_id, 'claim' AS kind, 0 AS hop FROM c UNION SELECT r.root_id, e.dst_id, e.dst_kind, r.hop + 1 FROM reach r JOIN e ON e.src_id = r.node_id AND e.src_kind = r.kind WHERE r.hop < 4),
    near AS (SELECT root_id, node_id, kind, min(hop)::INT AS hop FROM reach GROUP BY ALL)"""


def graph_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, typed edges and what each claim reaches: items of the benchmark as claims, the blocks that hold them, documents, first copies and sources."""
    blocks, docs, items = checkpointed(blocks_of(spark, d).select("evidence_id", "doc_id", "text")), docs_of(spark, d), table(spark, d, "benchmark")
    claim = F.concat(F.lit("K"), F.col("item_id").cast("string"))
    edge = lambda df, a, ka, b, kb: df.select(a.alias("src_id"), F.lit(ka).alias("src_kind"), b.alias("dst_id"), F.lit(kb).alias("dst_kind"))
    ids = docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", "source", X.sha256(F.col("text")).alias("digest"))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"))  # copies meet by hash, and partly before the exchange
    copies = ids.join(first, "digest").where("first < doc_id")
    edges = edge(V.find_quotes(items, blocks), claim, "claim", F.col("id"), "block").distinct()
    edges = edges.unionByName(edge(blocks, F.col("evidence_id"), "block", F.col("doc_id"), "document")).unionByName(edge(copies, F.col("id"), "document", F.col("first").cast("string"), "document")).unionByName(edge(ids, F.col("id"), "document", F.col("source"), "source"))
    edges = checkpointed(edges)
    node = lambda df, i, kind: df.select(i.alias("node_id"), F.lit(kind).alias("kind"))
    nodes = node(items, claim, "claim").unionByName(node(blocks, F.col("evidence_id"), "block")).unionByName(node(ids, F.col("id"), "document"))
    return nodes, edges, S.reach(edges, nodes.where("kind = 'claim'"), 4, lambda df, name: checkpointed(df))


@query(f"WITH RECURSIVE {BLOCKS}, {GRAPH} SELECT root_id, node_id, kind, hop FROM near")
def trace_reach(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d)[2]


@query(f"""WITH RECURSIVE {BLOCKS}, {GRAPH}, n AS (SELECT id AS node_id, 'claim' AS kind FROM c UNION ALL SELECT evidence_id, 'block' FROM blocks UNION ALL SELECT doc_id::VARCHAR, 'document' FROM documents)
    SELECT node_id, kind, 'orphan' AS fault FROM n WHERE kind <> 'claim' AND NOT EXISTS (SELECT 1 FROM e WHERE dst_id = node_id AND dst_kind = kind)
    UNION ALL SELECT id, 'claim', 'dead end' FROM c WHERE id NOT IN (SELECT root_id FROM near WHERE kind = 'source')""")
def trace_faults(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, reached = graph_of(spark, d)
    return S.loose_ends(nodes, edges, checkpointed(reached), "source")


HISTORY = "SELECT DISTINCT lang AS dimension, 'L' || (n_chars % 6)::VARCHAR AS label FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL"


@query(f"""WITH l AS ({HISTORY}), h AS (SELECT dimension, label, CASE WHEN label = 'L5' THEN 2 ELSE 1 END AS since, CASE WHEN label = 'L2' THEN 3 WHEN label = 'L4' THEN 2 END AS until FROM l UNION ALL SELECT dimension, label, 4, NULL FROM l WHERE label = 'L4'),
    r AS (SELECT (1 + doc_id % 4)::INT AS version, lang AS dimension, 'L' || (n_chars % 6)::VARCHAR AS label FROM documents),
    x AS (SELECT r.*, under FROM r, (VALUES (1), (2), (3), (4)) v(under) WHERE under >= version)
    SELECT version, under, dimension, count(*) AS n, count_if(EXISTS (SELECT 1 FROM h WHERE h.dimension = x.dimension AND h.label = x.label AND since <= under AND (until IS NULL OR under < until)))::BIGINT AS n_legal FROM x GROUP BY ALL""")
def legal_versions(spark: SparkSession, d: str) -> DataFrame:
    """Labels of documents under each schema version from their own on: one label comes late, one goes, one goes and comes back."""
    label = F.concat(F.lit("L"), (F.col("n_chars") % 6).cast("string"))
    records = docs_of(spark, d).select((1 + F.col("doc_id") % 4).cast("int").alias("version"), F.col("lang").alias("dimension"), label.alias("label"))
    known = records.where("dimension is not null and label is not null").select("dimension", "label").distinct()
    first = known.select("dimension", "label", F.when(F.col("label") == "L5", 2).otherwise(1).alias("since"), F.when(F.col("label") == "L2", 3).when(F.col("label") == "L4", 2).alias("until"))
    history = first.unionByName(known.where("label = 'L4'").select("dimension", "label", F.lit(4).alias("since"), F.lit(None).cast("int").alias("until")))
    return V.legal_versions(records, history, (1, 2, 3, 4))


@query("""WITH g AS (SELECT lang, avg(toxic) AS prevalence, count(*) / count(DISTINCT source) AS cluster_size FROM labels JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, round(prevalence, 6) AS prevalence, round(1 + (cluster_size - 1) * 0.1::DOUBLE, 6) AS design_effect,
        ceil(round(power(1.959964::DOUBLE + 0.841621::DOUBLE, 2) * 2 * prevalence * (1 - prevalence) / 0.0025::DOUBLE * (1 + (cluster_size - 1) * 0.1::DOUBLE), 6))::BIGINT AS n_needed FROM g""")
def sample_size(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "labels").join(docs_of(spark, d), "doc_id")
    groups = both.groupBy("lang").agg(F.avg("toxic").alias("prevalence"), (F.count("*") / F.count_distinct("source")).alias("cluster_size"))
    return M.sample_size(groups, effect=0.05, rho=0.1).select("lang", M.six(F.col("prevalence")).alias("prevalence"), "design_effect", "n_needed")


@query("""WITH s AS (SELECT doc_id, n_chars % 17 / 16.0::DOUBLE AS a, n_chars % 13 / 12.0::DOUBLE AS b, n_chars % 11 / 10.0::DOUBLE AS c FROM documents),
    f AS (SELECT doc_id, 'context_relevance' AS facet, a AS score FROM s UNION ALL SELECT doc_id, 'faithfulness', b FROM s UNION ALL SELECT doc_id, 'answer_relevance', c FROM s)
    SELECT facet, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS mean_human, round(avg(abs(score - quality)), 6) AS mean_abs_diff, round(corr(score, quality), 4) AS correlation FROM f JOIN labels USING (doc_id) GROUP BY facet""")
def facet_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Lengths stand in for a judge's scores: mechanics only."""
    scores = docs_of(spark, d).select("doc_id", *[(F.col("n_chars") % m / F.lit(m - 1.0)).alias(n) for m, n in ((17, "context_relevance"), (13, "faithfulness"), (11, "answer_relevance"))])
    return M.facet_calibration(scores, table(spark, d, "labels").select("doc_id", F.col("quality").alias("human")))
