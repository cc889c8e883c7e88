"""Queries over records that are derived from the given tables by SQL which both engines run alike.

The tables hold no sections, records, reviews or claims, so these are made from documents, labels, conversations, events and orders by
arithmetic: it exercises mechanics on whole tables and claims nothing about their meaning. Parameters of a method (weights of a
scheme, prices, patterns) are stated as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOT_ADDRESSED
from ..functions import text as X
from ..operators import chunking as C
from ..operators import metrics as M
from ..operators import protocol as P
from ..operators import synthesis as S
from ..operators import validate as V
from ..sources.tables import TABLES, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(names: str, values: str) -> str:
    return f"SELECT * FROM (VALUES {values}) AS t({names})"


def given(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """Rows of ``sql`` over the tables of ``d``, which is what DuckDB is given too."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def split(df: DataFrame, *names: str) -> DataFrame:
    """Comma-separated ids as arrays; an empty text is an empty array."""
    for n in names:
        df = df.withColumn(n, F.filter(F.split(n, ","), lambda x: x != ""))
    return df


# ---- sections and text

SECTIONS = """SELECT source AS doc_id, 's' || CAST(doc_id AS STRING) AS section_id, CAST(NULL AS STRING) AS parent_id, CAST(1 + doc_id % 11 % 9 AS INT) AS depth, CAST(doc_id AS INT) AS ord,
    CASE doc_id % 7 WHEN 0 THEN 'Introduction ' WHEN 1 THEN 'Notes ' WHEN 2 THEN 'Coupled model ' WHEN 3 THEN 'Grid ' WHEN 4 THEN 'Simulation ' WHEN 5 THEN 'References ' ELSE 'Case ' END || lang AS title FROM documents"""
ZONE_SQL = """CASE WHEN regexp_matches(lower(title), 'abstract|introduction|background|summary') THEN 'A' WHEN regexp_matches(lower(title), 'model|architecture|mechanism|coupling|equation|method|framework') THEN 'B'
    WHEN regexp_matches(lower(title), 'metric|simulation|warning|control|result|evaluation|experiment') THEN 'C' WHEN regexp_matches(lower(title), 'case|social|discussion|limit|conclusion|community') THEN 'D' END"""
ZONED = rf"""s AS ({SECTIONS}), k AS (SELECT *, {ZONE_SQL} AS own FROM s WHERE NOT regexp_matches(lower(title), '^\W*(references|bibliography|acknowledge?ments?|author bio|biograph)')),
    kp AS (SELECT x.doc_id, x.section_id, any_value(x.own) AS own, 's' || max(y.ord) AS parent FROM k x LEFT JOIN k y ON y.doc_id = x.doc_id AND y.ord < x.ord AND y.depth < x.depth GROUP BY ALL),
    up AS (SELECT doc_id, section_id, own, parent, own AS zone FROM kp UNION ALL SELECT u.doc_id, u.section_id, u.own, p.parent, p.own FROM up u JOIN kp p ON p.doc_id = u.doc_id AND p.section_id = u.parent WHERE u.zone IS NULL),
    z AS (SELECT doc_id, section_id, any_value(own) AS own, max(zone) AS zone FROM up GROUP BY ALL)"""


@query(f"WITH RECURSIVE {ZONED} SELECT doc_id, section_id, coalesce(zone, 'D') AS zone, CASE WHEN own IS NOT NULL THEN 'keyword' WHEN zone IS NOT NULL THEN 'inherited' ELSE 'fallback' END AS zone_source FROM z")
def zone_classify(spark: SparkSession, d: str) -> DataFrame:
    return C.zone_classify(given(spark, d, SECTIONS))


@query(f"WITH RECURSIVE {ZONED} SELECT z.doc_id, coalesce(z.zone, 'D') AS zone, len(regexp_split_to_array(string_agg(title, chr(10) ORDER BY ord), '\\s+'))::INT AS n_words, sha256(string_agg(title, chr(10) ORDER BY ord)) AS zone_sha256 FROM z JOIN s USING (doc_id, section_id) GROUP BY ALL")
def zone_word_counts(spark: SparkSession, d: str) -> DataFrame:
    s = given(spark, d, SECTIONS)
    z = C.zone_classify(s).join(s.select("doc_id", "section_id", "ord", F.col("title").alias("text")), ["doc_id", "section_id"])
    return C.zone_slices(z).select("doc_id", "zone", "n_words", "zone_sha256")


GLYPHS = """SELECT source AS doc_id, doc_id AS page, text || CASE doc_id % 5 WHEN 0 THEN ' ⟦PDF_GLYPH_U+F8E5⟧ and ⟦PDF_GLYPH_U+F8E5⟧' WHEN 1 THEN '⟦PDF_GLYPH_U+1F600⟧' WHEN 2 THEN '⟦PDF_GLYPH_U+E001⟧⟦PDF_GLYPH_U+F8E5⟧' ELSE '' END AS body FROM documents"""


@query(f"WITH g AS ({GLYPHS}), x AS (SELECT doc_id, page, unnest(regexp_extract_all(body, '⟦PDF_GLYPH_U\\+([0-9A-F]{{4,6}})⟧', 1)) AS codepoint FROM g) SELECT doc_id, page, codepoint, count(*) AS n FROM x GROUP BY ALL")
def glyph_warnings(spark: SparkSession, d: str) -> DataFrame:
    g = given(spark, d, GLYPHS).select("doc_id", "page", F.explode(X.glyphs(F.col("body"))).alias("codepoint"))
    return g.groupBy("doc_id", "page", "codepoint").agg(F.count("*").alias("n"))


HYPHENS = "SELECT doc_id AS id, replace(replace(text, ' th', chr(173) || chr(10) || 'th'), ' e', chr(173) || 'e') AS body FROM documents"


@query(f"SELECT id, sha256(regexp_replace(body, chr(173) || chr(10), '', 'g')) AS repaired FROM ({HYPHENS})")
def hyphen_repair(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, HYPHENS).select("id", X.sha256(X.join_hyphenated(F.col("body"))).alias("repaired"))


COMPLETIONS = """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN '<think>maybe {"label": "x"}</think>{"label": "' || role || '", "confidence": 0.5}' WHEN 1 THEN 'Sure: {"label": "L' || CAST(turn AS STRING) || '", "confidence": 1.0} done'
    WHEN 2 THEN replace(replace(text, '{', ' '), '}', ' ') WHEN 3 THEN '{"label": null}' END AS content FROM conversations"""


@query(f"WITH c AS ({COMPLETIONS}), j AS (SELECT conv_id, turn, nullif(regexp_extract(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), '(?s)\\{{.*\\}}'), '') AS js FROM c) SELECT conv_id, turn, js AS json, json_extract_string(js, '$.label') AS label, json_extract_string(js, '$.confidence')::DOUBLE AS confidence FROM j")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    p = P.parsed(given(spark, d, COMPLETIONS), "label string, confidence double")
    return p.select("conv_id", "turn", "json", "record.label", "record.confidence")


TRAPS = "SELECT doc_id AS id, text AS body FROM documents"


@query(f"WITH t AS ({TRAPS}) SELECT id, CASE WHEN instr(lower(body), 'thing ') > 0 THEN substr(body, greatest(instr(lower(body), 'thing ') - 40, 1), 86) END AS around FROM t")
def keyword_trap(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, TRAPS).select("id", X.keyword_trap(F.col("body"), "thing ").alias("around"))


YEARS = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS year_print, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) + o_orderkey % 2 END AS year_online, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS year_doi FROM orders"


@query(f"WITH y AS ({YEARS}) SELECT *, len(list_distinct(list_filter([year_print, year_online, year_doi], lambda x: x IS NOT NULL))) > 1 AS year_conflict FROM y")
def year_conflict(spark: SparkSession, d: str) -> DataFrame:
    return V.year_conflict(given(spark, d, YEARS))


# ---- records

BLOCKS = "SELECT 'E' || CAST(doc_id AS STRING) AS evidence_id, source AS doc_id, lang AS section_id, doc_id % 9 AS page, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS zone, text AS body FROM documents"
CITED = """SELECT source AS doc_id, 'D0' || CAST(1 + (doc_id + n_chars) % 9 AS STRING) AS dimension, 'E' || CAST(CASE WHEN doc_id % 8 = 7 THEN doc_id + 100000000 WHEN doc_id % 8 = 3 THEN doc_id + 1 ELSE doc_id END AS STRING) AS evidence_id, CASE WHEN doc_id % 6 = 5 THEN 'xx' ELSE lang END AS section_id,
    CASE WHEN doc_id % 10 = 9 THEN 99 ELSE doc_id % 9 END AS page, substr(text, CAST(1 + floor(n_chars / 3) AS INT), 30) AS verbatim_quote FROM documents WHERE n_chars > 0"""
RECORDS = """SELECT d.doc_id, 'D0' || CAST(1 + d.doc_id % 9 AS STRING) AS dimension, CASE WHEN d.doc_id % 9 = 3 THEN 'Not_Addressed' WHEN d.n_chars % 6 = 0 THEN 'Not_Stated_In_Text' ELSE 'L' || CAST(d.n_chars % 6 AS STRING) END AS label, CASE WHEN d.doc_id % 2 = 0 THEN 'v1.0' ELSE 'v1.1' END AS schema_version,
    CASE WHEN l.quality = 1 THEN 'accept' WHEN l.quality = 0 THEN 'revise' ELSE 'insufficient_evidence' END AS decision, l.toxic = 1 AS adjudication_required FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
REGISTRY = """SELECT DISTINCT v.schema_version, r.dimension, r.label FROM (SELECT 'D0' || CAST(1 + doc_id % 9 AS STRING) AS dimension, CASE WHEN doc_id % 9 = 3 THEN 'Not_Addressed' WHEN n_chars % 6 = 0 THEN 'Not_Stated_In_Text' ELSE 'L' || CAST(n_chars % 6 AS STRING) END AS label FROM documents) r,
    (VALUES ('v1.0'), ('v1.1')) AS v(schema_version) WHERE v.schema_version = 'v1.0' OR r.label <> 'L2'"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, BLOCKS).withColumnRenamed("body", "text")


@query(f"WITH b AS ({BLOCKS}), c AS ({CITED}) SELECT c.* FROM c WHERE evidence_id NOT IN (SELECT evidence_id FROM b)")
def evidence_fk(spark: SparkSession, d: str) -> DataFrame:
    return V.evidence_fk(given(spark, d, CITED), blocks(spark, d))


@query(f"WITH b AS ({BLOCKS}), c AS ({CITED}) SELECT c.*, b.section_id AS block_section, b.page AS block_page FROM c JOIN b USING (evidence_id) WHERE c.section_id <> b.section_id OR c.page <> b.page")
def section_page_trace(spark: SparkSession, d: str) -> DataFrame:
    return V.section_page_trace(given(spark, d, CITED), blocks(spark, d))


CHECKED = f"""b AS ({BLOCKS}), c AS ({CITED}), k AS (SELECT c.*, coalesce(instr(b.body, c.verbatim_quote), 0) > 0 AS quote_ok, coalesce(c.page = b.page, false) AS page_ok, coalesce(c.section_id = b.section_id, false) AS section_ok, b.evidence_id IS NOT NULL AS found FROM c LEFT JOIN b ON b.evidence_id = c.evidence_id)"""


@query(f"WITH {CHECKED} SELECT count(*) AS n, round(avg(found::INT), 6) AS sufficiency, round(avg(quote_ok::INT), 6) AS quote_exact, round(avg(page_ok::INT), 6) AS page_accuracy, round(avg(section_ok::INT), 6) AS section_accuracy, round(avg((quote_ok AND page_ok)::INT), 6) AS citation_precision, round(1 - avg((quote_ok AND page_ok)::INT), 6) AS unsupported_rate FROM k")
def evidence_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    places = b.select("evidence_id", F.col("page").alias("__p"), F.col("section_id").alias("__s"))
    k = V.quote_check(given(spark, d, CITED), b).join(places, "evidence_id", "left")
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    k = k.withColumns({"sufficient": F.col("__p").isNotNull(), "page_ok": same("page", "__p"), "section_ok": same("section_id", "__s")})
    return M.evidence_metrics(k.withColumn("supported", F.col("quote_ok") & F.col("page_ok")))


@query(f"WITH b AS ({BLOCKS}), c AS ({CITED}) SELECT c.doc_id, dimension FROM c JOIN b USING (evidence_id) WHERE dimension BETWEEN 'D02' AND 'D09' GROUP BY c.doc_id, dimension HAVING bool_and(zone = 'A')")
def zone_limits(spark: SparkSession, d: str) -> DataFrame:
    r = given(spark, d, CITED).groupBy("doc_id", "dimension").agg(F.collect_list(F.struct("evidence_id")).alias("evidence"))
    return V.zone_limits(r, blocks(spark, d))


@query(f"WITH r AS ({RECORDS}) SELECT * FROM r WHERE dimension <> 'D03'")
def active_records(spark: SparkSession, d: str) -> DataFrame:
    return V.active_records(given(spark, d, RECORDS))


QUARANTINE = "SELECT doc_id, 'D0' || CAST(1 + doc_id % 9 AS STRING) AS dimension FROM labels WHERE toxic = 1"


@query(f"WITH r AS ({RECORDS}), q AS ({QUARANTINE}) SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 'active' ELSE 'quarantined' END AS state FROM r LEFT JOIN q USING (doc_id, dimension)")
def quarantine_status(spark: SparkSession, d: str) -> DataFrame:
    return V.quarantined(given(spark, d, RECORDS), given(spark, d, QUARANTINE))


@query(f"WITH r AS ({RECORDS}) SELECT * FROM r WHERE decision = 'accept' AND adjudication_required = false")
def verified_only(spark: SparkSession, d: str) -> DataFrame:
    return S.verified_only(given(spark, d, RECORDS))


@query(f"WITH r AS ({RECORDS}), g AS ({REGISTRY}) SELECT r.* FROM r WHERE schema_version = 'v1.0' AND NOT EXISTS (SELECT 1 FROM g WHERE g.schema_version = 'v1.1' AND g.dimension = r.dimension AND g.label = r.label)")
def schema_compat(spark: SparkSession, d: str) -> DataFrame:
    return V.schema_compat(given(spark, d, RECORDS), given(spark, d, REGISTRY), "v1.0", "v1.1")


@query(f"WITH r AS ({RECORDS}) SELECT dimension, count(*) AS n FROM r GROUP BY dimension HAVING bool_and(label = '{NOT_ADDRESSED}')")
def universal_gap(spark: SparkSession, d: str) -> DataFrame:
    return S.universal_gap(given(spark, d, RECORDS))


REVIEWS = "SELECT event_id AS doc_id, CASE event_id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'maybe' WHEN 2 THEN 'revise' WHEN 3 THEN 'reject' WHEN 4 THEN 'insufficient_evidence' END AS decision, CASE WHEN event_id % 5 <> 0 THEN value / 50 END AS confidence FROM events"


@query(f"WITH r AS ({REVIEWS}), f AS (SELECT *, CASE WHEN decision IS NULL OR decision NOT IN ('accept', 'revise', 'reject', 'insufficient_evidence') THEN 'decision' WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END AS fault FROM r) SELECT * FROM f WHERE fault IS NOT NULL")
def critic_faults(spark: SparkSession, d: str) -> DataFrame:
    return V.critic_faults(given(spark, d, REVIEWS))


LEDGER = "SELECT source AS doc_id, 'D' || CAST(doc_id % 10 AS STRING) AS dimension, CASE WHEN lang = 'en' OR doc_id % 3 > 0 THEN 'real' ELSE 'mock' END AS origin FROM documents"


@query(f"WITH l AS ({LEDGER}), k AS (SELECT doc_id, count(DISTINCT dimension) AS k, bool_and(origin = 'real') AS r FROM l GROUP BY doc_id) SELECT count(*) AS n_docs, min(k) AS least_dimensions, bool_and(r) AS all_real, count(*) = 5 AND min(k) = 10 AND bool_and(r) AS accepted FROM k")
def complete_sample_gate(spark: SparkSession, d: str) -> DataFrame:
    return V.complete_sample_gate(given(spark, d, LEDGER))


SCREENED = "SELECT d.doc_id AS id, CASE WHEN f.first_id < d.doc_id THEN 'duplicate' WHEN d.n_chars < 300 THEN 'too short' WHEN l.quality = 0 THEN 'off topic' END AS reason FROM documents d JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) f ON f.text = d.text LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query(f"WITH s AS ({SCREENED}) SELECT coalesce(reason, 'included') AS reason, count(*) AS n FROM s GROUP BY 1")
def screening_funnel(spark: SparkSession, d: str) -> DataFrame:
    return V.screening_funnel(given(spark, d, SCREENED))


CHECKS = """SELECT 'clean' AS check_name, avg(CAST(1 - toxic AS DOUBLE)) AS value, CAST(0.5 AS DOUBLE) AS threshold, true AS at_least FROM labels UNION ALL SELECT 'quality', avg(CAST(quality AS DOUBLE)), CAST(0.99 AS DOUBLE), true FROM labels
    UNION ALL SELECT 'errors', avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), CAST(0.5 AS DOUBLE), false FROM events UNION ALL SELECT 'cost', max(CASE WHEN value > 1000000 THEN value END), CAST(5 AS DOUBLE), false FROM events"""


@query(f"WITH c AS ({CHECKS}), k AS (SELECT coalesce(CASE WHEN at_least THEN value >= threshold ELSE value <= threshold END, false) AS ok FROM c) SELECT count(*) AS n_checks, count(*) FILTER (NOT ok) AS n_failed, bool_and(ok) AS passed FROM k")
def pilot_gate(spark: SparkSession, d: str) -> DataFrame:
    return V.gate(given(spark, d, CHECKS))


FIRST = "SELECT doc_id, lang AS dimension, 'L' || CAST(n_chars % 4 AS STRING) AS label, 'E' || CAST(doc_id AS STRING) || ',E' || CAST(doc_id + 1 AS STRING) AS evidence_ids FROM documents"
FINAL = "SELECT doc_id, lang AS dimension, 'L' || CAST(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE n_chars % 4 END AS STRING) AS label, 'E' || CAST(doc_id + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS STRING) || ',E' || CAST(doc_id AS STRING) AS evidence_ids FROM documents"


@query(f"WITH a AS ({FIRST}), b AS ({FINAL}) SELECT CASE WHEN a.label <> b.label THEN 'primary_label' WHEN list_sort(string_split(a.evidence_ids, ',')) <> list_sort(string_split(b.evidence_ids, ',')) THEN 'evidence' ELSE 'unchanged' END AS kind, count(*) AS n FROM a JOIN b USING (doc_id, dimension) GROUP BY 1")
def revision_kinds(spark: SparkSession, d: str) -> DataFrame:
    return M.revision_kinds(split(given(spark, d, FIRST), "evidence_ids"), split(given(spark, d, FINAL), "evidence_ids"))


SPANS = "SELECT source AS doc_id, CAST(doc_id AS STRING) AS span_id, CAST(doc_id * 37 % 20011 AS INT) AS char_start, CAST(doc_id * 37 % 20011 + n_chars % 700 AS INT) AS char_end FROM documents"


@query(f"WITH s AS ({SPANS}) SELECT x.doc_id, x.span_id AS span_a, y.span_id AS span_b, (least(x.char_end, y.char_end) - greatest(x.char_start, y.char_start)) AS overlap FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.span_id < y.span_id AND x.char_start < y.char_end AND y.char_start < x.char_end WHERE x.char_end > x.char_start AND y.char_end > y.char_start")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    return V.span_overlap(given(spark, d, SPANS))


TESTS = "SELECT source || '-' || lang AS name, round(avg(CAST(n_chars % 97 AS DOUBLE)) / 970, 6) AS p_value FROM documents GROUP BY source, lang"


@query(f"WITH t AS ({TESTS}), r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS k, count(*) OVER () AS m FROM t) SELECT name, p_value, round(max(least(1.0, p_value * (m - k + 1))) OVER (ORDER BY k), 6) AS adjusted FROM r")
def holm_correction(spark: SparkSession, d: str) -> DataFrame:
    return M.holm(given(spark, d, TESTS))


MODELS = "SELECT conv_id AS record_id, CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS agent_name, 'm' || CAST((conv_id + turn) % 4 AS STRING) AS model_name FROM conversations WHERE role <> 'system'"
FAMILIES = "SELECT DISTINCT 'm' || CAST(turn % 4 AS STRING) AS model_name, 'f' || CAST(turn % 4 % 3 AS STRING) AS family FROM conversations WHERE turn % 4 < 4"


@query(f"WITH c AS ({MODELS}), f AS ({FAMILIES}), x AS (SELECT record_id, list(DISTINCT family) FILTER (agent_name = 'A') AS a, list(DISTINCT family) FILTER (agent_name = 'B') AS b FROM c LEFT JOIN f USING (model_name) GROUP BY record_id) SELECT record_id, coalesce(len(a), 0) > 0 AND coalesce(len(b), 0) > 0 AND NOT coalesce(list_has_any(a, b), false) AS independent FROM x")
def model_independence(spark: SparkSession, d: str) -> DataFrame:
    return P.independence(given(spark, d, MODELS), given(spark, d, FAMILIES)).select("record_id", "independent")


PROMPTS = "SELECT CAST(item_id AS STRING) AS call_id, CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS agent_name, CASE WHEN item_id % 3 = 0 THEN 'first' ELSE text END AS prompt FROM benchmark"


@query(f"WITH p AS ({PROMPTS}) SELECT call_id, agent_name, 'recorded' AS provider, CASE prompt WHEN 'first' THEN '{{\"label\":\"L1\"}}' END AS content, CASE WHEN prompt <> 'first' THEN 'recorded: no stored answer' END AS failure_reason, CASE WHEN prompt = 'first' THEN 0 ELSE 1 END AS retries, sha256(prompt) AS input_hash, CASE WHEN prompt = 'first' THEN sha256('{{\"label\":\"L1\"}}') END AS output_hash FROM p")
def provider_replay(spark: SparkSession, d: str) -> DataFrame:
    import hashlib

    return P.extract(given(spark, d, PROMPTS), "recorded", retries=1, answers={hashlib.sha256(b"first").hexdigest(): '{"label":"L1"}'})


# ---- synthesis and index

CLAIMS = "SELECT 'K' || CAST(doc_id AS STRING) AS claim_id, 'E' || CAST(doc_id AS STRING) || ',E' || CAST(doc_id + 1 AS STRING) || CASE WHEN doc_id % 3 > 0 THEN ',E' || CAST(doc_id + 20 AS STRING) || ',E' || CAST(doc_id AS STRING) ELSE '' END AS supporting, CASE WHEN doc_id % 4 = 0 THEN 'E' || CAST(doc_id + 5 AS STRING) ELSE '' END AS contradicting FROM documents WHERE doc_id % 2 = 0"


def claims(spark: SparkSession, d: str) -> DataFrame:
    return split(given(spark, d, CLAIMS), "supporting", "contradicting")


LONG = f"b AS ({BLOCKS}), c AS ({CLAIMS}), x AS (SELECT DISTINCT claim_id, unnest(list_filter(string_split(supporting, ','), lambda s: s <> '')) AS evidence_id FROM c)"


@query(f"""WITH {LONG}, y AS (SELECT claim_id, count(b.doc_id) AS n_evidence, count(DISTINCT b.doc_id) AS n_docs, count(*) FILTER (x.evidence_id IS NOT NULL AND b.doc_id IS NULL) AS n_dangling FROM c LEFT JOIN x USING (claim_id) LEFT JOIN b ON b.evidence_id = x.evidence_id GROUP BY claim_id)
    SELECT claim_id, n_evidence, n_docs, n_dangling, len(list_distinct(list_filter(string_split(contradicting, ','), lambda s: s <> '')))::INT AS n_contradicting, n_evidence >= 3 AS enough_evidence, n_docs <= 1 AS single_document FROM y JOIN c USING (claim_id)""")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    return S.claim_support(claims(spark, d), blocks(spark, d))


@query(f"WITH {LONG} SELECT claim_id, doc_id, count(*) AS n_blocks FROM x JOIN b USING (evidence_id) GROUP BY ALL")
def trace_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.trace(claims(spark, d), blocks(spark, d))


@query(f"WITH {LONG} SELECT claim_id AS src_id, 'claim' AS src_kind, evidence_id AS dst_id, 'block' AS dst_kind, 'supported_by' AS relation FROM x UNION ALL SELECT evidence_id, 'block', doc_id, 'document', 'part_of' FROM b WHERE evidence_id IN (SELECT evidence_id FROM x)")
def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.trace_edges(claims(spark, d), blocks(spark, d))


PARTS = """SELECT source AS direction, lang AS year_basis, round(avg(CAST(n_chars % 11 AS DOUBLE)) / 10, 3) AS esi, round(avg(CAST(n_chars % 7 AS DOUBLE)) / 6, 3) AS tgm, round(avg(CAST(n_chars % 5 AS DOUBLE)) / 4, 3) AS lci FROM documents GROUP BY source, lang"""
WEIGHTS = rows("scheme, w1, w2, w3", "('primary', CAST(0.4 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.3 AS DOUBLE)), ('scarcity', CAST(0.6 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.2 AS DOUBLE)), ('momentum', CAST(0.2 AS DOUBLE), CAST(0.6 AS DOUBLE), CAST(0.2 AS DOUBLE))")
FRDI = f"c AS ({PARTS}), w AS ({WEIGHTS}), f AS (SELECT *, round(w1 * esi + w2 * tgm + w3 * lci, 6) AS frdi FROM c, w), r AS (SELECT *, (rank() OVER (PARTITION BY scheme, year_basis ORDER BY frdi DESC NULLS LAST))::INT AS rank FROM f)"


@query(f"WITH {FRDI} SELECT direction, scheme, year_basis, esi, tgm, lci, frdi, rank FROM r")
def frdi(spark: SparkSession, d: str) -> DataFrame:
    return S.frdi(given(spark, d, PARTS), given(spark, d, WEIGHTS)).select("direction", "scheme", "year_basis", "esi", "tgm", "lci", "frdi", "rank")


@query(f"WITH {FRDI}, l AS (SELECT *, max(rank) OVER (PARTITION BY scheme, year_basis) AS last FROM r) SELECT direction, count(*) AS n_scenarios, min(rank) AS best_rank, max(rank) AS worst_rank, count(*) FILTER (rank = 1) AS n_first, count(*) FILTER (rank = last) AS n_last FROM l GROUP BY direction")
def frdi_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return S.frdi_sensitivity(S.frdi(given(spark, d, PARTS), given(spark, d, WEIGHTS)))


ASSESSED = "SELECT o_orderpriority AS direction, o_orderkey % 3 = 0 AS positive, year(o_orderdate) AS yr, CAST(o_custkey % 101 AS DOUBLE) / 100 AS share, CAST(o_orderkey % 4 AS INT) AS score FROM orders"


@query(f"WITH a AS ({ASSESSED}), g AS (SELECT direction, round(1 - avg(positive::INT), 6) AS esi, regr_slope(share, yr) AS b, round(avg(score) / 3, 6) AS lci FROM a GROUP BY direction) SELECT direction, esi, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS tgm, lci FROM g")
def frdi_components(spark: SparkSession, d: str) -> DataFrame:
    a = given(spark, d, ASSESSED)
    return S.scarcity(a).join(S.momentum(a.withColumnRenamed("yr", "year")), "direction").join(S.integration(a), "direction")


RANKS = "SELECT n_chars % 50 AS a, n_chars % 50 + doc_id % 20 AS b FROM documents"


@query(f"WITH r AS ({RANKS}), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM r) SELECT round(corr(x, y), 6) AS rho FROM k")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return S.spearman(given(spark, d, RANKS), "a", "b")
