"""The evidence engine: every query against its SQL, and operators on the awkward cases."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelode import schemas
from tracelode.config import ARMS, CONFIG, MISSING_STATES
from tracelode.functions import text as X
from tracelode.operators import chunking as C
from tracelode.operators import dense
from tracelode.operators import metrics as M
from tracelode.operators import protocol as P
from tracelode.operators import retrieval as R
from tracelode.operators import synthesis as S
from tracelode.operators import validate as V
from tracelode.plans import catalog
from tracelode.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in T.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_entry_gives_ranked_documents(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "id", "score", "rank"] and out.count() > 0


def test_schemas_cover_all_entities_and_refuse_unknown_columns(spark):
    assert len(schemas.NAMES) == 22 and all(schemas.schema(n).fields for n in schemas.NAMES)
    row = spark.createDataFrame([("E1", "t")], "evidence_id string, term string")
    assert schemas.conform(row, "posting").first().tf is None
    with pytest.raises(ValueError, match="no column"):
        schemas.conform(row, "doc_len")


def test_configuration_changes_only_by_version():
    assert CONFIG.digest() == CONFIG.digest() != CONFIG.next_version("m0.2", top_k=5).digest()
    with pytest.raises(ValueError, match="new version"):
        CONFIG.next_version(CONFIG.version, top_k=5)
    assert [a[0] for a in ARMS] == ["G0", "G1", "G2", "G3", "G4", "G5"] and len(set(MISSING_STATES)) == 5


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_chunks_cover_texts_and_keep_the_cap(spark):
    texts = ["", None, words(39), words(240), words(241), words(700), "\n".join(words(n) for n in (180, 1, 79, 80, 0, 240, 61, 39)), " a 𝒳 b\n\n c ", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units = C.units(docs)
    by = {}
    for r in units.orderBy("doc_id", "line_no", "piece_no").collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        if t:
            cut = "".join(t[r["char_start"] : r["char_end"]] for r in by[i])
            assert cut == t.replace("\n", "") and all(r["n_words"] <= CONFIG.chunk_cap for r in by[i])
    chunks = C.chunk_greedy(units)
    got = {}
    for r in C.evidence_blocks(docs, chunks).orderBy("doc_id", "ord").collect():
        got.setdefault(int(r["doc_id"]), []).append(r)
        assert r["text"] == texts[int(r["doc_id"])][r["char_start"] : r["char_end"]] and 0 < r["n_words"] <= CONFIG.chunk_cap
    for i, t in enumerate(texts):
        assert [w for r in got.get(i, []) for w in r["text"].split()] == (t or "").split()
    assert [r["n_words"] for r in got[6]] == [180, 160, 240, 100]


def test_coverage_leaves_no_block_out(spark):
    blocks = spark.createDataFrame([("d", i, f"e{i}", 150 + i) for i in range(60)] + [("x", 0, "x0", 5000)], "doc_id string, ord int, evidence_id string, n_words int")
    windows = C.coverage_pass(blocks, 1000)
    assert C.uncovered(blocks, windows).count() == 0
    assert windows.groupBy("doc_id", "window_no").agg(F.sum("n_words").alias("n")).where("doc_id = 'd' and n > 1300").count() == 0


def test_budgets_at_and_over_the_edge(spark):
    rows = [("q", 1, "a", 700), ("q", 2, "b", 100), ("q", 3, "c", 1), ("r", 1, "d", 801)]
    got = C.context_budget(spark.createDataFrame(rows, "query_id string, rank int, evidence_id string, n_tokens int"))
    assert {(r["query_id"], r["budget"]): r["n"] for r in got.groupBy("query_id", "budget").agg(F.count("*").alias("n")).collect()} == {("q", 800): 2, ("q", 1200): 3, ("q", 1800): 3, ("r", 1200): 1, ("r", 1800): 1}


def test_fusion_doesnt_depend_on_the_order_of_channels(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "y", 3)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    one, two = ([tuple(r) for r in R.rrf_fusion(c).orderBy("rank").collect()] for c in ([a, b], [b, a]))
    assert one == two and one[0][:3] == ("q", "y", round(1 / 61 + 1 / 62, 8)) and one[0][3] == 2


def test_bm25_of_unknown_and_repeated_terms_and_ties(spark):
    blocks = spark.createDataFrame([(2, "apple pear"), (1, "apple pear"), (3, None), (4, "")], "evidence_id long, text string")
    queries = spark.createDataFrame([("q1", "apple apple"), ("q2", "apple"), ("q3", "nothing"), ("q4", "")], "query_id string, text string")
    got = [tuple(r) for r in R.bm25_topk(queries, blocks).orderBy("query_id", "rank").select("query_id", "id", "rank").collect()]
    assert got == [("q1", 1, 1), ("q1", 2, 2), ("q2", 1, 1), ("q2", 2, 2)]


def test_dense_stand_in_is_unit_or_zero(spark):
    from tracelode.functions import vectors as VE

    rows = spark.createDataFrame([("some words here",), ("",)], "text string").select(VE.hashed_terms(F.col("text"), 16).alias("v")).select(VE.norm(F.col("v")).alias("n"), VE.cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert rows[0]["n"] == pytest.approx(1) and rows[0]["c"] == pytest.approx(1) and rows[1]["n"] == 0 and rows[1]["c"] is None


def test_hybrid_context_holds_hits_and_neighbours(spark):
    blocks = spark.createDataFrame([(f"e{i}", "d", i, t, 2) for i, t in enumerate(["alpha beta", "gamma delta", "epsilon zeta", "eta theta"])], "evidence_id string, doc_id string, ord int, text string, n_words int")
    index = R.HybridIndex(blocks)
    out = index.context(spark.createDataFrame([("q", "gamma")], "query_id string, text string"), k=1).where("budget = 800").first()
    assert set(out["evidence_ids"]) == {"e0", "e1", "e2"} and out["evidence_ids"][0] == "e1"


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["metadata_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan" in plan.split("PushedFilters")[1] and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["cluster_bootstrap", "paired_bootstrap", "corpus_cube", "freeze_verify", "label_matrix", "krippendorff_alpha"])
def test_queries_are_native(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["bm25_topk", "chunk_greedy", "rrf_fusion", "quote_exact_match", "block_hashes"])
def test_no_query_joins_all_rows_with_all_or_runs_python_by_row(spark, name):
    """Blocks, texts and postings go through Arrow batches; nothing is a nested loop over rows."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scalar_functions(spark):
    row = spark.createDataFrame([("x�", "a 𝒳 b", "𝒳", "${x}^2 = \\sum_i y_i$")], "a string, t string, q string, f string")
    got = row.select(X.has_replacement(F.col("a")).alias("lost"), X.quote_offset(F.col("t"), F.col("q")).alias("at"), X.slice_text(F.col("t"), F.lit(2), F.lit(3)).alias("cut"), X.formula_risk(F.col("f")).alias("risk"), X.n_words(F.lit("  a  b ")).alias("n")).first()
    assert tuple(got) == (True, 2, "𝒳", True, 2)
    a, b = (row.select(X.payload_hash(*c).alias("h")).first()["h"] for c in (("a", "t"), ("t", "a")))
    assert a == b


def test_faults_are_caught(spark):
    blocks = spark.createDataFrame([("E1", "s1", 1, "water cools")], "evidence_id string, section_id string, page int, text string")
    cited = spark.createDataFrame([("E1", "s1", 1, "water"), ("E1", "s1", 2, "Water"), ("E1", None, 1, ""), ("E7", "s1", 1, "water")], "evidence_id string, section_id string, page int, verbatim_quote string")
    assert [r["evidence_id"] for r in V.evidence_fk(cited, blocks).collect()] == ["E7"]
    assert V.section_page_trace(cited, blocks).count() == 2
    assert sorted((r["evidence_id"], r["quote_ok"]) for r in V.quote_check(cited, blocks).collect()) == [("E1", False), ("E1", False), ("E1", True), ("E7", False)]


def test_quotes_without_a_named_block(spark):
    blocks = spark.createDataFrame([(1, "the cold water cools the plant"), (2, "thecold water cools"), (3, None)], "evidence_id long, text string")
    quotes = spark.createDataFrame([(1, "e cold water cools t"), (2, "cold water"), (3, "no such words here"), (4, "water")], "item_id long, text string")
    assert sorted((r["item_id"], r["id"], r["quote_start"]) for r in V.find_quotes(quotes, blocks).collect()) == [(1, 1, 2), (2, 1, 4), (2, 2, 3), (4, 1, 9), (4, 2, 8)]


def test_short_quotes_equal_plain_containment(spark, monkeypatch):
    monkeypatch.setattr(V, "SCANNED", 9)
    texts = ["the cold water cools", "thecold water cools", "a!! b, cat", "concatenate", "", None]
    asked = ["cold water", "old wat", "!! ", "cat", ", ", "water", "e c", "no"]
    blocks = spark.createDataFrame(list(enumerate(texts)), "evidence_id long, text string")
    got = V.find_quotes(spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), blocks).collect()
    assert sorted(map(tuple, got)) == [(i, j, t.index(q)) for i, q in enumerate(asked) for j, t in enumerate(texts) if t and q in t]


@pytest.mark.parametrize(("docs", "origin", "ok"), [(5, "real", True), (4, "real", False), (5, "mock", False)])
def test_sample_gate(spark, docs, origin, ok):
    rows = [(f"P{i}", d, origin if (i, d) == (0, "D01") else "real") for i in range(docs) for d in CONFIG.dimensions]
    assert V.complete_sample_gate(spark.createDataFrame(rows, "doc_id string, dimension string, origin string")).first()["accepted"] is ok
    assert V.complete_sample_gate(spark.createDataFrame([], "doc_id string, dimension string, origin string")).first()["accepted"] is False


def test_providers_never_invent(spark):
    p = spark.createDataFrame([("c1", "A", "x")], "call_id string, agent_name string, prompt string")
    row = P.extract(p).first()
    assert row["content"] is None and row["failure_reason"].startswith("dry_run") and "key" not in " ".join(row.asDict())
    assert "reasoning" not in P.critic_view(p.withColumn("reasoning", F.lit("r"))).columns


def test_protocol_of_early_late_and_open_cases(spark):
    rows = [("a", 1, "A", "x"), ("a", 2, "B", "x"), ("b", 1, "A", "x"), ("b", 2, "B", "y"), ("b", 3, "A", "y"), ("b", 4, "B", "y"), ("c", 1, "A", "x"), ("c", 2, "B", "y"), ("c", 3, "A", "x"), ("c", 4, "B", "y"), ("d", 1, "A", None)]
    log = spark.createDataFrame([(d, "D01", p, a, x) for d, p, a, x in rows], "doc_id string, dimension string, pass int, agent string, label string")
    assert {r["doc_id"] for r in P.adjudication_queue(log).collect()} == {"c"}
    assert {r["doc_id"] for r in P.passes_complete(log).collect()} == {"a", "d"}


def test_kappa_and_alpha_by_hand(spark):
    pairs = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")
    assert M.cohen_kappa(pairs).first()["kappa"] == pytest.approx(0.4)
    codes = spark.createDataFrame([("u1", "a", "x"), ("u1", "b", "x"), ("u2", "a", "y"), ("u2", "b", None), ("u3", "a", "x"), ("u3", "b", "y")], "item_id string, annotator string, label string")
    assert M.krippendorff_alpha(codes).first()["alpha"] == pytest.approx(1 - 2 / (6 / 3))


def test_index_refuses_bad_weights_and_ranks_missing_last(spark):
    parts = spark.createDataFrame([("a", "y", 0.5, 0.5, 0.5), ("b", "y", None, 0.9, 0.9)], "direction string, year_basis string, esi double, tgm double, lci double")
    good = spark.createDataFrame([("s", 0.5, 0.25, 0.25)], "scheme string, w1 double, w2 double, w3 double")
    assert [(r["direction"], r["rank"]) for r in S.frdi(parts, good).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="sum to 1"):
        S.frdi(parts, spark.createDataFrame([("s", 0.5, 0.5, 0.5)], good.schema))


def test_freeze_sees_any_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    frozen = S.freeze(a, ["i", "t"])
    assert S.verify(a.orderBy(F.desc("i")), ["i", "t"], frozen).first()["unchanged"]
    assert not S.verify(spark.createDataFrame([(1, "x"), (2, "")], a.schema), ["i", "t"], frozen).first()["unchanged"]


def test_stores_runs_and_overlays(spark, tmp_path):
    blocks = spark.createDataFrame([("E1", "P1", "text"), ("E2", "P2", None)], "evidence_id string, doc_id string, text string")
    T.write_jsonl(blocks, f"{tmp_path}/j", "evidence_block")
    assert T.read_jsonl(spark, f"{tmp_path}/j", "evidence_block").count() == 2
    T.write_store(blocks, f"{tmp_path}/s", "evidence_block")
    back = T.read_store(spark, f"{tmp_path}/s", "evidence_block")
    assert back.where("doc_id = 'P1'").first()["text"] == "text"
    T.write_csv(blocks.withColumn("l", F.array(F.lit("x"))), f"{tmp_path}/c")
    run = T.Run(str(tmp_path), "r1")
    run.write(blocks, "blocks")
    with pytest.raises(Exception, match="(?i)already exists"):
        run.write(blocks, "blocks")
    with pytest.raises(ValueError, match="plain folder"):
        T.Run(str(tmp_path), "../r1")
    assert run.manifest(spark, "index", [("a", "b")], "c").first()["config_sha256"] == CONFIG.digest()
    both = T.overlay(blocks, blocks.where("doc_id = 'P2'").withColumn("text", F.lit("new")), 2)
    assert {r["doc_id"]: r["text"] for r in V.latest_version(both, ("doc_id",)).collect()} == {"P1": "text", "P2": "new"}
    assert len(T.write_workbook({"a": blocks}, f"{tmp_path}/w.xlsx", "note")) >= 1
    assert "| E1 | P1 | text |" in T.report("t", {"blocks": blocks})


def test_files_go_through_a_parser(spark, tmp_path):
    for n in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    got = T.scan_files(spark, str(tmp_path), lambda raw: [{"page": 1, "text": raw.decode()}], "page int, text string").collect()
    assert sorted(r["text"] for r in got) == ["a.pdf", "b.pdf"] and len({r["file_sha256"] for r in got}) == 2


def test_call_log_as_a_stream(spark, tmp_path):
    from tracelode.streaming import call_log as L

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    calls = L.read_calls(spark, SF, schema, pattern="events.parquet")
    L.append(L.hourly(calls), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert 0 < got.count() <= batch.count()
    assert got.join(batch.withColumn("hour", F.col("hour").cast("timestamp")), ["hour", "event_type"]).where("n <> n_calls").count() == 0


@pytest.mark.parametrize("few", [7, 10_000])
def test_cosine_of_more_queries_than_a_block_holds(spark, monkeypatch, few):
    monkeypatch.setattr(dense, "QUERIES", few)
    monkeypatch.setattr(dense, "HELD", few)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(90, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    got = R.cosine_topk(vectors.where("id % 2 = 0").withColumnRenamed("id", "query_id"), vectors, 4).collect()
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if any(v)}
    want = []
    for q in range(0, 90, 2):
        best = sorted((-round(sum(x * y for x, y in zip(unit[q], v, strict=True)), 6), i) for i, v in unit.items())[:4]
        want += [(q, i, r) for r, (_, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == sorted(want)


def test_token_counters(spark, tmp_path):
    import base64

    from tracelode.functions.tokens import RankCounter, WordCounter, with_token_counts

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    df = spark.createDataFrame([(1, "abc ab"), (2, None), (3, "")], "id long, text string")
    for counter, want in ((WordCounter(), [2, 0, 0]), (RankCounter(str(path), r"\S+|\s+", "own"), [3, 0, 0])):
        got = with_token_counts(df, counter).orderBy("id").collect()
        assert [r["n_tokens"] for r in got] == want and {r["tokenizer"] for r in got} == {counter.name}


def test_entry_without_the_training_data_queries():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and set(catalog.QUERIES) <= set(found)


def test_section_tree_of_numbered_headings(spark):
    texts = ["1 Scope", "words", "1.1 Terms", "1.1.1 Deep", "2 Method", "# Marked", "2.1.1 Orphan", "3rd of May", "end"]
    lines = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "doc_id long, ord int, text string")
    got = C.section_tree(lines.withColumn("depth", C.numbered_depth(F.col("text")))).orderBy("ord").collect()
    assert [(r["title"], r["depth"], r["parent_ord"], r["last_ord"]) for r in got] == [
        ("1 Scope", 1, None, 1), ("1.1 Terms", 2, 0, 2), ("1.1.1 Deep", 3, 2, 3), ("2 Method", 1, None, 4), ("# Marked", 1, None, 5), ("2.1.1 Orphan", 3, 5, 8),
    ]
    assert C.section_tree(C.font_depth(lines.withColumn("size", F.lit(1)))).count() == 0


def test_four_passes_review_and_revise(spark):
    import json

    def agent(prompts):
        out = []
        for p in prompts:
            n, _, quote = p.split("\n")[:3]
            assert "secret thought" not in p
            if "agent A" in n:
                out.append((json.dumps({"label": n[:6], "quote": quote if "pass 3" in n else "not there", "mechanism": "secret thought"}), None))
            elif "pass 2" in n:
                out.append((json.dumps({"decision": "reject", "critic_comment": "no quote"}), None))
            else:
                out.append((json.dumps({"decision": "accept"}) if "no quote" in p else "no json", None))
        return out

    P.PROVIDERS["scripted"] = lambda: agent
    try:
        rows = spark.createDataFrame([(1, "D01", "the text"), (2, "D02", None)], "doc_id long, dimension string, text string")
        log = P.four_passes(rows, "scripted", "scripted").orderBy("doc_id", "pass").collect()
    finally:
        del P.PROVIDERS["scripted"]
    assert [(r["doc_id"], r["pass"], r["agent"], r["label"], r["decision"]) for r in log] == [
        (1, 1, "A", "Not_Stated_In_Text", None), (1, 2, "B", None, "reject"), (1, 3, "A", "pass 3", None), (1, 4, "B", "pass 3", "accept"),
        (2, 1, "A", "Not_Stated_In_Text", None), (2, 2, "B", None, "reject"), (2, 3, "A", "Not_Stated_In_Text", None), (2, 4, "B", "Not_Stated_In_Text", "accept"),
    ]
