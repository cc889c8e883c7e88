"""The persisted index, dense search by blocks, extraction over windows, and the checks of a review."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.functions import vectors as V
from tracelode.operators import chunking as C
from tracelode.operators import critic as K
from tracelode.operators import dense
from tracelode.operators import index as I
from tracelode.operators import protocol as P
from tracelode.operators import retrieval as R
from tracelode.plans import corpus
from tracelode.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    rows = [(f"d{i}", ("common " * (1 + i % 3) + f"word{i % 7} only{i} ") * (1 + i % 5), "en" if i % 2 else "fr") for i in range(700)]
    df = spark.createDataFrame([*rows, ("empty", "", "en"), ("null", None, "en")], "evidence_id string, text string, lang string")
    I.build(df, path)
    return df, I.SearchIndex(spark, path, df)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_index_equals_a_scan_of_the_texts(spark, built, monkeypatch):
    df, index = built
    queries = asked(spark, "common word3", "only17 common common", "nowhere", "", "word1 word2 word5 only699")
    want = {tuple(r) for r in R.bm25_topk(queries, df, 5).collect()}
    assert {tuple(r) for r in index.bm25(queries, 5).collect()} == want
    monkeypatch.setattr(I, "STATED", 1)
    monkeypatch.setattr(I, "WEIGHTS", 3)
    assert {tuple(r) for r in index.bm25(queries, 5).collect()} == want, "terms stated or joined, queries at once or in parts: the same"
    french = {tuple(r) for r in R.bm25_topk(queries, df.where("lang = 'fr'"), 5).collect()}
    assert {tuple(r) for r in index.bm25(queries, 5, R.metadata_filter(index.blocks, lang="fr")).collect()} == french
    assert {tuple(r) for r in index.overlap(queries, 5).collect()} == {tuple(r) for r in R.overlap_topk(queries, df, 5).collect()}


def test_search_reads_no_texts_and_only_folders_of_its_terms(spark, built):
    _, index = built
    plan = index.bm25(asked(spark, "word3"), 5)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all("/postings" in x for x in scans) and all("PartitionFilters: [folder" in x or "folder#" in x for x in scans)
    assert all("In(term, [word3])" in x or "EqualTo(term,word3)" in x for x in scans) and not any("text:string" in x for x in scans)


def test_blocks_of_postings_are_bounded_and_skipped(spark, built):
    _, index = built
    rows = spark.read.parquet(f"{index.path}/postings").where("term = 'common'").select("df", F.size("postings").alias("n")).collect()
    assert len(rows) > 3 and all(r["df"] == r["n"] <= 3 * I.BLOCK for r in rows) and sum(r["n"] for r in rows) == 700


def test_terms_are_counted_and_put_into_blocks_where_texts_lie(spark, built):
    df, index = built
    ts = df.select("evidence_id", "text").withColumn("ts", F.split("text", " ")).select("evidence_id", F.size("ts").alias("len"), "ts").where("len > 1")
    rows = I.one_row_an_id(I.counted(ts, 64).select("evidence_id", "len", "terms", "tfs"))
    plan = I.in_blocks(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    twice = df.where("evidence_id in ('d1', 'd2')").unionByName(df)
    path = index.path + "-twice"
    I.build(twice, path)
    queries = asked(spark, "common only1", "only2 word3")
    assert {tuple(r) for r in I.SearchIndex(spark, path).bm25(queries, 5).collect()} == {tuple(r) for r in R.bm25_topk(queries, twice, 5).collect()}
    vectors = {r[0]: r[1] for r in spark.read.parquet(f"{path}/docs").select("evidence_id", "v").collect()}
    assert all(vectors[i] == v for i, v in df.where("text is not null").select("evidence_id", V.hashed_terms(F.col("text"), 64)).collect())


def test_arms_of_an_ablation_share_their_searches(spark, built):
    _, index = built
    plan = R.ablation_matrix(index, asked(spark, "word3"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "/postings" not in plan, "what the arms read are the lists of one search a channel"


def test_an_index_is_built_once_a_state_of_the_table(spark):
    a, b = corpus.index_of(spark, SF), corpus.index_of(spark, SF)
    assert a.path == b.path and not T.exists(spark, f"{a.path}/forward")


def test_an_empty_table_is_an_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "evidence_id string, text string")
    I.build(empty, f"file://{tmp_path}/e")
    index = I.SearchIndex(spark, f"file://{tmp_path}/e")
    assert index.hybrid_search(asked(spark, "anything")).count() == 0


def test_dense_search_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = {i: rng.standard_normal(5).tolist() for i in range(300)}
    v[300], v[301] = v[0], [2 * x for x in v[0]]  # ties, told apart by id
    odd = [(400, None), (401, [0.0] * 5), (402, [1.0, 2.0]), (403, [float("nan")] * 5), (404, [])]
    df = spark.createDataFrame([*v.items(), *odd], "id long, v array<double>")
    monkeypatch.setattr(dense, "VECTORS", 7)
    monkeypatch.setattr(dense, "QUERIES", 3)
    got = collections.defaultdict(list)
    for r in dense.cosine_topk(df.where("id < 20 OR id > 399").withColumnRenamed("id", "query_id"), df.repartition(5), 4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v.items()}
    for q in range(20):
        want = sorted(((-round(float(unit[q] @ u), 6), i) for i, u in unit.items()))[:4]
        assert got[q] == [(i, -s) for s, i in want]
    assert got[0][:3] == [(0, 1.0), (300, 1.0), (301, 1.0)] and got[402] == [(402, 1.0)] and not {400, 401, 403, 404} & got.keys()
    plan = dense.cosine_topk(df.withColumnRenamed("id", "query_id"), df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.rindex("MapInArrow"), "what is joined has been packed"
    assert dense.cosine_topk(df.limit(0).withColumnRenamed("id", "query_id"), df).count() == 0


# ---- extraction over windows


@pytest.fixture
def counted():
    """A provider that answers by the first word of its window and asserts what an agent may see."""

    def run(prompts):
        out = []
        for p in prompts:
            head, _, text = p.split("\n")[:3]
            assert "secret" not in p
            label = text.split(" ")[0]
            if "agent A" in head:
                quote = text if label != "liar" else "not in the text"
                out.append((None, "down") if label == "dead" else (json.dumps({"label": label, "quote": quote, "mechanism": "secret"}), None))
            else:
                out.append((json.dumps({"decision": {"x": "accept", "y": "revise"}.get(label, "insufficient_evidence"), "corrected_label": "z"}), None))
        return out

    P.PROVIDERS["counted"] = lambda: run
    yield
    del P.PROVIDERS["counted"]


def test_windows_merge_to_one_record(spark, counted):
    rows = [(1, 0, "x first"), (1, 1, "x again"), (2, 0, "x one"), (2, 1, "y other"), (3, 0, "liar a"), (3, 1, "dead b"), (4, 0, "dead c"), (None, 0, "x null"), (5, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, window_no int, text string")
    log = P.four_passes(df, "counted", "counted", lambda d, _: T.checkpointed(d), dimensions=("D01", "D02")).collect()
    assert len(log) == 6 * 2 * 4
    first = {r["doc_id"]: (r["state"], r["label"], r["n_windows"], r["n_unread"]) for r in log if r["pass"] == 1 and r["dimension"] == "D02"}
    assert first == {1: ("stated", "x", 2, 0), 2: ("conflict", None, 2, 0), 3: ("not_stated", "Not_Stated_In_Text", 2, 1), 4: ("unanswered", None, 1, 1), None: ("stated", "x", 1, 0), 5: ("not_stated", "Not_Stated_In_Text", 1, 0)}
    review = {r["doc_id"]: (r["decision"], r["label"]) for r in log if r["pass"] == 2 and r["dimension"] == "D01"}
    assert review == {1: ("accept", "x"), 2: ("revise", "z"), 3: ("insufficient_evidence", None), 4: ("insufficient_evidence", None), None: ("accept", "x"), 5: ("insufficient_evidence", None)}


@pytest.mark.parametrize("times", [2, 3])
def test_repeated_rows_are_one_call(spark, counted, times):
    df = spark.createDataFrame([(1, "D01", "x a"), (None, "D01", "x b"), (None, "D02", "y c")] * times, "doc_id long, dimension string, text string")
    log = P.four_passes(df, "counted", "counted").groupBy("pass").count().collect()
    assert {(r["pass"], r["count"]) for r in log} == {(n, 3) for n in range(1, 5)}


def test_texts_are_never_exchanged_once_a_dimension(spark):
    """What is exchanged beside a text has no dimension yet, and no exchange has prompts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.createDataFrame([("none", "{}")], "call_id string, content string")
        contexts = spark.createDataFrame([(i, "text " * i) for i in range(9)], "doc_id long, text string")
        plans = []

        def stage(df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return T.staged(df, name)

        for name, options in (("replay", {"answers": stored}), ("dry_run", {})):
            log = P.four_passes(contexts, name, name, stage, options, options, dimensions=("D01", "D02"))
            assert log.count() == 9 * 2 * 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                below = lines[i + 1]
                assert not ("text#" in below and "dimension#" in below) and "prompt" not in below, below


def test_arms_differ_in_what_is_read_and_who_reviews(spark, counted):
    long = "x " + " ".join(f"w{i}" for i in range(3000))
    texts = {"d0": "x apple pie", "d1": "y apple tart", "d2": "dead end", "d3": "x nothing", "d4": long, "d5": None}
    blocks = spark.createDataFrame(list(texts.items()), "evidence_id string, text string")
    got = R.ablation_matrix(R.HybridIndex(blocks), asked(spark, "apple"), 2, "counted", "counted").collect()
    steps = {arm: {(r["step"], r["pass"]) for r in got if r["arm"] == arm} for arm in {r["arm"] for r in got}}
    a, ab, all_ = ({(s, n) for s in ("retrieval", "coverage") for n in range(1, m + 1)} for m in (1, 2, 4))
    assert steps == {"G0": {("direct", 1)}, "G0-budget": {("direct", 1)}, **{g: {("retrieval", 1)} for g in ("G1", "G2", "G3")}, "G4": a, "G5": all_, "G5-round": ab}
    label = {(r["arm"], r["step"], r["pass"], r["id"]): r["label"] for r in got}
    assert {r["id"]: r["label"] for r in got if r["arm"] == "G0"} == {"d0": "x", "d1": "y", "d2": None, "d3": "x", "d4": "x", "d5": "Not_Stated_In_Text"}, "every document whole"
    assert {i for arm, step, _, i in label if step == "coverage"} == {"d0", "d1", "d2", "d3", "d4"} and {i for arm, step, _, i in label if arm == "G3"} == {"d0", "d1"}
    assert [label[x, "coverage", n, "d1"] for x, n in (("G4", 1), ("G5", 1), ("G5", 2), ("G5", 4), ("G5-round", 2))] == ["y", "y", "z", "z", "z"], "the critic revises"
    of = {(r["arm"], r["step"], r["id"]): (r["n_windows"], r["state"]) for r in got if r["pass"] == 1}
    assert of["G4", "coverage", "d4"] == (2, "conflict") and of["G0", "direct", "d4"] == of["G0-budget", "direct", "d4"] == (1, "stated")
    starts = C.text_starts(blocks, ("evidence_id",)).where("evidence_id = 'd4'").first()
    assert starts["n_words"] == len(starts["text"].split()) <= 1800 and long.startswith(starts["text"])
    hashes = {r["arm"]: r["input_hash"] for r in got if r["id"] == "d4" and r["step"] == "direct"}
    assert hashes["G0"] != hashes["G0-budget"]


def test_windows_of_texts_are_those_of_their_blocks(spark):
    want = {(r["doc_id"], r["window_no"], r["n_words"], r["text"]) for r in C.reading_windows(corpus.blocks_of(spark, SF)).collect()}
    made = C.text_windows(corpus.docs_of(spark, SF))
    assert {(str(r["doc_id"]), r["window_no"], r["n_words"], r["text"]) for r in made.collect()} == want and len({w[1] for w in want}) > 1
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_every_block_is_in_a_window(spark):
    blocks = corpus.blocks_of(spark, SF)
    windows = C.reading_windows(blocks)
    assert C.uncovered(blocks, windows.select(F.explode("evidence_ids").alias("evidence_id"))).count() == 0
    assert windows.select(F.sum("n_words")).first() == blocks.select(F.sum("n_words")).first()


def test_recorded_answers_change_labels_between_passes(spark):
    log = corpus.coverage_extraction(spark, SF)
    seen = log.groupBy("pass").agg(F.collect_set("label").alias("labels"), F.collect_set("state").alias("states"), F.collect_set("decision").alias("decisions")).collect()
    by = {r["pass"]: r for r in seen}
    assert set(by[1]["states"]) >= {"stated", "not_stated", "unanswered"} and set(by[2]["decisions"]) == {"accept", "revise", "reject", "insufficient_evidence"}
    assert "L9" in by[2]["labels"] and "L9" not in by[3]["labels"]


# ---- the checks of a review


def test_each_check_fails_somewhere_and_holds_somewhere(spark):
    got = corpus.critic_checks(spark, SF).where("applicable").groupBy("check_name").agg(F.count_if("passed").alias("ok"), F.count_if(~F.col("passed")).alias("bad")).collect()
    assert {r["check_name"] for r in got} == set(K.CHECKS) and all(r["ok"] and r["bad"] for r in got)


def test_checks_by_hand(spark):
    blocks = spark.createDataFrame([("d", "b1", 0, 20, "water cools the core"), ("d", "b2", 20, 45, "but no cooling was needed"), ("e", "b3", 0, 5, "other")], "doc_id string, evidence_id string, char_start int, char_end int, text string")
    rules = spark.createDataFrame([("cool", "direction", "water.*core", None), ("cool", "contradiction", None, "no cooling")], "label string, check_name string, must string, must_not string")
    records = [("r1", "d", "cool", "b1", 6, 11, "cools"), ("r2", "d", "cool", "b2", 20, 23, "but"), ("r3", "d", "cool", "b9", 6, 11, "cools"), ("r4", "d", "cool", "b1", 15, 25, "a cut span"), ("r5", None, "none", None, None, None, None)]
    df = spark.createDataFrame(records * 2, "record_id string, doc_id string, label string, evidence_id string, char_start int, char_end int, quote string")
    got = {(r["record_id"], r["check_name"]): (r["applicable"], r["passed"]) for r in K.critic_checks(df, blocks, rules, bucket=8).collect()}
    assert len(got) == 5 * 7
    assert got["r1", "direction"] == (True, True) and got["r1", "evidence"] == (True, True) and got["r1", "contradiction"] == (True, False)
    assert got["r2", "direction"] == (True, False) and got["r2", "contradiction"] == (True, True), "a block does not speak against itself"
    assert not got["r3", "evidence"][1] and not got["r3", "direction"][1] and not got["r4", "evidence"][1] and got["r4", "entailment"] == (False, True)
    assert got["r5", "evidence"] == (True, False) and got["r5", "contradiction"] == (False, True)
    assert K.critic_checks(df.limit(0), blocks, rules).count() == 0


# ---- intervals, digests, graphs, versions


def test_poisson_weights_have_their_mean_and_do_not_depend_on_partitions(spark):
    from tracelode.operators import metrics as M

    ids = spark.range(40_000).withColumn("w", M.poisson(M.draw(F.lit(3), F.col("id"), F.lit(M.HASHES), 42)))
    mean, var, most = ids.agg(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05 and most <= M.MOST_WEIGHT
    s = spark.createDataFrame([(a, d, "D01", float((d * k) % 7)) for a, k in (("G4", 3), ("G3", 5), ("G1", 2)) for d in range(60)], "arm string, doc_id long, dimension string, score double")
    pairs = (("G4", "G3"), ("G3", "G1"), ("G4", "G9"))
    one, two = (sorted(map(tuple, M.paired_bootstrap(x, pairs).collect())) for x in (s, s.repartition(7).unionByName(s)))
    assert one == two and {r[0] for r in one} == {"G4-G3", "G3-G1"}, "repeated scores are averaged, a contrast without pairs has no row"
    assert all(r[4] <= r[3] <= r[5] and r[6] <= r[7] <= 1 for r in one)


def test_ties_of_flipped_sums_stay_ties_in_any_order(spark):
    from tracelode.operators import metrics as M

    # each cluster sums to 0.3 or -0.3 beside parts of 1e6 that cancel: in doubles what is left depends on their order
    parts = [0.1, 1e6 / 17, 0.2, -1e6 / 17]
    rows = [(f"c{c}", (1 if c % 2 else -1) * x) for c in range(8) for k in range(40) for x in (parts[(c + k) % 4], parts[(c + k + 1) % 4], parts[(c + k + 2) % 4], parts[(c + k + 3) % 4])]
    df = spark.createDataFrame(rows, "cluster string, diff double")
    assert M.randomization_test(df).first()[0] == 1.0, "the sum is zero, which any flip reaches"


def test_ties_of_flipped_sums_stay_ties_at_size(spark, tmp_path):
    import hashlib

    n = 400_000  # rows from which the rounding errors of seventeenths have grown beyond the test's tolerance
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.arange(n)
    diff = ids * 7 % 17 - ids * 6 % 17
    sums = {f"src{c}": int(diff[ids % 20 == c].sum()) for c in range(20)}
    flipped = [sum(s if int(hashlib.md5(f"42:{i}:{c}".encode()).hexdigest()[:8], 16) % 2 == 0 else -s for c, s in sums.items()) for i in range(1, 201)]
    want = (1 + sum(abs(t) >= abs(sum(sums.values())) for t in flipped)) / 201
    assert any(abs(t) == abs(sum(sums.values())) for t in flipped)
    assert corpus.randomization_test(spark, str(tmp_path)).first()[0] == round(want, 6)


def test_digest_trees_advance_and_find_what_changed(spark):
    from tracelode.operators import synthesis as S

    then = spark.createDataFrame([(i, f"t{i}") for i in range(0, 3000, 3)], "k long, t string")
    gone, came = then.where("k in (33, 1500)"), spark.createDataFrame([(33, "other"), (-5, "new")], "k long, t string")
    now = then.exceptAll(gone).unionByName(came)
    tree, after = S.freeze_tree(then, "k", ["k", "t"]), S.freeze_tree(now, "k", ["k", "t"])
    assert {tuple(r) for r in S.advanced(tree, gone, came, "k", ["k", "t"]).collect()} == {tuple(r) for r in after.collect()}
    ranges = S.changed_ranges(tree, after)
    assert {r["range_no"] for r in ranges.collect()} == {-1, 2, 93}
    assert {tuple(r) for r in S.changed_rows(then, now, ranges, "k", ["k", "t"]).collect()} == {(33, "changed"), (1500, "gone"), (-5, "came")}
    assert S.changed_ranges(tree, tree).count() == 0


def test_reach_ends_in_cycles_and_names_loose_ends(spark):
    from tracelode.operators import synthesis as S

    edges = spark.createDataFrame([("k1", "claim", "b1", "block"), ("b1", "block", "d1", "document"), ("d1", "document", "b1", "block"), ("k2", "claim", "b2", "block"), ("b3", "block", "d1", "document")], "src_id string, src_kind string, dst_id string, dst_kind string")
    nodes = spark.createDataFrame([("k1", "claim"), ("k2", "claim"), ("b1", "block"), ("b2", "block"), ("b3", "block"), ("d1", "document")], "node_id string, kind string")
    got = S.reach(edges, nodes.where("kind = 'claim'"), 5)
    assert {tuple(r) for r in got.collect()} == {("k1", "k1", "claim", 0), ("k1", "b1", "block", 1), ("k1", "d1", "document", 2), ("k2", "k2", "claim", 0), ("k2", "b2", "block", 1)}
    assert {tuple(r) for r in S.loose_ends(nodes, edges, got, "document").collect()} == {("b3", "block", "orphan"), ("k2", "claim", "dead end")}


# ---- chunks and sections


def test_a_million_lines_and_long_lines_are_cut_in_linear_time():
    import time

    lines = "\n".join(["word " * 3] * 1_000_000)
    began = time.time()
    units = C.cut_units(lines, 240)
    chunks = C.pack_units((u[2:] for u in units), 180, 240)
    assert len(units) == 1_000_000 and sum(c[3] for c in chunks) == 3_000_000 and time.time() - began < 30
    assert len(C.cut_units("w " * 500_000, 240)) == -(-500_000 // 240)


def test_sections_of_any_depth_reach_their_blocks(spark):
    deep = [("Introduction", 1), ("x", None), ("Model", 9), ("y", None), ("Notes", 12), ("z", None), ("References", 2), ("r", None), ("Plain", 3), ("q", None)]
    lines = spark.createDataFrame([(1, 0, 1, "before", None), *[(1, i + 1, 1 + i // 4, t, d) for i, (t, d) in enumerate(deep)]], "doc_id long, ord int, page int, text string, depth int")
    got = {(r["zone"], r["section_title"]): (r["page"], r["text"]) for r in C.sectioned_blocks(lines).collect()}
    assert got == {("D", None): (1, "before"), ("A", "Introduction"): (1, "Introduction\nx\nPlain\nq"), ("B", "Model"): (1, "Model\ny\nNotes\nz")}
    assert {(r["title"], r["parent_ord"]) for r in C.section_tree(lines).collect()} >= {("Notes", 3), ("Model", 1), ("Plain", 7)}


def test_numbers_of_sections_beyond_two_digits_are_whole(spark):
    lines = spark.createDataFrame([(1, i, 1, f"Introduction {i}", 1 if i in (7, 132) else None) for i in range(140)], "doc_id long, ord int, page int, text string, depth int")
    made = C.sectioned_blocks(lines.withColumn("text", F.concat("text", F.lit(" word" * 100)))).select("evidence_id", "section_ord").collect()
    assert {r["section_ord"] for r in made} == {None, 7, 132} and all(f"-S{r['section_ord'] or 0:02d}-" in r["evidence_id"] for r in made)


def test_quotes_by_automaton_equal_quotes_by_words(spark, monkeypatch):
    from tracelode.operators import validate as V

    texts = spark.createDataFrame([(1, "the 𝒳 cold river runs the cold"), (2, "a cold"), (3, None), (4, "he cold rivers")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "the cold"), (2, "cold river runs"), (3, "he cold river"), (4, ""), (5, None), (6, "cold"), (6, "cold"), (7, "cold")], "item_id long, text string")
    want = {tuple(r) for r in V.find_quotes(quotes, texts, "doc_id").collect()}
    monkeypatch.setattr(V, "SCANNED", 9)
    assert {tuple(r) for r in V.find_quotes(quotes, texts, "doc_id").collect()} == want
    assert {(1, 1, 22), (2, 1, 6), (6, 2, 2), (7, 2, 2), (3, 4, 0)} <= want and not {4, 5} & {r[0] for r in want}


def test_screening_keeps_the_first_reason(spark):
    from tracelode.operators import screening as N

    rows = [(1, "Cooling of a coupled water and power network", 2010), (2, "cooling of the coupled water and power network!", 2011), (3, "A wholly different title", 1990), (4, "", 2010), (5, None, 2010), (6, "a different title", None), (7, "Cooling of a coupled water and power network", 1990)]
    df = spark.createDataFrame([(i, t, y, "s") for i, t, y in rows] + [(6, "a different title", None, "s")], "cand_id long, title string, date int, source string")
    out = N.screened(df, [("undated", F.col("date").isNull()), ("too early", F.col("date") < 2000), ("never", F.lit(True))], 0.7)
    got = collections.Counter((r["cand_id"], r["reason"]) for r in out.collect())
    assert got == {(1, "never"): 1, (2, "duplicate"): 1, (3, "too early"): 1, (4, "untitled"): 1, (5, "untitled"): 1, (6, "duplicate"): 2, (7, "duplicate"): 1}
    assert {(r["reason"], r["n"], r["first_date"]) for r in N.funnel(out).collect()} == {("never", 1, 2010), ("duplicate", 4, 1990), ("too early", 1, 1990), ("untitled", 2, 2010)}
    assert N.screened(df.limit(0), []).count() == 0
