"""Near-duplicate operators against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from tracelode.llm import components as C
from tracelode.llm import embed_dedup as E
from tracelode.llm import simhash as S
from tracelode.llm import queries
from tracelode.llm import suffix_dedup as X

SF = "/root/testdata/sf0.001"


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300 + i, 300 + (i + 1) % 25) for i in range(25)] + [(7, 7), (500, 400)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    assert got == least_reachable(nodes, links)


def test_components_of_no_link(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def simhash_by_hand(text, size=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    ws = [w for w in text.split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_match_brute_force():
    rng = random.Random(3)
    texts = ["", " \n", "one", "One two", "a b c d", "A b\tc\x0bd e", "é É x y z w", "x " * 3000]
    texts += [" ".join(rng.choice("ab Cd éf\n gh ij".split(" ")) for _ in range(rng.randint(0, 700))) for _ in range(60)]
    assert S.fingerprints(texts).tolist() == [simhash_by_hand(t) for t in texts]


@pytest.mark.parametrize(("segments", "block"), [(2, 1024), (3, 1024), (4, 16)])
def test_simhash_links_match_brute_force(spark, segments, block):
    rng = random.Random(segments)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            p = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)] + [(10_000, int(np.uint64(prints[0]).view(np.int64)))]
    got = {r["doc_id"]: r["component_id"] for r in S.group(spark.createDataFrame(rows, "doc_id long, simhash long"), bits=4, segments=segments, block=block).collect()}
    links = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = least_reachable(range(len(prints)), links)
    assert got == {**want, 10_000: want[0]}


def test_simhash_of_nulls_repeats_and_no_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, "wholly other words here now")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = []
    for c in range(30):
        base = rng.standard_normal(16)
        vecs += [base + rng.standard_normal(16) * 0.14 * rng.random() * np.linalg.norm(base) / 4 for _ in range(rng.integers(1, 25))]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None, *rows[0][1][1:]], 0), (n + 5, rows[0][1], None), (n + 6, [1.0], 0), (n + 7, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    links = [(i, j) for i, j in combinations(range(n), 2) if i % 2 == j % 2 and cos[i, j] >= 0.98] + [(n + 6, n + 7)]
    assert len(links) > 100
    comp = least_reachable(range(n + 8), links)
    deg = dict.fromkeys(range(n + 8), 0)
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    for block in (8, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df, block=block).collect()}
        assert got == {i: (deg[i], comp[i], comp[i] == i) for i in range(n + 8)}
    assert E.near_duplicates(df.limit(0)).count() == 0


def removed_by_hand(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for d, r in enumerate(raws):
        for i in range(len(r) - length + 1):
            seen.setdefault(r[i : i + length], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for r, g in zip(raws, gone, strict=True):
        kept = bytes(np.frombuffer(r, np.uint8)[~g])
        out.append((len(r), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [8192, 5])
def test_suffix_removal_matches_brute_force(spark, shard):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(4, 60))) for _ in range(12)]
    texts = [None, "", "x" * 500, "ab" * 300, "\x00" * 250 + "ü" * 150]
    for _ in range(70):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(shared), " ".join(word() for _ in range(rng.randint(0, 12)))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [shared[0] + word() for _ in range(30)] + texts[10:14]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    for length, gram in ((40, 8), (200, 32)):
        got = X.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept int"), length=length, gram=gram, shard_contexts=shard).collect()
        found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got}
        assert len(got) == len(texts)
        assert [found[i] for i in range(len(texts))] == removed_by_hand(texts, length)


def test_suffix_removal_of_repeated_rows_null_ids_and_no_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [(1, text), (1, text), (None, "z" * 10), (None, text[100:] + "q" * 199)]
    got = X.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 300), (1, 400), (1, 400)]
    assert X.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_common_prefixes():
    data = np.frombuffer(b"banana bandana banana bandana xyz banana\xff", np.uint8)
    order, eight = X.suffix_array(data)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:] + bytes([255]) * len(raw))
    before, common = X.common_prefixes(order, eight, np.array([0]), np.array([len(data)]), 100)
    for i in range(len(raw)):
        j = before[i]
        n = 0
        while j >= 0 and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
            n += 1
        assert common[i] == n


def test_suffix_segments_of_long_texts(monkeypatch, spark):
    rng = random.Random(2)
    monkeypatch.setattr(X, "SEGMENT", 1000)
    block = "".join(rng.choice("abcdefgh") for _ in range(5000))
    raws = [block[:3000].encode(), block[1500:].encode()]
    docs = spark.createDataFrame([(0, 1, raws[0].decode()), (1, 1, raws[1].decode())], "d long, v long, text string")
    rows = X.anchors(docs, 200, 32).collect()
    for d, raw in enumerate(raws):
        covered = sorted(x for r in rows if r["d"] == d for x in range(r["p"], r["p"] + r["w"] + 1))
        assert covered == list(range(len(raw) - 199))


@pytest.mark.parametrize("shared", [201, 256, 280, 400])
def test_common_prefixes_of_contexts_that_agree_in_many_bytes(shared):
    rng = random.Random(shared)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(shared))
    for last in (b"za", b"az", b"zaz"):
        contexts = [passage + bytes([c]) + bytes(rng.choice(b"abcdefgh") for _ in range(80)) for c in last]
        raw = b"\xff".join(contexts) + b"\xff"
        data, lens = np.frombuffer(raw, np.uint8), np.array([len(c) + 1 for c in contexts])
        starts = np.cumsum(lens) - lens
        order, eight = X.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:] + bytes([255]) * len(raw))
        before, common = X.common_prefixes(order, eight, starts, starts + lens, 200)
        ends = np.repeat(starts + lens, lens)
        for i, j in enumerate(before.tolist()):
            n = 0
            while j >= 0 and n < 200 and max(i + n - ends[i], j + n - ends[j]) < 0 and raw[i + n] == raw[j + n]:
                n += 1
            assert common[i] == n


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_suffix_query_matches_brute_force_on_whole_tables(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert [got[i] for i in ids] == removed_by_hand([docs[i] for i in ids], 200)


def test_suffix_removal_of_many_equal_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    df = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = df.select(F.col("doc_id").alias("d"), F.lit(1).cast("long").alias("v"), "text")
    hits = X.repeated_runs(docs)
    most = hits.groupBy("d", "v").agg(F.size(F.flatten(F.collect_set("at"))).alias("n")).first()["n"]
    assert most < 200
    got = X.deduplicate(df).select("n_removed", "n_spans").distinct().collect()
    assert [tuple(r) for r in got] == [(3000, 1)]


def test_embedding_links_of_one_large_label_among_small_ones(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(400):
        base = rng.standard_normal(16)
        rows += [(base + rng.standard_normal(16) * 0.1 * rng.random(), "big") for _ in range(5)]
    rows += [(rng.standard_normal(16), f"s{i % 150}") for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    x = np.array([v for v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array([[a[1] == b[1] for b in rows] for a in rows])
    near = (x @ x.T >= 0.98) & same & ~np.eye(len(rows), dtype=bool)
    comp = least_reachable(range(len(rows)), zip(*np.nonzero(near), strict=True))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), comp[i]) for i in range(len(rows))}
    assert E.schedule(100_000_000)[0] > E.schedule(1000)[0]


def test_embedding_neighbours_of_other_hashes_meet_in_one_pass(spark):
    angles = np.arange(100) * 2 * np.pi / 100
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(angles)]
    rows += [rows[0], (1, rows[50][1], 0), (200, rows[3][1], 1), (201, rows[4][1], 1)]
    n = len(rows)
    near = [[a[2] == b[2] and a[0] != b[0] and float(np.dot(a[1], b[1])) >= 0.98 for b in rows] for a in rows]
    comp = least_reachable({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i in range(n) for j in range(n) if near[i][j]])
    links = {}
    for i in (i for i in range(n) if rows[i] not in rows[:i]):  # equal rows are one with a count, which others see
        links[rows[i][0]] = links.get(rows[i][0], 0) + sum(near[i])
    assert E.schedule(100, miss=0.9)[1] == 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = E.near_duplicates(df, miss=0.9).collect()
    assert len(got) == n
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], comp[i]) for i in links}


def test_equal_vectors_are_one_row_with_a_count(spark):
    """Equal vectors under many ids, one under ids of its own too, an id with two vectors, zero vectors that are equal, and one row twice."""
    v, near, far = [0.6, 0.8, 0.0], [0.6, 0.8, 0.01], [0.0, 0.0, 1.0]
    rows = [(i, v, 1) for i in range(1000, 1400)] + [(7, near, 1), (8, v, 1), (8, far, 1), (9, far, 1), (10, [0.0] * 3, 1), (11, [0.0] * 3, 1), (12, v, 2), (1000, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df, block=16).collect()}
    # 401 rows of 400 ids, and id 8 besides: a row of id 8 links with none of its own
    assert {x for x in got if x[0] >= 1000} == {(1000, 399 + 2, 7, False)} | {(i, 400 + 2, 7, False) for i in range(1001, 1400)}
    assert {x for x in got if x[0] < 1000} == {(7, 402, 7, True), (8, 402 + 1, 7, False), (9, 1, 7, False), (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True)}
