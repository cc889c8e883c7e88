"""Whitening, quality rules and periodic runs against numpy, libraries and brute force, with the cases that they define."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as PT
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import fertility, periodic, queries, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FILES = [(n, PT.path(f)) for n, f in fertility.VOCABULARIES]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- whitening


def by_hand(vectors, components=4):
    """n, S, the deviations, eigenvalues and vectors of distinct whole-number vectors, dense."""
    x = np.unique(np.array(vectors), axis=0)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, s, e[::-1][:components], q[:, ::-1][:, :components], np.trace(v)


def held_against(got, vectors, components=4, tolerance=1e-9):
    """Rows by id and component against the dense solution of id -> whole-number vector."""
    n, s, e, q, trace = by_hand(list(vectors.values()))
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert rows.keys() == {(i, k + 1) for i in vectors for k in range(components)} and len(got) == len(rows)
    w = np.array([[rows[i, k + 1]["whitened"] for k in range(components)] for i in vectors])
    want = (np.array(list(vectors.values())) - s / n) @ q[:, :components] / np.sqrt(e[:components])
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < tolerance
    for (i, k), r in rows.items():
        assert r["n"] == n and int(r["deviation"]) == int(((n * np.array(vectors[i], object) - s.astype(object)) ** 2).sum())
        assert abs(r["explained"] / (e[k - 1] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_op11_matches_a_dense_solution(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held_against(queries.op11_whitening(spark, SF).collect(), {r["vec_id"]: np.floor(256 * np.array(r["embedding"], float)).astype(np.int64) for r in rows})


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = {i: (rng.standard_normal(6) * 0.3).tolist() for i in range(40)}
    rows = [(i, v, 1) for i, v in good.items()] + [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [math.nan] * 6, 1), (103, [math.inf] + [0.0] * 5, 1), (104, [], 1), (None, good[0], 1)]
    df = spark.createDataFrame(rows + [(7, good[7], 1)] * 30, "vec_id long, embedding array<double>, component int")
    got = whitening.whiten(df).collect()
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 7 for r in got) == 4 * 31
    once = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] is not None}
    held_against(list(once.values()), {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in good.items()})
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 7")).count() == 0, "a single distinct vector has no variance"


def test_lengths_are_fitted_apart_and_flat_directions_have_no_rows(spark):
    rows = [(i, [float(i % 5), 2.0]) for i in range(10)] + [(20 + i, [float(i), float(i * i % 7), 1.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {i: 1 if i < 20 else 2 for i, _ in rows}
    assert {r["n"] for r in got if r["vec_id"] < 20} == {5}


@pytest.mark.parametrize("kind", ["decay", "equal", "rank"])
def test_lanczos_converges_restarts_and_breaks_down(kind):
    """Against a dense solution, without Spark: fast decay converges early, equal eigenvalues share a block, a low rank breaks down."""
    dim, rng = 120, np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    e = {"decay": 0.5 ** np.arange(dim), "equal": np.r_[[9.0] * 4, np.linspace(1, 0.1, dim - 4)], "rank": np.r_[5.0, 4.0, 3.0, 2.0, np.zeros(dim - 4)]}[kind]
    v = (q * e) @ q.T
    state, passes = whitening.Lanczos(dim, 4), 0
    while not state.done:
        state.take(v @ state.next)
        passes += 1
    assert np.allclose(state.values, e[:4], rtol=1e-10)
    assert np.linalg.norm(v @ state.vectors - state.vectors * state.values, axis=0).max() < 1e-10
    assert np.abs(state.vectors.T @ state.vectors - np.eye(4)).max() < 1e-12
    assert passes < dim / whitening.BLOCK or kind == "rank"


def test_deviations_stay_exact_beyond_long():
    x = np.array([[2**40, -(2**40)], [1, 5]])
    assert list(whitening.deviations(x, 3, [7, -(2**45)])) == [(3 * 2**40 - 7) ** 2 + (-3 * 2**40 + 2**45) ** 2, (3 - 7) ** 2 + (15 + 2**45) ** 2]
    assert list(whitening.whole_numbers(np.array([-0.001, 1e300, -1e300, -0.0]))) == [-1, 2**63 - 1, -(2**63), 0]


# ---- quality rules


def base_by_hand(t):
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def measures_by_hand(t):
    import base64

    import sentencepiece
    import tiktoken

    model = sentencepiece.SentencePieceProcessor(model_file=PT.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = WORD.findall(t)
    out = []
    for ids, single in (
        ([i for w in words for i in library.encode_ordinary(" " + w)], lambda i: len(x := library.decode_single_token_bytes(i)) == 1 and x[0] >= 128),
        ([i for w in words for i in model.encode(w)], model.is_byte),
    ):
        p = np.array(list(collections.Counter(ids).values())) / len(ids)
        out += [sum(map(len, words)) / len(ids), sum(map(single, ids)) / len(ids), -(p * np.log2(p)).sum()]
    return out


def test_op12_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_quality_rules(spark, SF).collect()}
    assert {i: r[1:7] for i, r in got.items()} == {i: base_by_hand(t) for i, t in docs.items()}
    for i in sorted(docs)[:12]:
        assert np.allclose(got[i][9:], measures_by_hand(docs[i]))
    assert not any(r[7] and r[6] for r in got.values())


def test_op12_keeps_clean_documents_and_rejects_junk(spark):
    """Labels that the rules never read: no clean document goes that the base rules pass."""
    got = {r["doc_id"]: r for r in queries.op12_quality_rules(spark, "/root/testdata/sf0.1").select("doc_id", "base_failed", "kept").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    of = {q: [got[i]["kept"] for i, y in labels.items() if y == q and i in got and not got[i]["base_failed"]] for q in (0, 1)}
    assert sum(of[1]) >= 0.998 * len(of[1]) and sum(of[0]) <= 0.25 * len(of[0])


def test_quality_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = ["harbour", "window", "the", "a", "of", "lighthouse", "garden", "paper", "silver", "running", "over", "under", "question", "answer", "music", "river", "yellow", "train", "doctor", "and"]
    clean = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else None, "x") for i, t in enumerate(clean)] + [(90, None, "en", "x"), (91, "", None, None), (92, " ".join("".join(rng.choice(list("qxzjk0937#%"), 12)) for _ in range(80)), "en", "y"), (None, clean[0], "xx", "z")]
    rows += [(93, "word " * 200_000, "en", "long"), (94, "один два три " * 30, None, "x"), (5, clean[5], "en", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = collections.defaultdict(list)
    for r in fertility.quality(df, vocabularies=FILES, pattern=PT.PATTERN).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 2 and got[5][0] == got[5][1]
    assert all(got[i][0]["kept"] == (not got[i][0]["base_failed"]) for i in range(60))
    assert got[90][0][1:7] == (0, 0, 0, 0, 0, True) and got[91][0]["script"] is None and got[91][0]["bytes_entropy"] is None
    assert not got[92][0]["base_failed"] and not got[92][0]["kept"]
    assert got[93][0][1:7] == (200_000, 800_000, 0, 0, 200_000, True) and got[94][0]["script"] == "Cyrillic"
    assert fertility.quality(df.limit(0), vocabularies=FILES, pattern=PT.PATTERN).count() == 0


def test_repeated_words_by_hand():
    texts = ["a a a a", "a b c", "", "a b c a b c", "x y", "a b c d a b e b c d"]
    words = [t.split() for t in texts]
    names = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    got = fertility.repeated_words(doc, np.array([names[w] for ws in words for w in ws]), len(texts))
    assert list(got) == [base_by_hand(t)[4] for t in texts]


# ---- periodic runs


def runs_by_hand(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p) and j > i and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_match_brute_force(parts):
    w = [x for block, times in parts for x in block * times]
    assert periodic.find_runs(np.array(w, np.int32)) == runs_by_hand(w)


def test_runs_of_long_texts():
    assert periodic.find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    w = np.arange(50_000, dtype=np.int32)
    w[20_000:] = 20_000 + (w[20_000:] - 20_000) % 7001
    assert periodic.find_runs(w) == [(20_000, 30_000, 7001)]


def test_op13_odd_rows(spark):
    loop = "go and come " * 5
    rows = [(1, None, 1), (2, "", 1), (3, loop, 1), (3, loop, 2), (None, loop, 3), (4, "a b a b a b a b c c c c c c", 1), (5, "one two three four five", 1), (6, "x\ty\nz\v" * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = [r.asDict(recursive=True) for r in periodic.with_runs(df).collect()]
    by = {r["doc_id"]: r for r in got}
    as_tuples = lambda r: [(x["start"], x["length"], x["period"]) for x in r["runs"]]
    assert len(got) == len(rows) and as_tuples(by[1]) == as_tuples(by[2]) == as_tuples(by[5]) == [] and by[1]["collapsed"] == "" and by[1]["strongest"] is None
    assert as_tuples(by[3]) == as_tuples(by[None]) == [(0, 15, 3)] and by[3]["collapsed"] == "go and come"
    assert as_tuples(by[4]) == [(0, 8, 2), (8, 6, 1)] and by[4]["collapsed"] == "a b c" and by[4]["strongest"] == {"start": 8, "length": 6, "period": 1}
    assert as_tuples(by[6]) == [(0, 120_000, 3)] and by[6]["collapsed"] == "x y z"
    assert periodic.with_runs(df.limit(0)).count() == 0


def test_strongest_ties_go_by_start():
    assert periodic.strongest([(9, 12, 3), (2, 8, 2), (20, 9, 3)]) == (2, 8, 2)


def test_op13_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for i, t in docs.items():
        w = WORD.findall(t)
        g, hit = divmod(zlib.crc32(str(i).encode()), 10)
        if hit == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        if len(w) > 400:
            continue
        runs = runs_by_hand(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = periodic.strongest(runs) or (None,) * 3
        want[i] = (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and {i: got[i] for i in want} == want and sum(v[0] > 0 for v in want.values()) > 10
