"""Near copies of the pipeline against brute force."""

import random
from itertools import combinations

import corpus_pipeline as P
from tracelode.llm import shingles as N


def by_hand(rows, size=5):
    """Least reachable id of each id that is not null, over pairs of similarity 0.8 or more."""
    sets: dict[int, list] = {}
    for i, t in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        if i is not None:
            sets.setdefault(i, []).append({tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set())
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    n_links = 0
    for i, j in combinations(sorted(sets), 2):
        if any(5 * len(x & y) >= 4 * len(x | y) for x in sets[i] for y in sets[j]):
            n_links += 1
            i, j = find(i), find(j)
            lead[max(i, j)] = min(i, j)
    return {i: find(i) for i in sets}, n_links


def edited():
    """Texts with one to some words changed, cut or added, so that similarities lie around the threshold."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(30)]
    texts = []
    for n in (8, 12, 20, 40, 120, 300, 600):
        for _ in range(6):
            base = [word() for _ in range(n)] + common[: rng.choice([0, 0, 30])]
            for _ in range(5):
                ws = list(base)
                for _ in range(rng.randint(0, max(1, n // 28))):
                    k = rng.randrange(len(ws))
                    ws[k : k + 1] = rng.choice([[word()], [], [ws[k], word()]])
                texts.append(" ".join(ws))
    base = [word() for _ in range(200)]  # a large group, whose shingles are common
    texts += [" ".join(word() if rng.random() < 0.018 else w for w in base) for _ in range(120)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (900, None), (901, " \n"), (902, "Two words"), (903, "two  WORDS"), (None, texts[0]), (5, texts[5]), (6, texts[90])]


def test_pipeline_near_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 1)  # so that shingles of the large group count as common
    rows = edited()
    want, n_links = by_hand(rows)
    assert n_links > 300
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(want.items())


def test_pipeline_keeps_the_least_of_edited_copies(spark):
    rows = edited()
    want, _ = by_hand(rows)
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in P.drop_near_copies(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, _ in rows if i is not None and want[i] == i)
    assert kept.count(None) == 1
    assert N.near_copies(docs.limit(0)).count() == 0


def around_the_threshold(n):
    """One large group of edited copies, of which many pairs share keys and few are similar enough."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(220)]
    return [(i, " ".join(word() if rng.random() < 0.02 else w for w in base)) for i in range(n)]


def test_pairs_of_a_large_group_are_not_rows(spark, monkeypatch):
    counts: dict[str, int] = {}
    write = N.staged

    def counted(df, name):
        out = write(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(N, "staged", counted)
    rows = around_the_threshold(500)
    want, n_links = by_hand(rows)
    assert n_links > 500 and len(set(want.values())) > 20
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(want.items())
    assert counts["rest-pairs"] < 10 * len(rows)
    assert counts["close-blocks"] > 0


def test_sets_in_pairs_of_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 1)
    monkeypatch.setattr(N, "BLOCK", 8 * N.LEAST)
    rows = edited()
    want, _ = by_hand(rows)
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(want.items())
