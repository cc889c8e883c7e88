"""Each registered query on a whole table against libraries, brute force or its SQL."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as PT
import pytest
from pyspark.sql import functions as F

from test_near_duplicates import least_reachable, simhash_by_hand
from tracelode.llm import pii, queries, toxicity

SF = "/root/testdata/sf0.001"


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids := library.encode_ordinary(t)), sha(" ".join(map(str, ids))), sha(t)) for i, t in docs.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op1_byte_bpe(spark, SF).collect()} == want


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PT.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, t in docs.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    got = queries.op3_best_fit(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * -(-total // 2048) + 1


def spans_digest(found, kinds):
    found.sort(key=lambda x: (x[1], kinds.index(x[0])))
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))


def test_op4(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for i, t in docs.items():
        found = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        n = [sum(k == x for x, *_ in found) for k in ("assign", "access", "hex")]
        want[i] = (*n, spans_digest(found, ("assign", "access", "hex")))
    got = queries.op4_secrets(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == want
    for r in got:
        base = [x for x in (r["spans"].split(",") if r["spans"] else []) if not x.startswith("entropy:")]
        assert sha(",".join(base)) == r["base_sha256"]


def test_op5(spark, docs):
    prints = {i: simhash_by_hand(t) for i, t in docs.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    comp = least_reachable(ids, links)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in ids}


def test_op7(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op7_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    rows = [(toxicity.words(docs[i]), y) for i, y in labels.items() if i in docs and zlib.crc32(str(i).encode()) % 3 != 1]
    assert rows
    for i, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= score <= 1 and predicted == (score >= 0.7)


def test_op10(spark, docs):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    want = {}
    for i, t in docs.items():
        found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d)]
        found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        kinds = ("email", "ip", "card", "phone")
        n = [sum(k == x for x, *_ in found) for k in kinds]
        want[i] = (*n, spans_digest(found, kinds))
    got = queries.op10_personal(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want
    assert all(x.split(":")[0] in pii.KINDS for r in got if r["spans"] for x in r["spans"].split(","))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


def sketch_by_hand(text, scale=8, size=5):
    """Retained hashes and the least of all, from whole texts, as the library's xxhash makes them."""
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    shingles = [words[i : i + size] for i in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []
    hashes = set()
    for s in shingles:
        h = 42
        for w in s:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        hashes.add(h - (1 << 64) if h >> 63 else h)
    return sorted(h for h in hashes if h < -(1 << 63) + (1 << 64) // scale), min(hashes, default=None)


def likeness_by_hand(a, b):
    if not a[0] and not b[0]:
        return float(a[1] == b[1])
    return len({*a[0]} & {*b[0]}) / len({*a[0]} | {*b[0]})


def test_op9_every_column_by_brute_force(spark, docs):
    digits = lambda h: f"{h % (1 << 64):016X}"
    show = lambda s: "".join(map(digits, s[0])) or ("-" + digits(s[1]) if s[1] is not None else "")
    ids = sorted(docs, reverse=True)
    want = {}
    for i, k in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = docs[i], len(docs[i]) // 2
        edited = t[: len(t) - n] + docs[k][:n]
        own, other, after = map(sketch_by_hand, (t, edited, docs[k]))
        want[i] = (len(t), sha(edited), show(own), show(other), likeness_by_hand(own, other), likeness_by_hand(own, after))
    got = {r["doc_id"]: tuple(r)[1:7] for r in queries.op9_fingerprints(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:], abs=1e-12)


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op4_secrets", "op5_simhash", "op8_suffix_dedup", "op10_personal", "op12_quality_rules", "op13_periodic_runs"])
def test_other_columns_of_any_name_change_nothing(spark, tmp_path, name):
    """Columns that operators name so themselves, beside those of the table, and one text of more than a slice."""
    rows = [(1, "a plain text of some words", "en"), (2, None, "en"), (3, "", None), (4, "long words " * 420_000, "en"), (None, "no id at all", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    clash = {c: F.lit("x") for c in ("ids", "secrets", "spans", "runs", "simhash", "component_id", "node", "kept", "script", "class", "n_words", "personal", "strongest", "n_bytes", "source", "n_chars")}
    df.withColumns(clash).write.parquet(f"{tmp_path}/b/documents.parquet")
    plain, clashing = (sorted(map(repr, queries.QUERIES[name](spark, f"{tmp_path}/{d}").collect())) for d in "ab")
    assert plain == clashing and len(plain) == len(rows)
