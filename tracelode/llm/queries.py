"""One query an operator, over whole tables with production parameters, and DuckDB SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame) -> DataFrame:
    """Id and text of each document, a null text as the empty one."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(whole(table(spark, sf_dir, "documents")), "text", path, public_tokenizers.PATTERN).drop("text")
    back = decode(coded, "ids", path, "decoded")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, spans_text

    found = find_secrets(whole(table(spark, sf_dir, "documents")), "text", "secrets").drop("text")
    spans = F.col("secrets")
    base = spans_text(F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex")))
    return found.select("doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(base, 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op10_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal
    from .secrets import spans_text

    found = find_personal(whole(table(spark, sf_dir, "documents")), "text", "personal").drop("text")
    spans, kinds = F.col("personal"), ("email", "ip", "card", "phone")
    base = spans_text(F.filter(spans, lambda s: s["kind"].isin(*kinds)))
    return found.select("doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in kinds], F.sha2(base, 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("simhash")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import containment, fingerprint, likeness, sketch, with_next

    docs = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_part", F.lit("")), F.lit(1), half))
    made = docs.select("doc_id", n.cast("long").alias("n_chars"), "sketch", edited.alias("edited"), F.coalesce("next_sketch", sketch(F.lit(""))).alias("next_sketch"))
    made = made.withColumn("edited_sketch", sketch(F.col("edited")))
    own, other = F.col("sketch"), F.col("edited_sketch")
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, F.col("next_sketch")).alias("near_next"), containment(own, other).alias("contained_in_edited"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .fertility import VOCABULARIES, quality

    files = [(name, public_tokenizers.path(file)) for name, file in VOCABULARIES]
    return quality(table(spark, sf_dir, "documents"), vocabularies=files, pattern=public_tokenizers.PATTERN)


def planted(docs: DataFrame) -> DataFrame:
    """Texts whose words repeat from some place on, in one document of ten, as the contract of operator 13 states."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    ws = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.transform(F.array(ws), lambda x: F.when(F.size(x) > 0, repeat(x)).otherwise(F.lit("")))[0]  # the array gives the words a name
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import with_runs

    found = with_runs(planted(whole(table(spark, sf_dir, "documents")))).drop("text")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_embedding_near_dedup, op3_best_fit, op4_secrets, op5_simhash, op6_warc, op7_toxicity, op8_suffix_dedup, op9_fingerprints, op10_personal, op11_whitening, op12_quality_rules, op13_periodic_runs)
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS r FROM v),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.r > 0 AND b.r > 0 AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.98
        ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS k FROM links GROUP BY a)
        SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
        FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                (('0x' || substr(p.h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f ON p.h = f.h
    """,
    "op13_periodic_runs": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295::BIGINT, list_reduce(
                flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
                lambda crc, s: CASE WHEN s >= 0 THEN xor(crc, s) ELSE xor(crc >> 1, 3988292384::BIGINT * (crc & 1)) END)) AS h
            FROM documents
        ), g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AS hit, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM t),
        d AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
        w0 AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(ws) AS word FROM d),
        place AS (SELECT doc_id, n, i, CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END AS src FROM (SELECT doc_id, n, hit, a, p, unnest(range(0, n)) AS i FROM d)),
        w AS (SELECT place.doc_id, place.i, word FROM place JOIN w0 ON w0.doc_id = place.doc_id AND w0.i = src),
        grid AS (SELECT doc_id, p, unnest(range(0, (n - 1) // p - 2)) * p AS x FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS p FROM d)),
        pairs AS MATERIALIZED (SELECT grid.doc_id, p, x, b.word AS u, c.word AS v FROM grid JOIN w b ON b.doc_id = grid.doc_id AND b.i = x JOIN w c ON c.doc_id = grid.doc_id AND c.i = x + p),
        one AS MATERIALIZED (SELECT doc_id, p, x, u FROM pairs WHERE u = v),
        more AS MATERIALIZED (SELECT one.doc_id, p, u, b.word AS v, c.word AS z FROM one JOIN w b ON b.doc_id = one.doc_id AND b.i = x + 2 * p JOIN w c ON c.doc_id = one.doc_id AND c.i = x + 3 * p),
        seen AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM more WHERE u = v AND u = z),
        shifted AS MATERIALIZED (SELECT s.doc_id, p, b.i, b.word AS u, c.word AS v FROM seen s JOIN w b ON b.doc_id = s.doc_id JOIN w c ON c.doc_id = s.doc_id AND c.i = b.i + p),
        same AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM shifted WHERE u = v),
        long AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM same GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
        runs AS (SELECT doc_id, start, length, min(p) AS period FROM long GROUP BY doc_id, start, length),
        told AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                arg_min({'start': start, 'length': length, 'period': period}, {'k': -(length::DOUBLE / period), 's': start, 'p': period}) AS best
            FROM runs GROUP BY doc_id
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
