"""Checks of records against blocks, registries and files. Each returns the rows at fault, so an empty result means that it holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import CONFIG, DECISIONS
from ..functions import text as X

#: Characters of the quotes that one scan of the blocks looks for.
SCANNED = 4_000_000


def evidence_fk(cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Citations (evidence_id) of blocks that don't exist."""
    return cited.join(blocks.select("evidence_id").distinct(), "evidence_id", "left_anti")


def section_page_trace(cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Citations whose section or page is not the block's."""
    b = blocks.select("evidence_id", F.col("section_id").alias("block_section"), F.col("page").alias("block_page"))
    return cited.join(b, "evidence_id").where(~(F.col("section_id").eqNullSafe(F.col("block_section")) & F.col("page").eqNullSafe(F.col("block_page"))))


def quote_check(cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each citation (evidence_id, verbatim_quote) with whether its block holds the quote, and where: an equi-join, then containment."""
    b = blocks.select("evidence_id", F.col("text").alias("__text"))
    at = X.quote_offset(F.col("__text"), F.col("verbatim_quote"))
    return cited.join(b, "evidence_id", "left").withColumn("quote_start", F.coalesce(at, F.lit(-1))).withColumn("quote_ok", F.col("quote_start") >= 0).drop("__text")


def find_quotes(quotes: DataFrame, blocks: DataFrame, id_col: str = "evidence_id") -> DataFrame:
    """Blocks that hold a quote (item_id, text) verbatim where no block is named: (item_id, id, quote_start), the first place in code points.

    Quotes of ``SCANNED`` characters in all, as their count shows, are one automaton that goes over each text once, where it lies. Of more quotes those
    with three words or more go by their inner words, which a block that holds them has as whole words: the rarest leads to the blocks
    that may hold it. The others, which have no inner word, go by automata of ``SCANNED`` characters each. Null and empty quotes name no place.
    """
    asked = quotes.where("text is not null and text <> ''").select("item_id", F.col("text").alias("quote")).distinct()
    text = blocks.where("text is not null").select(F.col(id_col).alias("id"), "text")
    size = asked.agg(F.sum(F.char_length("quote"))).first()[0] or 0
    if size <= SCANNED:
        return scan_for(asked, text)
    asked = asked.withColumn("ts", X.tokens(F.col("quote")))
    found = by_inner_words(asked.where(F.size("ts") > 2), text)
    short = asked.where(F.size("ts") <= 2).select("item_id", "quote")
    parts = -(-(short.agg(F.sum(F.char_length("quote"))).first()[0] or 0) // SCANNED)
    for k in range(parts):
        found = found.unionByName(scan_for(short.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(parts)) == k), text))
    return found


def scan_for(asked: DataFrame, text: DataFrame) -> DataFrame:
    """One pass over texts (id, text) with an automaton of quotes (item_id, quote), whose size the caller has bounded."""
    items: dict[str, list] = {}
    for item, quote in asked.collect():
        items.setdefault(quote, []).append(item)
    kinds = f"item_id {asked.schema['item_id'].dataType.simpleString()}, id {text.schema['id'].dataType.simpleString()}, quote_start int"
    held = text.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for q in held.value:
            automaton.add_word(q, q)
        if not held.value:
            return
        automaton.make_automaton()
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                first: dict[str, int] = {}
                for end, q in automaton.iter(t.as_py()):
                    first.setdefault(q, end - len(q) + 1)
                out += [(item, i, at) for q, at in first.items() for item in held.value[q]]
            item_ids, ids, starts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item_ids, types.field(0).type), pa.array(ids, types.field(1).type), pa.array(starts, pa.int32())], names=types.names)

    types = to_arrow_schema(T._parse_datatype_string(kinds))
    return text.select("id", "text").mapInArrow(run, kinds)


def by_inner_words(asked: DataFrame, text: DataFrame) -> DataFrame:
    """Quotes (item_id, quote, ts) of three words or more, by the rarest word that is not at their ends."""
    from .retrieval import small_side

    inner = asked.select("item_id", "quote", F.explode(F.array_distinct(F.slice("ts", 2, F.size("ts") - 2))).alias("term"))
    wanted = inner.select("term").distinct()
    held = text.select("id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).join(small_side(wanted, 100_000), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rare = inner.join(df, "term", "left").groupBy("item_id", "quote").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    maybe = held.join(rare, "term").select("item_id", "quote", "id").distinct()
    return text.join(small_side(maybe, 100_000), "id").where(F.contains("text", "quote")).select("item_id", "id", (F.instr("text", F.col("quote")) - 1).alias("quote_start"))


def manifest_fk(records: DataFrame, manifest: DataFrame, key: str = "call_id") -> DataFrame:
    """Records of calls that the manifest doesn't have."""
    return records.join(manifest.select(key).distinct(), key, "left_anti")


def label_legality(records: DataFrame, registry: DataFrame, version: str) -> DataFrame:
    """Records whose label a schema version doesn't know; missing states are labels like any other."""
    legal = registry.where(F.col("schema_version") == version).select("dimension", "label").distinct()
    return records.join(legal, ["dimension", "label"], "left_anti")


def schema_compat(records: DataFrame, registry: DataFrame, old: str, new: str) -> DataFrame:
    """Records of the old version that the new one would refuse."""
    return label_legality(records.where(F.col("schema_version") == old), registry, new)


def legal_versions(records: DataFrame, history: DataFrame, versions: tuple[int, ...]) -> DataFrame:
    """Records (version, dimension, label) under their own and every later schema version: (version, under, dimension, n, n_legal).

    ``history`` is append-only: (dimension, label, since, until), a label being legal from ``since`` up to but without ``until``, which is null while it
    stays. A label that comes back has another interval. Records are counted by version and label before they meet the intervals.
    """
    counts = records.groupBy("version", "dimension", "label").agg(F.count("*").alias("n"))
    under = counts.withColumn("under", F.explode(F.array(*map(F.lit, versions)))).where("under >= version")
    spans = history.select("dimension", "label", "since", "until").distinct()
    legal = under.join(spans, ["dimension", "label"]).where("since <= under AND (until IS NULL OR under < until)").select("version", "dimension", "label", "under").distinct().withColumn("ok", F.lit(1))
    return under.join(legal, ["version", "dimension", "label", "under"], "left").groupBy("version", "under", "dimension").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ok") == 1, F.col("n")).otherwise(0)).alias("n_legal"))


def critic_faults(reviews: DataFrame) -> DataFrame:
    """Reviews with an unknown decision or a confidence outside 0..1, with the reason."""
    fault = F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "decision").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    return reviews.withColumn("fault", fault).where("fault is not null")


def zone_limits(records: DataFrame, blocks: DataFrame, dimensions: tuple[str, ...] = tuple(f"D{i:02d}" for i in range(2, 10))) -> DataFrame:
    """Records of dimensions that need full text whose evidence is all from title, abstract or introduction (zone A)."""
    cited = records.where(F.col("dimension").isin(*dimensions)).select("doc_id", "dimension", F.explode("evidence.evidence_id").alias("evidence_id"))
    return cited.join(blocks.select("evidence_id", "zone"), "evidence_id").groupBy("doc_id", "dimension").agg(F.bool_and(F.col("zone") == "A").alias("only_a")).where("only_a").drop("only_a")


def dup_files(files: DataFrame) -> DataFrame:
    """Hashes that several files share."""
    return files.groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def year_conflict(docs: DataFrame) -> DataFrame:
    """All years are kept; the flag says that those which are known differ."""
    years = F.array_distinct(F.filter(F.array("year_print", "year_online", "year_doi"), lambda y: y.isNotNull()))
    return docs.withColumn("year_conflict", F.size(years) > 1)


def active_records(records: DataFrame, inactive: tuple[str, ...] = CONFIG.inactive_dimensions) -> DataFrame:
    return records.where(~F.col("dimension").isin(*inactive))


def quarantined(records: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Records with their state: quarantined pairs (doc_id, dimension) stay visible but out of use."""
    q = quarantine.select("doc_id", "dimension", F.lit("quarantined").alias("__q")).distinct()
    return records.join(q, ["doc_id", "dimension"], "left").withColumn("state", F.coalesce("__q", F.lit("active"))).drop("__q")


def complete_sample_gate(ledger: DataFrame, n_docs: int = CONFIG.expected_documents, n_dimensions: int = len(CONFIG.dimensions)) -> DataFrame:
    """One row: whether the ledger (doc_id, dimension, origin) is a complete one of real records."""
    per_doc = ledger.groupBy("doc_id").agg(F.count_distinct("dimension").alias("k"), F.bool_and(F.col("origin") == "real").alias("real"))
    return per_doc.agg(F.count("*").alias("n_docs"), F.coalesce(F.min("k"), F.lit(0)).alias("least_dimensions"), F.coalesce(F.bool_and("real"), F.lit(False)).alias("all_real")).withColumn(
        "accepted", (F.col("n_docs") == n_docs) & (F.col("least_dimensions") == n_dimensions) & F.col("all_real")
    )


def screening_funnel(candidates: DataFrame) -> DataFrame:
    """Candidates by the reason for which they were left out, the kept ones under 'included'."""
    return candidates.groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


def latest_version(rows: DataFrame, keys: tuple[str, ...], version: str = "version") -> DataFrame:
    """The row of the highest version of each key; older rows stay where they are."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def split_leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both splits."""
    return a.select(key).intersect(b.select(key))


def span_overlap(spans: DataFrame, bucket: int = 1000) -> DataFrame:
    """Pairs of spans (doc_id, span_id, char_start, char_end) of one document that overlap, and by how much.

    Spans meet in the character buckets that they touch, and a pair is taken in the first bucket that both touch.
    """
    put = spans.where("char_end > char_start").withColumn("b", F.explode(F.sequence(F.floor(F.col("char_start") / bucket), F.floor((F.col("char_end") - 1) / bucket))))
    x, y = put.alias("x"), put.alias("y")
    first = F.floor(F.greatest("x.char_start", "y.char_start") / bucket)
    on = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.span_id") < F.col("y.span_id"))
    both = x.join(y, on & (F.col("x.b") == first) & (F.col("x.char_start") < F.col("y.char_end")) & (F.col("y.char_start") < F.col("x.char_end")))
    return both.select(F.col("x.doc_id").alias("doc_id"), F.col("x.span_id").alias("span_a"), F.col("y.span_id").alias("span_b"), (F.least("x.char_end", "y.char_end") - F.greatest("x.char_start", "y.char_start")).alias("overlap"))


def gate(checks: DataFrame) -> DataFrame:
    """One verdict from named checks (check_name, value, threshold, at_least); a check without a value fails."""
    ok: Column = F.when(F.col("at_least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return checks.agg(F.count("*").alias("n_checks"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed"), F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("passed"))
