"""The four passes of extraction and review, and where model answers may come from.

No answer is made up here: the ``dry_run`` provider returns none and says so, ``recorded`` replays stored ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DECISIONS, NOT_STATED
from ..functions import text as X

#: A provider turns prompts into (content, failure_reason) pairs, and never raises for a single call.
Provider = Callable[[list[str]], list[tuple[str | None, str | None]]]
PROVIDERS: dict[str, Callable[..., Provider]] = {}


def provider(name: str):
    def add(make: Callable[..., Provider]) -> Callable[..., Provider]:
        PROVIDERS[name] = make
        return make

    return add


@provider("dry_run")
def dry_run() -> Provider:
    return lambda prompts: [(None, "dry_run: no model was called")] * len(prompts)


@provider("recorded")
def recorded(answers: dict[str, str]) -> Provider:
    """Replay stored answers by the hash of their prompt; the store is small and is sent with the call."""
    import hashlib

    def run(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        keys = [hashlib.sha256(p.encode()).hexdigest() for p in prompts]
        return [(answers.get(k), None if k in answers else "recorded: no stored answer") for k in keys]

    return run


def extract(contexts: DataFrame, name: str = "dry_run", retries: int = 0, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Calls for contexts (call_id, agent_name, prompt): a row each with content, failure and hashes, and the columns of ``keep``.

    ``replay`` takes answers from a table (call_id, content), by a join; all other providers are functions of prompts. Keys are never a column.
    """
    src = contexts.select(*keep, F.col("call_id").cast("string").alias("call_id"), "agent_name", "prompt", X.sha256(F.col("prompt")).alias("input_hash"))
    if name == "replay":
        stored = options["answers"].select("call_id", "content")
        failure = F.when(F.col("content").isNull(), F.lit("replay: no stored answer"))
        called = src.drop("prompt").join(stored, "call_id", "left").withColumn("failure_reason", failure).withColumn("retries", F.lit(0))
    else:
        make = PROVIDERS[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            answer = make(**options)
            for b in batches:
                got = answer(b["prompt"].tolist())
                tries = [0] * len(got)
                for k in range(retries):
                    again = [i for i, (c, _) in enumerate(got) if c is None]
                    for i, x in zip(again, answer([b["prompt"].iloc[i] for i in again]) if again else [], strict=True):
                        got[i], tries[i] = x, k + 1
                yield b.drop(columns="prompt").assign(content=[c for c, _ in got], failure_reason=[f for _, f in got], retries=tries)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "prompt")
        called = src.mapInPandas(run, f"{kinds}, content string, failure_reason string, retries int")
    return called.select(*keep, "call_id", "agent_name", F.lit(name).alias("provider"), "content", "failure_reason", "retries", "input_hash", X.sha256(F.col("content")).alias("output_hash"))


def parsed(calls: DataFrame, schema: str) -> DataFrame:
    """Completions as structures; what is no JSON object stays as text beside a null."""
    return calls.withColumn("json", X.json_object(F.col("content"))).withColumn("record", F.from_json("json", schema, {"mode": "PERMISSIVE"}))


def critic_view(records: DataFrame) -> DataFrame:
    """What a reviewer may see of an extraction: not its reasoning."""
    return records.drop("mechanism", "uncertainty", "reasoning", "reasoning_content")


#: What an extraction and a review answer with.
A_RECORD = "label string, evidence_id string, quote string, mechanism string, uncertainty string"
B_RECORD = "decision string, corrected_label string, critic_comment string, supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>, confidence double"


def prompt(n: int, agent: str) -> Column:
    """Task, dimension, whole text, what the other agent may be told of the extraction, and the last review."""
    return F.concat_ws("\n", F.lit(f"pass {n}, agent {agent}"), "dimension", F.coalesce("text", F.lit("")), F.coalesce("extraction", F.lit("")), F.coalesce("review", F.lit("")))


def call_id(*parts: Column) -> Column:
    """One id of some values, among which a null is a value of its own."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def merged_extractions(answers: DataFrame) -> DataFrame:
    """One record a document and dimension from the answers of its windows (key, dimension, window_no, label, stated, evidence_id, quote, answered).

    The merge is associative: counts, and of each label its windows and first evidence. One label that is stated is the record's; several are a
    conflict, kept as candidates and without a label; none, in windows that were read, is ``Not_Stated_In_Text``.
    """
    label = F.when(F.col("stated"), F.col("label"))
    each = answers.groupBy("key", "dimension", label.alias("label")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("answered")).alias("unread"), F.min(F.struct("window_no", "evidence_id", "quote")).alias("first"), F.min("failure_reason").alias("failure_reason"), F.min("input_hash").alias("input_hash"),
    )
    candidate = F.when(F.col("label").isNotNull(), F.struct("label", F.col("n").alias("n_windows"), F.col("first.evidence_id").alias("evidence_id"), F.col("first.quote").alias("quote")))
    one = each.groupBy("key", "dimension").agg(F.sum("n").alias("n_windows"), F.sum("unread").alias("n_unread"), F.array_sort(F.collect_list(candidate)).alias("candidates"), F.min("failure_reason").alias("failure_reason"), F.min("input_hash").alias("input_hash"))
    n, none_read = F.size("candidates"), F.col("n_unread") == F.col("n_windows")
    state = F.when(n > 1, "conflict").when(n == 1, "stated").when(none_read, "unanswered").otherwise("not_stated")
    return one.withColumn("state", state).withColumn("label", F.when(n == 1, F.col("candidates")[0]["label"]).when((n == 0) & ~none_read, F.lit(NOT_STATED)))


def merged_reviews(answers: DataFrame) -> DataFrame:
    """One review a document and dimension from those of its windows: the strictest decision, in the order reject, revise, accept,
    insufficient_evidence. Windows that want different labels agree on none: insufficient_evidence."""
    r = F.col("record")
    said = lambda d: r["decision"] == d
    fixed = F.when(said("revise"), r["corrected_label"])
    one = answers.groupBy("key", "dimension").agg(
        F.count("*").alias("n_windows"), F.count_if(~F.coalesce(r["decision"].isin(*DECISIONS), F.lit(False))).alias("n_unread"), *[F.coalesce(F.bool_or(said(d)), F.lit(False)).alias(d) for d in DECISIONS],
        F.min(fixed).alias("low"), F.max(fixed).alias("corrected_label"), F.min(F.struct("window_no", r["critic_comment"].alias("comment"))).alias("first"), F.min("failure_reason").alias("failure_reason"), F.min("input_hash").alias("input_hash"),
    )
    agreed = F.col("low").eqNullSafe(F.col("corrected_label"))
    decision = F.when(F.col("reject"), "reject").when(F.col("revise"), F.when(agreed, "revise").otherwise("insufficient_evidence")).when(F.col("accept"), "accept").when(F.col("insufficient_evidence"), "insufficient_evidence")
    one = one.withColumn("decision", decision)
    return one.withColumn("review", F.when(F.col("decision").isNotNull(), F.to_json(F.struct("decision", "corrected_label", F.col("first.comment").alias("critic_comment")))))


def with_texts(answers: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Answers with the text of their window: those of a window are one row when they meet it, so that each text is exchanged once."""
    place = [*keys, "window_no"]
    told = [c for c in ("dimension", "failure_reason", "input_hash", "record") if c not in keys]
    of = answers.groupBy(*[F.col(c).alias(f"__{c}") for c in place]).agg(F.collect_list(F.struct(*told)).alias("told"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
    return windows.select(*place, "text").join(of, same).select(*place, "text", F.explode("told").alias("told")).select(*place, "text", "told.*")


def four_passes(contexts: DataFrame, a: str = "dry_run", b: str = "dry_run", stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, options_a: dict | None = None, options_b: dict | None = None, retries: int = 0, dimensions: tuple[str, ...] | None = None, passes: int = 4) -> DataFrame:
    """Extraction, review, revision and last review: a log row a document, dimension and pass.

    Contexts are (doc_id, text), with ``window_no`` where a document is read in several windows, and with ``dimension`` unless ``dimensions`` names
    those that every document is asked for; fewer ``passes`` end after the first ones. Every window of a document is a call of each pass; the answers of a pass are merged before the next one
    is asked. ``stage`` writes calls and merged states, so that no call is made twice. A reviewer never sees mechanism or uncertainty. A label whose
    quote does not stand in its window is not stated; a review that accepts keeps the label, one that revises gives its own, any other gives none.

    Defined cases: repeated windows are one (of several texts the least); all rows of a null id are one document; a null text is the empty one;
    answers that are no JSON are not read. Texts are joined with the small states of a document and with the answers of a window, never multiplied by
    dimensions before an exchange; prompts are not exchanged at all.
    """
    own = "dimension" in contexts.columns
    keys = ["key", "dimension"] if own else ["key"]
    window = F.col("window_no") if "window_no" in contexts.columns else F.lit(0)
    once = contexts.select(F.unhex(call_id(F.col("doc_id"))).alias("key"), *keys[1:], window.cast("int").alias("window_no"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    repeated = stage(once.groupBy(*keys, "window_no").agg(F.count("*").alias("n")).where("n > 1"), "repeated-windows")
    once = stage(once if repeated.isEmpty() else once.groupBy(*keys, "window_no").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")), "windows")
    asked = once.select(*keys, "doc_id").distinct()
    asked = asked if own else asked.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions or ()))))
    state = asked.select("key", "dimension", "doc_id", *[F.lit(None).cast("string").alias(c) for c in ("extraction", "review", "label")])
    log = None
    for n, agent in enumerate("ABAB"[:passes], 1):
        if own:
            put = once.join(state.drop("doc_id"), keys)
        elif n == 1:
            put = once.select("*", F.explode(F.array(*map(F.lit, dimensions or ()))).alias("dimension"), *[F.lit(None).cast("string").alias(c) for c in ("extraction", "review")])
        else:
            each = state.groupBy("key").agg(F.collect_list(F.struct("dimension", "extraction", "review")).alias("asks"))
            put = once.join(each, "key").select("key", "doc_id", "window_no", "text", F.explode("asks").alias("ask")).select("key", "doc_id", "window_no", "text", "ask.*")
        put = put.withColumn("call_id", call_id(F.col("doc_id"), F.col("dimension"), F.col("window_no"), F.lit(n))).withColumn("agent_name", F.lit(agent)).withColumn("prompt", prompt(n, agent))
        name, options = (a, options_a) if agent == "A" else (b, options_b)
        held = ("text",) if agent == "A" and name != "replay" else ()
        answers = parsed(extract(put, name, retries, ("key", "dimension", "window_no", *held), **(options or {})), A_RECORD if agent == "A" else B_RECORD)
        if agent == "A" and not held:
            answers = with_texts(answers, once, keys)
        r = F.col("record")
        if agent == "A":
            stated = F.coalesce(F.contains("text", r["quote"]) & (r["quote"] != "") & r["label"].isNotNull(), F.lit(False))
            answers = answers.select("key", "dimension", "window_no", "failure_reason", "input_hash", r.isNotNull().alias("answered"), stated.alias("stated"), r["label"].alias("label"), r["evidence_id"].alias("evidence_id"), r["quote"].alias("quote"))
            made = merged_extractions(stage(answers, f"pass-{n}"))
            told = F.when(F.col("state") != "unanswered", F.to_json(F.struct("label", "state", "candidates")))
            made = made.select("key", "dimension", "label", told.alias("extraction"), F.lit(None).cast("string").alias("decision"), "state", "n_windows", "n_unread", "failure_reason", "input_hash")
            state = state.drop("extraction", "label").join(made, ["key", "dimension"])
        else:
            made = merged_reviews(stage(answers.select("key", "dimension", "window_no", "failure_reason", "input_hash", "record"), f"pass-{n}"))
            made = made.select("key", "dimension", "decision", "corrected_label", "review", "n_windows", "n_unread", "failure_reason", "input_hash")
            kept = F.when(F.col("decision") == "accept", F.col("label")).when(F.col("decision") == "revise", F.col("corrected_label"))
            state = state.drop("review").join(made, ["key", "dimension"]).withColumn("label", kept).withColumn("state", F.lit(None).cast("string")).drop("corrected_label")
        state = stage(state, f"state-{n}")
        one = state.select("doc_id", "dimension", F.lit(n).alias("pass"), F.lit(agent).alias("agent"), "label", "decision", "state", "n_windows", "n_unread", "failure_reason", "input_hash")
        log = one if log is None else log.unionByName(one)
        state = state.select("key", "dimension", "doc_id", "extraction", "review", "label")
    return log


def protocol_final_state(log: DataFrame) -> DataFrame:
    """Last entry of each agent by (doc_id, dimension), and the number of passes. ``log``: doc_id, dimension, pass, agent, label."""
    last = lambda a: F.max_by(F.when(F.col("agent") == a, F.col("label")), F.when(F.col("agent") == a, F.col("pass")))
    out = log.groupBy("doc_id", "dimension").agg(F.max("pass").alias("passes"), F.max_by("label", "pass").alias("final_label"), last("A").alias("last_a"), last("B").alias("last_b"))
    return out.withColumn("adjudication_required", ~F.col("last_a").eqNullSafe(F.col("last_b")))


def adjudication_queue(log: DataFrame) -> DataFrame:
    """Records on which both agents' last labels differ: for a human, never put to a vote."""
    return protocol_final_state(log).where("adjudication_required")


def up_to_pass(log: DataFrame, mode: str) -> DataFrame:
    """The critic ablation: what each mode would have seen."""
    return log.where(F.col("pass") <= {"A-only": 1, "A+B": 2, "A+B+A+B": 4}[mode])


def independence(calls: DataFrame, families: DataFrame) -> DataFrame:
    """Whether extraction and review of a record came from different model families (model_name, family)."""
    f = calls.join(families, "model_name", "left")
    per = f.groupBy("record_id").agg(F.collect_set(F.when(F.col("agent_name") == "A", F.col("family"))).alias("a"), F.collect_set(F.when(F.col("agent_name") == "B", F.col("family"))).alias("b"))
    return per.withColumn("independent", (F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b"))


def passes_complete(log: DataFrame, expected: int = 4) -> DataFrame:
    """Records whose passes are not 1..expected without a gap."""
    n = log.groupBy("doc_id", "dimension").agg(F.count_distinct("pass").alias("n"), F.max("pass").alias("m"))
    return n.where((F.col("n") != expected) | (F.col("m") != expected))
