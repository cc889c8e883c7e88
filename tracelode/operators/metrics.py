"""Evaluation metrics. Means over queries, labels and documents say which in their name; ratios are rounded to six digits."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONFIG


# The contrasts of arms that the study tests.
CONTRASTS = (("G4", "G3"), ("G3", "G1"), ("G3", "G2"), ("G5", "G4"))


def six(c: Column) -> Column:
    return F.round(c, 6)


def recall_at_k(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Macro recall over queries with a relevant id (query_id, id), for each k."""
    rel = relevant.select("query_id", "id").distinct()
    hit = rel.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    per = hit.groupBy("query_id").agg(*[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"r{k}") for k in ks])
    wide = per.agg(F.count("*").alias("n_queries"), *[six(F.avg(f"r{k}")).alias(f"r{k}") for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall"), "n_queries") for k in ks])).alias("x")).select("x.*")


def section_coverage(eligible: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Of the sections (doc_id, section) that could be read, the share that was, and the share that was not."""
    e, r = eligible.select("doc_id", "section").distinct(), retrieved.select("doc_id", "section").distinct().withColumn("hit", F.lit(1))
    return e.join(r, ["doc_id", "section"], "left").agg(F.count("*").alias("n_sections"), six(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0))).alias("coverage"), six(F.coalesce(F.avg(1 - F.coalesce("hit", F.lit(0))), F.lit(0.0))).alias("unread_share"))


def gold_join(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold and prediction by item_id; what one side lacks is an error, not a gap."""
    g, p = gold.select("item_id", F.col("label").alias("gold")), predicted.select("item_id", F.col("label").alias("predicted"))
    out = g.join(p, "item_id", "full_outer")
    return out.withColumn("status", F.when(F.col("gold").isNull(), "unexpected").when(F.col("predicted").isNull(), "missing").when(F.col("gold") == F.col("predicted"), "correct").otherwise("wrong"))


def confusion(pairs: DataFrame, a: str = "gold", b: str = "predicted") -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Accuracy and macro F1 over the labels of gold and predicted; a missing prediction counts against its gold label."""
    n = confusion(pairs)
    rows = n.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("g").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("x"), "gold", "predicted", "n")
    per = rows.select("x.*", "gold", "predicted", "n").where("label is not null").groupBy("label").agg(
        F.sum(F.when((F.col("side") == "g") & (F.col("gold") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "g", F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("p"),
    )
    f1 = per.agg(F.count("*").alias("n_labels"), six(F.avg(2 * F.col("tp") / (F.col("g") + F.col("p")))).alias("macro_f1"))
    acc = n.agg(six(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return f1.crossJoin(acc)


def precision_by(pairs: DataFrame, by: str = "dimension") -> DataFrame:
    """Of the predictions of each group, the share that is the gold label; a prediction without gold is wrong."""
    told = pairs.where("predicted is not null")
    return told.groupBy(by).agg(F.count("*").alias("n"), six(F.avg(F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False)).cast("double"))).alias("precision"))


def case_recall(gold: DataFrame, flagged: DataFrame, keys: tuple[str, ...] = ("doc_id", "dimension")) -> DataFrame:
    """Of the known cases, such as contradictions, the share that was flagged."""
    g = gold.select(*keys).distinct()
    hit = g.join(flagged.select(*keys).distinct().withColumn("hit", F.lit(1.0)), list(keys), "left")
    return hit.agg(F.count("*").alias("n_cases"), F.count("hit").alias("n_flagged"), six(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("recall"))


def unsupported_rate(claims: DataFrame, support: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims, and the share that nothing supports."""
    has = support.select(key).distinct().withColumn("has", F.lit(1))
    return claims.select(key).distinct().join(has, key, "left").agg(F.count("*").alias("n_claims"), six(F.avg(F.col("has").isNull().cast("double"))).alias("unsupported_rate"))


def misattributed_share(cited: DataFrame, found: DataFrame) -> DataFrame:
    """Citations (item_id, id) whose quote is not in the block they name: how many are in another one, how many nowhere."""
    here = found.select("item_id", "id").distinct().withColumn("here", F.lit(True))
    any_ = found.select("item_id").distinct().withColumn("anywhere", F.lit(True))
    x = cited.select("item_id", "id").distinct().join(here, ["item_id", "id"], "left").join(any_, "item_id", "left")
    elsewhere = F.col("here").isNull() & F.col("anywhere").isNotNull()
    return x.agg(F.count("*").alias("n_cited"), F.count_if(elsewhere).alias("n_misattributed"), F.count_if(F.col("anywhere").isNull()).alias("n_nowhere"), six(F.avg(elsewhere.cast("double"))).alias("misattributed_share"))


def call_cost(calls: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Cost of calls by ``prices`` (keys, input_price, output_price a million tokens); calls without a price are counted apart."""
    priced = calls.join(prices, list(keys), "left")
    each = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return priced.groupBy(*keys).agg(F.count("*").alias("n_calls"), six(F.sum(each)).alias("cost"), F.count_if(each.isNull()).alias("n_unpriced"))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Agreement beyond chance of two codings, from their confusion counts."""
    n = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = n.groupBy(*by, F.col(a).alias("l")).agg(F.sum("n").alias("na")), n.groupBy(*by, F.col(b).alias("l")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "l"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("c"))
    both = total.join(chance, list(by), "left") if by else total.crossJoin(chance)
    po, pe = F.col("same") / F.col("t"), F.coalesce(F.col("c"), F.lit(0)) / (F.col("t") * F.col("t"))
    return both.select(*by, F.col("t").alias("n"), six(po).alias("agreement"), six(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)).alias("kappa"))


def krippendorff_alpha(codes: DataFrame) -> DataFrame:
    """Nominal alpha of codings (item_id, annotator, label); items with fewer than two codes don't count, gaps are allowed."""
    per = codes.where("label is not null").groupBy("item_id", "label").agg(F.count("*").alias("n"))
    m = per.groupBy("item_id").agg(F.sum("n").alias("m")).where("m > 1")
    used = per.join(m, "item_id")
    within = used.groupBy("item_id", "m").agg(F.sum(F.col("n") * (F.col("m") - F.col("n"))).alias("d"))
    observed = within.agg(F.sum(F.col("d") / (F.col("m") - 1)).alias("do"), F.sum("m").alias("t"))
    values = used.groupBy("label").agg(F.sum("n").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("sq"))
    expected = (F.col("t") * F.col("t") - F.col("sq")) / (F.col("t") - 1)
    return observed.crossJoin(values).select(F.coalesce("t", F.lit(0)).cast("long").alias("n"), six(F.when(expected > 0, 1 - F.col("do") / expected).otherwise(1.0)).alias("alpha"))


def evidence_metrics(records: DataFrame) -> DataFrame:
    """Shares over cited records (sufficient, quote_ok, page_ok, section_ok, supported); citation precision is the share that is supported."""
    rate = lambda c: six(F.avg(F.col(c).cast("double")))
    return records.agg(F.count("*").alias("n"), rate("sufficient").alias("sufficiency"), rate("quote_ok").alias("quote_exact"), rate("page_ok").alias("page_accuracy"), rate("section_ok").alias("section_accuracy"), rate("supported").alias("citation_precision"), six(1 - F.avg(F.col("supported").cast("double"))).alias("unsupported_rate"))


def ab_agreement(first: DataFrame, review: DataFrame, final: DataFrame) -> DataFrame:
    """Agreement of extraction and review on (doc_id, dimension), the share corrected afterwards, and the share that stayed open."""
    a = first.select("doc_id", "dimension", F.col("label").alias("a"))
    b = review.select("doc_id", "dimension", F.col("label").alias("b"))
    f = final.select("doc_id", "dimension", F.col("label").alias("f"), F.col("unresolved").alias("u"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return a.join(b, ["doc_id", "dimension"]).join(f, ["doc_id", "dimension"], "left").agg(
        F.count("*").alias("n"), six(F.avg(same.cast("double"))).alias("agreement"), six(F.avg((~F.coalesce(F.col("f"), F.col("a")).eqNullSafe(F.col("a"))).cast("double"))).alias("correction_rate"), six(F.avg(F.coalesce("u", F.lit(False)).cast("double"))).alias("unresolved_rate"),
    )


def call_cost_latency(calls: DataFrame, keys: tuple[str, ...] = ("provider", "model_name", "prompt_version")) -> DataFrame:
    """Calls, tokens, latency quantiles, retries and failures."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), six(F.percentile("latency", 0.5)).alias("latency_p50"), six(F.percentile("latency", 0.95)).alias("latency_p95"),
        F.sum("retries").alias("retries"), six(F.avg(F.col("failure_reason").isNotNull().cast("double"))).alias("failure_rate"),
    )


def repeatability(calls: DataFrame) -> DataFrame:
    """Inputs that were asked more than once, and the share of them that always got the same output."""
    per = calls.groupBy("input_hash").agg(F.count("*").alias("n"), F.count_distinct("output_hash").alias("k")).where("n > 1")
    return per.agg(F.count("*").alias("n_repeated"), six(F.avg((F.col("k") == 1).cast("double"))).alias("identical_share"))


def draw(i: Column, j: Column, n: Column, seed: int) -> Column:
    """A pseudo-random index below n for draw i, place j: from a hash, so that any engine makes the same."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), j.cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), n)


def cluster_bootstrap(values: DataFrame, cluster: str, value: str, draws: int = CONFIG.bootstrap_draws, seed: int = CONFIG.seed) -> DataFrame:
    """Mean of a value with a 95 % interval, resampling whole clusters.

    Rows are summed by cluster first; what is resampled is a row a cluster, numbered in the order of its name. Draws and
    clusters are the statistic's own size, not the data's.
    """
    sums = values.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    numbered = sums.select((F.row_number().over(Window.orderBy(cluster)) - 1).cast("long").alias("idx"), "s", "c")
    n = numbered.agg(F.count("*").alias("n"))
    places = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("i")).select("n", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    picked = places.select("i", draw(F.col("i"), F.col("j"), F.col("n"), seed).alias("idx")).join(numbered, "idx")
    means = picked.groupBy("i").agg((F.sum("s") / F.sum("c")).alias("m"))
    whole = sums.agg(six(F.sum("s") / F.sum("c")).alias("mean"))
    return means.agg(six(F.percentile("m", 0.025)).alias("low"), six(F.percentile("m", 0.975)).alias("high")).crossJoin(whole)


def randomization_test(pairs: DataFrame, draws: int = CONFIG.bootstrap_draws, seed: int = CONFIG.seed) -> DataFrame:
    """Two-sided sign-flip test of a mean difference (cluster, diff), flipping whole clusters.

    Whole numbers and decimals are summed and compared exactly, so that ties stay ties whatever the number and order of rows. Doubles are taken
    as decimals of 18 digits after the point: their sums don't depend on the order of rows, but each difference keeps its own rounding error, which
    adds up over rows. Where scores are multiples of a unit, give differences in that unit; a p value has none.
    """
    kind = pairs.schema["diff"].dataType
    diff = F.col("diff").cast("decimal(38,18)") if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col("diff")
    sums = pairs.groupBy("cluster").agg(F.sum(diff).alias("s"))
    flips = sums.select("cluster", "s", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i"))
    kept = draw(F.col("i"), F.col("cluster"), F.lit(2), seed) == 0
    stats = flips.groupBy("i").agg(F.sum(F.when(kept, F.col("s")).otherwise(-F.col("s"))).alias("t"))
    seen = sums.agg(F.sum("s").alias("t0"))
    return stats.crossJoin(seen).agg(six((1 + F.count_if(F.abs("t") >= F.abs("t0") - F.lit(Decimal("1e-12")))) / (1 + F.count("*"))).alias("p_value"))


def holm(tests: DataFrame) -> DataFrame:
    """Step-down adjusted p values (name, p_value)."""
    order = Window.orderBy("p_value", "name")
    m = tests.count()
    raw = tests.withColumn("__r", F.row_number().over(order)).withColumn("__a", F.least(F.lit(1.0), F.col("p_value") * (m - F.col("__r") + 1)))
    return raw.withColumn("adjusted", six(F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__r", "__a")


def arm_contrast(scores: DataFrame, contrasts: tuple[tuple[str, str], ...] = CONTRASTS) -> DataFrame:
    """Mean paired differences of arms (arm, doc_id, dimension, score)."""
    out = None
    for high, low in contrasts:
        a = scores.where(F.col("arm") == high).select("doc_id", "dimension", F.col("score").alias("a"))
        b = scores.where(F.col("arm") == low).select("doc_id", "dimension", F.col("score").alias("b"))
        one = a.join(b, ["doc_id", "dimension"]).agg(F.lit(f"{high}-{low}").alias("contrast"), F.count("*").alias("n_pairs"), six(F.avg(F.col("a") - F.col("b"))).alias("mean_diff"))
        out = one if out is None else out.unionByName(one)
    return out


#: Poisson weights beyond this one are as rare as one draw in ten million.
MOST_WEIGHT = 10
HASHES = 1 << 32


def poisson_bounds(most: int = MOST_WEIGHT) -> list[int]:
    """Of a hash below 2^32: where the weight of a Poisson distribution of mean 1 becomes 1, 2, ..."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * HASHES))
    return out


def poisson(u: Column) -> Column:
    """The weight that a hash below 2^32 stands for: any engine and any task makes the same."""
    return sum(((u >= b).cast("int") for b in poisson_bounds()), F.lit(0))


def paired_bootstrap(scores: DataFrame, contrasts: tuple[tuple[str, str], ...] = CONTRASTS, cluster: str = "doc_id", draws: int = CONFIG.bootstrap_draws, seed: int = CONFIG.seed) -> DataFrame:
    """Of each contrast of arms (arm, doc_id, dimension, score): clusters, pairs, mean difference, 95 % interval, p value and, over all
    contrasts, the adjusted one.

    Pairs are summed by cluster, a column a contrast. Each cluster then gets a Poisson weight a draw and goes into the draws' sums where it lies: partial
    aggregates of draws, no numbering of clusters and no table of draws. The p value is twice the smaller share of draws on one side of zero.

    Defined cases: repeated scores are averaged; pairs that lack an arm don't count; a contrast without pairs has no row; draws of weight zero alone are left out.
    """
    names = sorted({a for pair in contrasts for a in pair})
    keys = list(dict.fromkeys([cluster, "doc_id", "dimension"]))
    wide = scores.groupBy(*keys).pivot("arm", names).agg(F.avg("score"))
    diff = [F.col(a) - F.col(b) for a, b in contrasts]
    sums = wide.groupBy(F.col(cluster).alias("cluster")).agg(*[x for j, d in enumerate(diff) for x in (F.coalesce(F.sum(d), F.lit(0.0)).alias(f"s{j}"), F.count(d).alias(f"c{j}"))])
    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i")).withColumn("u", draw(F.col("i"), F.col("cluster"), F.lit(HASHES), seed)).withColumn("w", poisson(F.col("u")))
    made = drawn.groupBy("i").agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for j in range(len(contrasts)) for x in (f"s{j}", f"c{j}")])
    each = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.col(f"s{j}").alias("s"), F.col(f"c{j}").alias("c")) for j, (a, b) in enumerate(contrasts)])
    means = made.select(F.explode(each).alias("x")).select("x.*").where("c > 0").withColumn("m", F.col("s") / F.col("c"))
    low, high = (F.count_if(F.col("m") <= 1e-12) + 1) / (F.count("*") + 1), (F.count_if(F.col("m") >= -1e-12) + 1) / (F.count("*") + 1)
    told = means.groupBy("contrast").agg(six(F.percentile("m", 0.025)).alias("low"), six(F.percentile("m", 0.975)).alias("high"), six(F.least(F.lit(1.0), 2 * F.least(low, high))).alias("p_value"))
    whole = sums.select(F.explode(each).alias("x")).select("x.*").where("c > 0").groupBy("contrast").agg(F.count("*").alias("n_clusters"), F.sum("c").alias("n_pairs"), six(F.sum("s") / F.sum("c")).alias("mean_diff"))
    adjusted = holm(told.select(F.col("contrast").alias("name"), "p_value")).select(F.col("name").alias("contrast"), "adjusted")  # a row a contrast
    return whole.join(told, "contrast").join(adjusted, "contrast")


def metric_breakdown(scores: DataFrame, value: str = "score") -> DataFrame:
    """Mean by document, by dimension and over all, in one pass."""
    return scores.groupingSets([["doc_id"], ["dimension"], []], "doc_id", "dimension").agg(F.count("*").alias("n"), six(F.avg(value)).alias("mean"))


def revision_kinds(first: DataFrame, final: DataFrame) -> DataFrame:
    """Revised records by what changed: the primary label, or evidence and secondary labels only."""
    a = first.select("doc_id", "dimension", F.col("label").alias("l1"), F.col("evidence_ids").alias("e1"))
    b = final.select("doc_id", "dimension", F.col("label").alias("l2"), F.col("evidence_ids").alias("e2"))
    kind = F.when(~F.col("l1").eqNullSafe(F.col("l2")), "primary_label").when(~F.array_sort("e1").eqNullSafe(F.array_sort("e2")), "evidence").otherwise("unchanged")
    return a.join(b, ["doc_id", "dimension"]).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def label_matrix(records: DataFrame, dimensions: tuple[str, ...] = CONFIG.dimensions) -> DataFrame:
    return records.groupBy("doc_id").pivot("dimension", list(dimensions)).agg(F.max("label"))


def label_freq(records: DataFrame) -> DataFrame:
    return records.groupBy("dimension", "label").agg(F.count("*").alias("n"))


def corpus_cube(docs: DataFrame) -> DataFrame:
    return docs.cube("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# Normal quantiles of 0.975 and of 0.8.
TWO_SIDED_95, POWER_80 = 1.959964, 0.841621


def sample_size(groups: DataFrame, effect: float, rho: float) -> DataFrame:
    """Documents an arm needs in each group (prevalence, cluster_size) to show a difference of ``effect`` between two shares, at 5 %
    two-sided and a power of 80 %, when rows of a cluster correlate by ``rho``."""
    p = F.col("prevalence")
    alone = (TWO_SIDED_95 + POWER_80) ** 2 * 2 * p * (1 - p) / effect**2
    return groups.withColumn("design_effect", six(1 + (F.col("cluster_size") - 1) * rho)).withColumn("n_needed", F.ceil(F.round(alone * (1 + (F.col("cluster_size") - 1) * rho), 6)).cast("long"))


def facet_calibration(scores: DataFrame, human: DataFrame, facets: tuple[str, ...] = ("context_relevance", "faithfulness", "answer_relevance"), key: str = "doc_id") -> DataFrame:
    """Each facet beside a person's score (key, human) on the rows that one has seen: never one number for all facets."""
    both = scores.join(human, key)
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("score")) for f in facets])).alias("f"), "human").select("f.*", "human")
    return rows.groupBy("facet").agg(F.count("*").alias("n"), six(F.avg("score")).alias("mean_score"), six(F.avg("human")).alias("mean_human"), six(F.avg(F.abs(F.col("score") - F.col("human")))).alias("mean_abs_diff"), F.round(F.corr("score", "human"), 4).alias("correlation"))
