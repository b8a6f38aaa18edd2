"""Scores of schema alignment and retrieval: coverage, rank metrics, precision, agreement, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspar.runtime import cut

# Judgements, and which of them count in each mode.
JUDGEMENTS = ("Equivalent", "Narrower", "Broader", "Unrelated")
MODES = {"exact": ("Equivalent",), "compat": ("Equivalent", "Narrower"), "gen": ("Equivalent", "Narrower", "Broader")}


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean; 0 without weight."""
    total = F.sum(weight)
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.sum(value * weight) / total).otherwise(0.0)


def good(mode: str) -> Column:
    return F.coalesce(F.col("usable"), F.lit(False)) & F.col("judgement").isin(*MODES[mode])


def per_anchor(judgements: DataFrame) -> DataFrame:
    """For each reference label: whether it is covered in each mode, and the first rank that covers it.

    judgements: ref_label, item_label, judgement, usable, rank.
    """
    out = [F.count("*").alias("candidates")]
    for mode in MODES:
        out += [F.max(F.when(good(mode), 1).otherwise(0)).alias(f"covered_{mode}"), F.min(F.when(good(mode), F.col("rank"))).alias(f"first_rank_{mode}")]
    return judgements.groupBy("ref_label").agg(*out)


def coverage(anchors: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """One row for each mode: weighted coverage, hits and reciprocal rank within k; and, in mode compat, the refinement rate.

    weights: ref_label, weight. Anchors that weren't judged count as not covered; weights of 0 don't count.
    """
    rows = weights.filter("weight > 0").join(anchors, "ref_label", "left")
    w = F.col("weight")
    parts = []
    for mode in MODES:
        rank = F.col(f"first_rank_{mode}")
        within = F.coalesce(rank <= k, F.lit(False))
        refined = F.when((F.col("covered_compat") == 1) & (F.col("covered_exact") == 0), 1.0).otherwise(0.0)
        parts.append(rows.agg(
            F.lit(mode).alias("mode"), weighted(F.coalesce(F.col(f"covered_{mode}"), F.lit(0)), w).alias("coverage"), weighted(F.when(within, 1.0).otherwise(0.0), w).alias("hits"),
            weighted(F.when(within & (rank > 0), 1.0 / rank).otherwise(0.0), w).alias("mrr"), (weighted(refined, w) if mode == "compat" else F.lit(None).cast("double")).alias("refinement"),
        ))
    return reduce(DataFrame.unionByName, parts)


def match_quality(scores: DataFrame) -> DataFrame:
    """Coverage by mode as shares that sum to 1: equivalent, narrower, broader, missed."""
    c = scores.agg(*(F.max(F.when(F.col("mode") == m, F.col("coverage"))).alias(m) for m in MODES))
    return c.select(F.col("exact").alias("equivalent"), (F.col("compat") - F.col("exact")).alias("narrower"), (F.col("gen") - F.col("compat")).alias("broader"), (1 - F.col("gen")).alias("missed"))


def precision(judgements: DataFrame, weights: DataFrame) -> DataFrame:
    """(mode, precision): the share of candidates of active anchors that are good; null without any."""
    pool = judgements.join(weights.filter("weight > 0").select("ref_label").distinct(), "ref_label", "left_semi")
    return reduce(DataFrame.unionByName, (pool.agg(F.lit(m).alias("mode"), F.avg(F.when(good(m), 1.0).otherwise(0.0)).alias("precision")) for m in MODES))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """(score, n, tp, precision, recall) at each distinct score, falling. pairs: score, positive (0 or 1).

    Scores are aggregated first; the running sums are over ranges of scores and their totals, not one sorted task.
    """
    each = pairs.groupBy("score").agg(F.sum("positive").alias("p"), F.count("*").alias("n"))
    # ranges of falling scores; a running sum within each, and what all higher ranges have in all
    spread = cut(each.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))  # written once: ranges must not change between its uses
    totals = spread.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    own = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = spread.withColumns({"tp": F.sum("p").over(own), "seen": F.sum("n").over(own), "all": spread.agg(F.sum("p")).scalar()}).join(F.broadcast(before), "part")
    tp, seen = F.col("tp") + F.col("p0"), F.col("seen") + F.col("n0")
    return run.select("score", "p", seen.alias("n"), tp.alias("tp"), (tp / seen).alias("precision"), F.when(F.col("all") > 0, tp / F.col("all")).alias("recall"), "all")


def average_precision(pairs: DataFrame) -> DataFrame:
    """(ap, n): null without a positive pair."""
    curve = precision_recall(pairs)
    return curve.agg(F.sum(F.when(F.col("all") > 0, F.col("p") / F.col("all") * F.col("precision"))).alias("ap"), F.max("n").alias("n"))


def judge_statistics(judgements: DataFrame) -> DataFrame:
    """Counts of judgements, and confidences: least, upper middle, nine tenths, greatest; one row."""
    shares = [F.sum(F.when(F.col("judgement") == j, 1).otherwise(0)).alias(j.lower()) for j in JUDGEMENTS]
    # ranks among distinct confidences with their counts, summed up by ranges: no list of all values is gathered
    curve = cut(precision_recall(judgements.filter("confidence is not null").select(F.col("confidence").alias("score"), F.lit(0).alias("positive"))))
    total = curve.agg(F.max("n")).scalar()
    # n counts from the highest down: a value stands before all that are lower
    below = total - F.col("n")
    at = curve.select(F.col("score").alias("confidence"), below.alias("below"), F.floor(total / 2).alias("middle"), F.floor(0.9 * (total - 1)).alias("ninth"))
    picked = at.agg(F.min("confidence").alias("confidence_min"), F.max(F.when(F.col("below") <= F.col("middle"), F.col("confidence"))).alias("confidence_p50"), F.max(F.when(F.col("below") <= F.col("ninth"), F.col("confidence"))).alias("confidence_p90"), F.max("confidence").alias("confidence_max"))
    return judgements.agg(F.count("*").alias("n"), *shares).join(F.broadcast(picked))


def refinement_kinds(judgements: DataFrame) -> DataFrame:
    """Covered anchors by what covers them: only equivalents, narrower ones too, broader ones too, both; one row."""
    has = lambda j: F.max(F.when((F.col("judgement") == j) & F.col("usable"), 1).otherwise(0))
    each = judgements.groupBy("ref_label").agg(has("Equivalent").alias("e"), has("Narrower").alias("n"), has("Broader").alias("b"))
    count = lambda c, name: F.sum(F.when(F.expr(c), 1).otherwise(0)).alias(name)
    return each.agg(count("e = 1 and n = 0 and b = 0", "only_equivalent"), count("n = 1 and b = 0", "narrower"), count("b = 1 and n = 0", "broader"), count("n = 1 and b = 1", "mixed"))


def match_tiers(anchors: DataFrame, weights: DataFrame) -> DataFrame:
    """(ref_label, tier): the best way in which each anchor is matched."""
    tier = F.when(F.col("covered_exact") == 1, "Equivalent").when(F.col("covered_compat") == 1, "Narrower").when(F.col("covered_gen") == 1, "Broader").otherwise("-")
    return weights.select("ref_label", (F.col("weight") > 0).alias("active")).join(anchors, "ref_label", "left").select("ref_label", "active", tier.alias("tier"))


def predicate_weights(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """(split, label, kind, weight): how often each reference predicate occurs, and each concept as its domain or range, by split and over ``all``.

    triples: split, predicate; predicates: label, domain, range. A triple of split ``all`` counts twice in ``all``.
    """
    rows = triples.select(F.explode(F.array("split", F.lit("all"))).alias("split"), F.col("predicate").alias("label")).groupBy("split", "label").agg(F.count("*").alias("n"))
    active = rows.join(predicates, "label")
    concepts = active.select("split", F.explode(F.array("domain", "range")).alias("label"), "n").filter("label is not null and label <> ''").groupBy("split", "label").agg(F.sum("n").alias("weight"))
    return active.select("split", "label", F.lit("relation").alias("kind"), F.col("n").alias("weight")).unionByName(concepts.select("split", "label", F.lit("concept").alias("kind"), "weight"))


def best_concepts(judgements: DataFrame) -> DataFrame:
    """(item_label, ref_label): the usable reference concept of best judgement, then confidence, then label."""
    order = F.when(F.col("judgement") == "Equivalent", 3).when(F.col("judgement") == "Narrower", 2).when(F.col("judgement") == "Broader", 1)
    rows = judgements.filter(F.col("usable") & (F.col("judgement") != "Unrelated"))
    return rows.groupBy("item_label").agg(F.min(F.struct((-order).alias("p"), (-F.col("confidence")).alias("c"), "ref_label"))["ref_label"].alias("ref_label"))


def direction_relaxed(chosen: DataFrame, expected: DataFrame, mapped: DataFrame) -> DataFrame:
    """(label, same, inverse, any): whether the classes found at a relation's ends fit its domain and range, in either direction.

    chosen: label, domains array, ranges array; expected: label, domain, range; mapped: item_label, ref_label (any
    strategy). A class also fits a concept whose words are all among its own. Empty expectations fit.
    """
    rows = chosen.join(expected, "label").filter("coalesce(domain, '') <> '' or coalesce(range, '') <> ''")
    found = rows.select("label", "domain", "range", F.explode(F.array(F.struct(F.lit("d").alias("side"), F.col("domains").alias("v")), F.struct(F.lit("r").alias("side"), F.col("ranges").alias("v")))).alias("x")).select("label", "domain", "range", "x.side", F.explode("x.v").alias("item_label"))
    targets = found.select("label", "side", "item_label", F.explode(F.array(F.struct(F.lit("d").alias("of"), F.col("domain").alias("ref_label")), F.struct(F.lit("r").alias("of"), F.col("range").alias("ref_label")))).alias("t")).select("label", "side", "item_label", "t.*")
    by_map = mapped.select("item_label", "ref_label").distinct().withColumn("known", F.lit(True))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
    within = (F.size(words(F.col("ref_label"))) > 0) & (F.size(F.array_except(words(F.col("ref_label")), words(F.col("item_label")))) == 0)
    fits = targets.join(by_map, ["item_label", "ref_label"], "left").withColumn("ok", F.coalesce("known", F.lit(False)) | F.coalesce(within, F.lit(False)))
    has = lambda side, of: F.coalesce(F.max(F.when((F.col("side") == side) & (F.col("of") == of) & F.col("ok"), 1)), F.lit(0))
    each = fits.groupBy("label").agg(*(has(s, o).alias(f"{s}{o}") for s in "dr" for o in "dr"))
    free = lambda c, side: (F.coalesce(c, F.lit(0)) == 1) | (F.coalesce(side, F.lit("")) == "")
    out = rows.join(each, "label", "left").select("label", (free(F.col("dd"), F.col("domain")) & free(F.col("rr"), F.col("range"))).alias("same"), (free(F.col("dr"), F.col("range")) & free(F.col("rd"), F.col("domain"))).alias("inverse"))
    return out.withColumn("any", F.col("same") | F.col("inverse"))


def method_statistics(rows: DataFrame, method: str, metrics: list[str]) -> DataFrame:
    """(method, metric, n, mean, std): nulls don't count; std of one value is 0."""
    long = rows.select(method, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(method, "x.*")
    return long.groupBy(method, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.when(F.count("value") > 0, F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"))


def shown(mean: Column, std: Column, digits: int = 3) -> Column:
    """``m ± s`` as tables show it, a dash where there is no value."""
    return F.when(mean.isNull(), "—").otherwise(F.format_string(f"%.{digits}f ± %.{digits}f", mean, F.coalesce(std, F.lit(0.0))))


def report_table(statistics: DataFrame, method: str, metrics: tuple[str, ...]) -> DataFrame:
    """(method, cells, latex): a row for each method with ``m ± s`` of each metric in the order given, also as a row of LaTeX."""
    cells = statistics.groupBy(method).agg(*(F.max(F.when(F.col("metric") == m, shown(F.col("mean"), F.col("std")))).alias(m) for m in metrics))
    rows = cells.select(method, F.array(*(F.coalesce(m, F.lit("—")) for m in metrics)).alias("cells"))
    name = F.regexp_replace(F.coalesce(method, F.lit("")), r"([_&%#])", r"\\$1")
    return rows.withColumn("latex", F.concat(F.concat_ws(" & ", name, *(F.replace(F.get("cells", F.lit(n)), F.lit("±"), F.lit("$\\pm$")) for n in range(len(metrics)))), F.lit(" \\\\")))


def rank_methods(statistics: DataFrame, method: str, lower_is_better: tuple[str, ...] = (), near_one: tuple[str, ...] = ()) -> DataFrame:
    """Rank of each method by mean in each metric, 1 the best; ties go by name. Also the mean scaled to 0..1 within the metric."""
    value = F.when(F.col("metric").isin(*near_one), F.abs(F.col("mean") - 1)).when(F.col("metric").isin(*lower_is_better), F.col("mean")).otherwise(-F.col("mean"))
    rows = statistics.withColumn("goal", value)
    w = Window.partitionBy("metric")
    span = F.max("goal").over(w) - F.min("goal").over(w)
    return rows.withColumns({"rank": F.row_number().over(w.orderBy("goal", method)), "scaled": F.when(span == 0, 1.0).otherwise((F.max("goal").over(w) - F.col("goal")) / span)}).drop("goal")


def composite(rows: DataFrame) -> DataFrame:
    """Composite scores from accuracy, connectivity, leakage, avg_degree and clustering."""
    a, c, leak = F.col("accuracy"), F.col("connectivity"), F.col("leakage")
    return rows.withColumns({"egu": a * c * (1 - leak), "rwa": a * c, "sci": F.col("avg_degree") * F.col("clustering") * c, "genuine": a * c * (1 - leak), "leaked": a * leak, "fragmented": a * (1 - leak) * (1 - c)})
