"""Evaluation: correctness, summaries, intervals, calibration and ranking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.stage import staged

#: Two-sided quantiles of the normal distribution.
NORMAL = {0.90: 1.6449, 0.95: 1.9600, 0.99: 2.5758}
#: 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
STUDENT = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def exact(answers: Column, gold: Column) -> Column:
    return F.array_sort(F.array_distinct(answers)) == F.array_sort(F.array_distinct(gold))


def contains_gold(answers: Column, gold: Column) -> Column:
    return (F.size(gold) > 0) & (F.size(F.array_except(gold, answers)) == 0)


def summary(records: DataFrame) -> DataFrame:
    """One row of records(tier, correct, cost, latency_ms): n, totals, means, and the count of each tier 0 to 3."""
    tiers = [F.count(F.when(F.col("tier") == t, 1)).alias(f"tier{t}") for t in range(4)]
    return records.agg(F.count("*").alias("n"), F.sum("cost").alias("total_cost"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("latency_ms").alias("avg_latency_ms"), *tiers)


def running_sum(rows: DataFrame, value: str, order: str, key: str | None, name: str, before: bool = False, width: int = 10_000) -> DataFrame:
    """rows with name, the sum of value up to the row in the order of a numeric column, that row left out with before.

    Rows are summed in blocks of width of the order column first, so that no
    key, nor the whole log where none is given, is sorted in one task; the blocks
    of a key are few.
    """
    keys = [key] if key else []
    block = F.floor(F.col(order) / width)
    sums = rows.groupBy(*keys, block.alias("_b")).agg(F.sum(value).alias("_s"))
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows.withColumn("_b", block).withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)


def running_cost(records: DataFrame, key: str | None = None) -> DataFrame:
    """records with cost_so_far in order of idx, within key; rows of equal idx are added one after the other."""
    return running_sum(records, "cost", "idx", key, "cost_so_far")


def by_class(records: DataFrame, key: str = "relation") -> DataFrame:
    """(key, n, cost, accuracy) of records(key, cost, correct)."""
    return records.groupBy(key).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def block_means(records: DataFrame, width: int = 50) -> DataFrame:
    return records.groupBy(F.floor(F.col("idx") / width).alias("block")).agg(F.round(F.avg("cost"), 5).alias("mean_cost"))


def percentiles(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, p50, p95, p99, mean): p50 interpolated; p95 and p99 the element at min(n - 1, floor(q n)) of the sorted values.

    Equal values are counted first, and ranks come from ranges of values, so that
    no key is sorted or held in one task.  Nulls are left out.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    upto = running_ranks(counts, keys)
    placed = upto.join(n, keys) if keys else upto.crossJoin(n)
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))
    pick = lambda k: F.max(F.when((F.col("_from") <= k) & (k < F.col("_from") + F.col("_c")), F.col("_v")))
    half = (pick(F.floor((F.col("n") - 1) / 2)) + pick(F.floor(F.col("n") / 2))) / 2
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), half.alias("p50"), pick(at(0.95)).alias("p95"), pick(at(0.99)).alias("p99"), F.max("mean").alias("mean"))


def running_ranks(counts: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """counts(keys, _v, _c) with _from, the rows of the key with a smaller value: in ranges of values cut at quantiles, never a key in one task."""
    cuts = counts.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000))).alias("_cuts"))
    c = counts.join(cuts, keys) if keys else counts.crossJoin(cuts)
    c = c.withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    sums = c.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("_own", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(sums, [*keys, "_b"]).withColumn("_from", F.col("_before") + F.col("_own"))


def t_summary(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, sd, half_width): the 95 % interval of the mean; 0 wide for a single row."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    t = F.coalesce(F.get(F.array(*[F.lit(x) for x in STUDENT]), F.col("n").cast("int") - 2), F.lit(NORMAL[0.95]))
    return out.withColumn("half_width", F.when(F.col("n") < 2, 0.0).otherwise(t * F.col("sd") / F.sqrt("n")))


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Score interval of k in n, inside [0, 1]; (0, 0) without trials."""
    z = NORMAL[level]
    p, d = k / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0))
    mid, wide = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    clip = lambda x: F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return clip((mid - wide) / d), clip((mid + wide) / d)


def bootstrap(values: DataFrame, draws: int = 1000, seed: str = "12345", level: float = 0.95) -> DataFrame:
    """One row (mean, low, high): percentiles of means of draws with replacement, picked by hashes.

    values(i, v) with i from 0 to n - 1.  Draws are draws * n rows that meet the
    values by an equi-join; nulls without values.
    """
    n = values.count()
    grid = values.sparkSession.range(draws * n).select(F.floor(F.col("id") / max(n, 1)).alias("d"), (F.col("id") % max(n, 1)).alias("j"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "d", "j")), 1, 8), 16, 10).cast("long")
    means = grid.withColumn("i", F.pmod(u, F.lit(max(n, 1)))).join(values, "i").groupBy("d").agg(F.avg("v").alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return values.agg(F.avg("v").alias("mean")).crossJoin(ends)  # a row each


#: Poisson(1): the chance of at most 0, 1, 2, ... times.
POISSON = tuple(sum(1 / math.factorial(j) for j in range(k + 1)) / math.e for k in range(12))


def poisson_bootstrap(values: DataFrame, draws: int = 1000, seed: str = "12345", level: float = 0.95) -> DataFrame:
    """One row (mean, low, high) of values(i, v): as bootstrap, with each value taken a Poisson(1) number of times in each draw, by a hash of draw and i.

    One pass: a row gives its share to every draw, and shares are added up
    before the shuffle, which moves one row a draw and task.  No row meets
    another, and the number of values need not be known.
    """
    each = values.select("i", "v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "d", "i")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = reduce(Column.__add__, [(u >= x).cast("int") for x in POISSON])
    sums = each.withColumn("w", times).groupBy("d").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w")).filter("w > 0")
    tail = (1 - level) / 2
    ends = sums.select((F.col("s") / F.col("w")).alias("m")).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return values.agg(F.avg("v").alias("mean")).crossJoin(ends)  # a row each


def crossing(points: DataFrame, level: float, keys: list[str]) -> DataFrame:
    """(keys, x): where y, going by x, first meets level, by linear interpolation; null if it doesn't."""
    w = Window.partitionBy(*keys).orderBy("x")
    nxt = points.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
    hit = (F.col("y") - level) * (F.col("y2") - level) <= 0
    at = F.when(F.col("y") == F.col("y2"), F.col("x")).otherwise(F.col("x") + (level - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x")))
    return nxt.groupBy(*keys).agg(F.min(F.when(hit, at)).alias("x"))


def micro_f1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict accuracy and micro precision, recall and F1 of rows(verdict, gold_verdict, articles, gold_articles)."""
    hit = F.sum(F.size(F.array_intersect("articles", "gold_articles")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("verdict") == F.col("gold_verdict")).cast("double")).alias("accuracy"), hit.alias("hit"), F.sum(F.size(F.array_distinct("articles"))).alias("said"), F.sum(F.size(F.array_distinct("gold_articles"))).alias("gold"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", share(F.col("hit"), F.col("said"))).withColumn("recall", share(F.col("hit"), F.col("gold")))
    return out.withColumn("f1", share(2 * F.col("hit"), F.col("said") + F.col("gold")))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row (n, ece) of rows(p, label): bins are (lo, hi], the first one closed at both ends."""
    b = F.greatest(F.lit(1), F.ceil(F.col("p") * bins)).alias("bin")
    each = rows.groupBy(b).agg(F.count("*").alias("k"), F.avg("p").alias("conf"), F.avg(F.col("label").cast("double")).alias("acc"))
    return each.agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("k")).alias("ece"))


def filtered_ranks(scores: DataFrame, gold: DataFrame, known: DataFrame | Column) -> DataFrame:
    """gold(q, tail) with rank among scores(q, tail, score): 1 + strictly better tails that aren't known(q, tail) answers of the query.

    known may be a condition on q and tail instead of a table; then scores are
    read twice, and neither staged nor dealt out.
    """
    own = gold.join(scores, ["q", "tail"]).select("q", "tail", F.col("score").alias("gold_score"))
    if isinstance(known, Column):
        own, unknown = staged(own), scores.filter(~F.coalesce(known, F.lit(False)))
    else:
        unknown = scores.join(known.select("q", "tail").distinct(), ["q", "tail"], "left_anti")
    rest = unknown.select("q", F.col("tail").alias("other"), "score")
    better = own.join(rest, "q").filter((F.col("score") > F.col("gold_score")) & (F.col("other") != F.col("tail"))).groupBy("q", "tail").agg(F.count("*").alias("better"))
    return own.join(better, ["q", "tail"], "left").select("q", "tail", (F.coalesce("better", F.lit(0)) + 1).alias("rank"))


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """One row: n, mrr and hits at 1, 3 and 10; zeros without ranks."""
    hits = [F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"hits{k}") for k in (1, 3, 10)]
    return ranks.agg(F.count("*").alias("n"), F.coalesce(F.avg(1 / F.col("rank")), F.lit(0.0)).alias("mrr"), *hits)


def closed_world(questions: DataFrame, closed: DataFrame) -> DataFrame:
    """One row of questions(theory, src, rel, dst, positive, answer) against closed(theory, ...): n, accuracy and the majority's share.

    A positive question holds if it is derivable, a negative one if it isn't.
    """
    derived = closed.select("theory", "src", "rel", "dst").distinct().withColumn("_d", F.lit(True))
    q = questions.join(derived, ["theory", "src", "rel", "dst"], "left").withColumn("said", F.coalesce("_d", F.lit(False)) == F.col("positive"))
    yes = F.avg(F.col("answer").cast("double"))
    return q.agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("answer")).cast("double")).alias("accuracy"), F.greatest(yes, 1 - yes).alias("majority"))


def proof_metrics(workload_answers: DataFrame, checked: DataFrame) -> DataFrame:
    """One row (asked, answered, coverage, validity): validity is the grounded share of answered tails."""
    tails = workload_answers.select(F.col("head").alias("src"), F.col("relation").alias("rel"), F.explode("answers").alias("dst")).distinct()
    valid = tails.join(checked.select("src", "rel", "dst", "grounded"), ["src", "rel", "dst"]).agg(F.avg(F.col("grounded").cast("double")).alias("validity"))
    n = workload_answers.agg(F.count("*").alias("asked"), F.count(F.when(F.col("answered"), 1)).alias("answered"))
    return n.crossJoin(valid).select("asked", "answered", (F.col("answered") / F.nullif("asked", F.lit(0))).alias("coverage"), "validity")


def repeat_profile(stream: DataFrame, key: str) -> DataFrame:
    """One row of stream(idx, key, label): repeat rate, distinct patterns, singletons, and the share that the majority label of each pattern gets right."""
    per = stream.groupBy(key, "label").count().groupBy(key).agg(F.sum("count").alias("n"), F.max("count").alias("top"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("patterns"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), (1 - F.count("*") / F.sum("n")).alias("repeat_rate"), (F.sum("top") / F.sum("n")).alias("majority_ceiling"))


def mean_trajectories(runs: DataFrame, key: str = "system") -> DataFrame:
    """(key, pos, mean) of runs(key, run, trajectory), as far as the shortest run of the key goes."""
    shortest = runs.groupBy(key).agg(F.min(F.size("trajectory")).alias("least"))
    each = runs.select(key, F.posexplode("trajectory").alias("pos", "v")).join(shortest, key).filter("pos < least")
    return each.groupBy(key, "pos").agg(F.avg("v").alias("mean"))


def tier_shares(records: DataFrame) -> DataFrame:
    """(system, tier, share): mean over runs of each run's share."""
    per = records.groupBy("system", "run", "tier").count()
    n = records.groupBy("system", "run").agg(F.count("*").alias("n"))
    runs = n.groupBy("system").agg(F.count("*").alias("runs"))
    return per.join(n, ["system", "run"]).groupBy("system", "tier").agg(F.sum(F.col("count") / F.col("n")).alias("s")).join(runs, "system").select("system", "tier", (F.col("s") / F.col("runs")).alias("share"))


def reconcile(stored: DataFrame, counted: DataFrame, key: list[str], value: str) -> DataFrame:
    """Cells where the stored and the recounted value differ or one is missing."""
    a, b = stored.select(*key, F.col(value).alias("stored")), counted.select(*key, F.col(value).alias("counted"))
    return a.join(b, key, "full").filter(~F.col("stored").eqNullSafe(F.col("counted")))


def verdict(percent_saved: Column) -> Column:
    """reduces from 20 %, neutral from 0, else costs; none without data."""
    return F.when(percent_saved.isNull(), "none").when(percent_saved >= 20, "reduces").when(percent_saved >= 0, "neutral").otherwise("costs")


def cell_valid(accuracy_delta: Column, tolerance: float = 0.02) -> Column:
    """Whether an arm's accuracy is at most the tolerance under the base's; null without a figure."""
    return accuracy_delta >= -tolerance


def error_rates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_seeds, mean_saved, n_installed, p_installed, low, high, mean_accuracy_delta, n_invalid, verdict) of sweep cells.

    cells(keys, seed, calls_saved_pct, rule_installed, accuracy_delta,
    cell_valid); low and high are the score interval of the share of cells that
    installed a rule.  Means leave nulls out.
    """
    k = F.sum(F.col("rule_installed").cast("long"))
    out = cells.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"),
        F.avg("calls_saved_pct").alias("mean_saved"),
        k.alias("n_installed"),
        F.avg("accuracy_delta").alias("mean_accuracy_delta"),
        F.count(F.when(~F.col("cell_valid"), 1)).alias("n_invalid"),
    )
    low, high = wilson(F.col("n_installed").cast("double"), F.col("n_seeds").cast("double"))
    return out.withColumn("p_installed", F.col("n_installed") / F.col("n_seeds")).withColumn("low", low).withColumn("high", high).withColumn("verdict", verdict(F.col("mean_saved")))


def oracle_cells(cells: DataFrame) -> DataFrame:
    """(gamma, error_rate, n_seeds, arm_accuracy, sub_gold_accuracy, p_install, low, high, mean_saved, mean_precision, n_invalid)."""
    out = cells.groupBy("gamma", "error_rate").agg(
        F.count("*").alias("n_seeds"),
        F.avg("cache_accuracy").alias("arm_accuracy"),
        F.avg("teacher_answer_accuracy").alias("sub_gold_accuracy"),
        F.sum((F.size(F.coalesce("synthesised_rules", F.array().cast("array<string>"))) > 0).cast("long")).alias("_k"),
        F.avg("calls_saved_pct").alias("mean_saved"),
        F.avg("rule_world_precision").alias("mean_precision"),
        F.count(F.when(~F.col("cell_valid"), 1)).alias("n_invalid"),
    )
    low, high = wilson(F.col("_k").cast("double"), F.col("n_seeds").cast("double"))
    return out.select("gamma", "error_rate", "n_seeds", "arm_accuracy", "sub_gold_accuracy", (F.col("_k") / F.col("n_seeds")).alias("p_install"), low.alias("low"), high.alias("high"), "mean_saved", "mean_precision", "n_invalid")


def experiments(runs: DataFrame) -> DataFrame:
    """(experiment, name, value, n, mean, sd, half_width) of runs(experiment, system, tag, total_cost, accuracy, avg_latency_ms).

    E1 goes by system and has the latency too, E3 and E4 by tag, E5 and E6 by
    system and tag.
    """
    e = F.col("experiment")
    name = F.when(e == "E1", F.col("system")).when(e.isin("E3", "E4"), F.col("tag")).when(e.isin("E5", "E6"), F.concat_ws("|", "system", "tag"))
    values = F.array(*[F.struct(F.lit(v).alias("value"), F.col(c).alias("x")) for v, c in (("cost", "total_cost"), ("accuracy", "accuracy"), ("latency_ms", "avg_latency_ms"))])
    each = runs.filter(name.isNotNull()).select("experiment", name.alias("name"), F.explode(values).alias("v")).select("experiment", "name", "v.value", "v.x").filter((F.col("value") != "latency_ms") | (F.col("experiment") == "E1"))
    return t_summary(each, "x", ["experiment", "name", "value"])


def main_table(summary_: DataFrame, shares: DataFrame) -> DataFrame:
    """(system, cost, half_width, accuracy, latency_ms, percent_without_llm) from experiments and tier_shares: the share of tiers 1 and 2."""
    e1 = summary_.filter("experiment = 'E1'")
    pick = lambda v, c: F.max(F.when(F.col("value") == v, F.col(c)))
    rows = e1.groupBy(F.col("name").alias("system")).agg(pick("cost", "mean").alias("cost"), pick("cost", "half_width").alias("half_width"), pick("accuracy", "mean").alias("accuracy"), pick("latency_ms", "mean").alias("latency_ms"))
    free = shares.filter(F.col("tier").isin(1, 2)).groupBy("system").agg((100 * F.sum("share")).alias("percent_without_llm"))
    return rows.join(free, "system", "left").fillna({"percent_without_llm": 0.0})


def ablation_table(summary_: DataFrame, order: list[str]) -> DataFrame:
    """(place, tag, cost, accuracy) of E4 in a fixed order; tags that weren't run are left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("name"))
    pick = lambda v: F.max(F.when(F.col("value") == v, F.col("mean")))
    return summary_.filter("experiment = 'E4'").groupBy(place.alias("place"), F.col("name").alias("tag")).agg(pick("cost").alias("cost"), pick("accuracy").alias("accuracy")).filter("place > 0")


def teacher_matrix(runs: DataFrame, base: str = "llm_only") -> DataFrame:
    """(teacher, arm, n, factor_mean, factor_sd, accuracy, f1) of runs(teacher, seed, arm, cost, accuracy, f1): factor is what the base arm of the same seed costs over the arm."""
    b = runs.filter(F.col("arm") == base).select("teacher", "seed", F.col("cost").alias("_base"))
    each = runs.join(b, ["teacher", "seed"], "left").withColumn("factor", F.col("_base") / F.nullif("cost", F.lit(0.0)))
    return each.groupBy("teacher", "arm").agg(F.count("*").alias("n"), F.avg("factor").alias("factor_mean"), F.coalesce(F.stddev_samp("factor"), F.lit(0.0)).alias("factor_sd"), F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))


def matrix_totals(runs: DataFrame) -> DataFrame:
    """One row (distinct_patterns, spend) of runs(distinct_patterns, spend): the rounded mean and the sum."""
    return runs.agg(F.round(F.avg("distinct_patterns")).cast("long").alias("distinct_patterns"), F.sum("spend").alias("spend"))


def sweep(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, seed, cache_calls, full_calls, calls_saved_pct, cache_accuracy, full_accuracy, accuracy_delta, cell_valid) of outcomes(keys, seed, arm, tier, correct).

    arm is cache or full; calls are those of tier 3; 0 % saved where the cache
    arm made none.
    """
    arm = lambda a, x: F.when(F.col("arm") == a, x)
    calls = lambda a: F.count(arm(a, F.when(F.col("tier") == 3, 1)))
    right = lambda a: F.avg(arm(a, F.col("correct").cast("double")))
    out = outcomes.groupBy(*keys, "seed").agg(calls("cache").alias("cache_calls"), calls("full").alias("full_calls"), right("cache").alias("cache_accuracy"), right("full").alias("full_accuracy"))
    out = out.withColumn("calls_saved_pct", F.coalesce(100 * (F.col("cache_calls") - F.col("full_calls")) / F.nullif("cache_calls", F.lit(0)), F.lit(0.0)))
    out = out.withColumn("accuracy_delta", F.col("full_accuracy") - F.col("cache_accuracy"))
    return out.withColumn("cell_valid", cell_valid(F.col("accuracy_delta")))


def teacher_accuracy(said: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (n, accuracy): of the distinct pairs with gold(head, relation, tails) that said(head, relation, answers) has, those with an answer and nothing but gold."""
    g = gold.filter(F.size("tails") > 0)
    each = said.dropDuplicates(["head", "relation"]).join(g, ["head", "relation"])
    ok = (F.size("answers") > 0) & (F.size(F.array_except("answers", "tails")) == 0)
    return each.agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("accuracy"))


def saving(costs: DataFrame, keys: list[str], base: str, arm: str) -> DataFrame:
    """(keys, factor, percent_saved, verdict) of costs(keys, system, cost): base over arm, 0 saved where base is free."""
    both = costs.groupBy(*keys).agg(F.sum(F.when(F.col("system") == base, F.col("cost"))).alias("b"), F.sum(F.when(F.col("system") == arm, F.col("cost"))).alias("a"))
    percent = F.coalesce(100 * (F.col("b") - F.col("a")) / F.nullif("b", F.lit(0)), F.lit(0.0))
    return both.select(*keys, (F.col("b") / F.nullif("a", F.lit(0))).alias("factor"), percent.alias("percent_saved"), verdict(percent).alias("verdict"))


def ab_summary(records: DataFrame) -> DataFrame:
    """(arm, n, cost, accuracy): rows go to arms A and B in turn by idx."""
    arm = F.when(F.col("idx") % 2 == 0, "A").otherwise("B")
    return records.groupBy(arm.alias("arm")).agg(F.count("*").alias("n"), F.avg("cost").alias("cost"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def placed(values: DataFrame, column: str) -> DataFrame:
    """(column, place): the distinct values of a column, null left out, numbered in order; by range partitions, not in one task."""
    from graphloom.plans.stage import staged

    d = values.select(column).filter(F.col(column).isNotNull()).distinct()
    parts = staged(d.repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id()))
    before = parts.groupBy("_p").count().withColumn("_b", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return parts.withColumn("_i", place).join(before, "_p").select(column, (F.col("_b") + F.col("_i")).alias("place"))


def stride_sample(values: DataFrame, column: str, n: int = 200) -> DataFrame:
    """(column, place): n distinct values at equal strides, counted through the values in order."""
    out = placed(values, column)
    step = max(1, values.filter(F.col(column).isNotNull()).select(column).distinct().count() // n)
    return out.filter((F.col("place") % step == 0) & (F.col("place") < step * n))


def parameter_grid(spark, values: dict[str, list]) -> list[dict]:
    """Each combination of parameter values, the plan of a grid of runs."""
    out = None
    for k, xs in values.items():
        one = spark.createDataFrame([(x,) for x in xs], [k])
        out = one if out is None else out.crossJoin(one)
    return [r.asDict() for r in out.orderBy(*values).collect()]
