"""Rule mining: path bodies, a-priori over case atoms, precision and admission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.rules import Rule, join_body
from graphloom.plans.stage import staged


def legs(edges: DataFrame, both: bool = True) -> DataFrame:
    """(rel, inv, a, b): each edge, and with both also backwards."""
    e = edges.select("src", "rel", "dst").distinct()
    ahead = e.select("rel", F.lit(False).alias("inv"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return ahead.union(e.select("rel", F.lit(True), "dst", "src")) if both else ahead


def _signed(rel: str, inv: str) -> Column:
    return F.concat(F.when(F.col(inv), "~").otherwise(""), F.col(rel))


@dataclass(frozen=True)
class Mining:
    min_support: int = 3
    confidence_percent: int = 95
    max_rules: int = 8
    target_in_body: bool = True
    target_self_loop: bool = False


def path_sizes(first: DataFrame, second: DataFrame, k1: list[str], k2: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(k1..., k2..., pairs): distinct (x, y), x = y among them, that first(k1..., x, m) and second(m, k2..., y) connect.

    The pairs are not listed.  Ends x with the same set of middles reach the
    same ends y, so that one of them is followed and counted for all: the rows
    are those of the distinct sets of middles, which a hot middle doesn't
    multiply.  Sets are told apart by their size and two 64-bit hashes.  With
    labels(x, label) there is a row for each label, over its x alone.
    """
    sets, fan, same = _fans(first, second, k1, k2, labels is not None)
    if labels is None:
        return fan.groupBy(*k1, *k2).agg(F.sum(F.col("_xs") * F.col("_ys")).alias("pairs"))
    return _labelled_sizes(sets, fan, same, [*k1, *k2], labels)


def _fans(first: DataFrame, second: DataFrame, k1: list[str], k2: list[str], again: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(sets of middles of each x, ends reached from each distinct set and how many x have it, columns that tell sets apart)."""
    legs_ = first.select(*k1, "x", "m").distinct()
    shape = [F.count("*").alias("_n"), F.bit_xor(F.xxhash64("m")).alias("_h"), F.bit_xor(F.xxhash64(F.lit(7), "m")).alias("_i")]
    sets = legs_.groupBy(*k1, "x").agg(*shape)
    sets = staged(sets) if again else sets
    same = [*k1, "_n", "_h", "_i"]
    who = sets.groupBy(*same).agg(F.min("x").alias("x"), F.count("*").alias("_xs"))
    fan = who.join(legs_, [*k1, "x"]).join(second, "m").select(*same, "_xs", *k2, "y").distinct().groupBy(*same, "_xs", *k2).agg(F.count("*").alias("_ys"))
    return sets, staged(fan) if again else fan, same


def _labelled_sizes(sets: DataFrame, fan: DataFrame, same: list[str], key: list[str], labels: DataFrame) -> DataFrame:
    who = sets.join(labels.distinct(), "x").groupBy(*same, "label").agg(F.count("*").alias("_own"))
    return fan.join(who, same).groupBy(*key, "label").agg(F.sum(F.col("_own") * F.col("_ys")).alias("pairs"))


def path_hits(first: DataFrame, second: DataFrame, k1: list[str], k2: list[str], goal: DataFrame) -> DataFrame:
    """(k1..., k2..., goal's other columns, hits): goal(x, y, ...) pairs that a path connects.

    The goal leads: each of its pairs meets the legs of x, and these the second
    leg by both ends, so that the rows are bounded by the goal times a degree.
    """
    own = [c for c in goal.columns if c not in ("x", "y")]
    met = goal.distinct().join(first.select(*k1, "x", "m").distinct(), "x").join(second.select("m", *k2, "y").distinct(), ["m", "y"])
    return met.select(*k1, *k2, *own, "x", "y").distinct().groupBy(*k1, *k2, *own).agg(F.count("*").alias("hits"))


def _loops(first: DataFrame, second: DataFrame, k1: list[str], k2: list[str]) -> DataFrame:
    """(k1..., k2..., loops): ends x that a path leads back to."""
    back = first.select(*k1, "x", "m").distinct().join(second.select("m", *k2, F.col("y").alias("x")).distinct(), ["m", "x"])
    return back.select(*k1, *k2, "x").distinct().groupBy(*k1, *k2).agg(F.count("*").alias("loops"))


def candidates(facts: DataFrame, target: str, complete_heads: DataFrame | None = None, relations: list[str] | None = None, options: Mining = Mining()) -> DataFrame:
    """(name, r1, inv1, r2, inv2, body, support, confidence): all bodies of one or two legs with their counts over distinct (x, y), x <> y.

    Supports are found from the target's pairs, and the sizes of bodies are
    counted without listing their pairs (path_sizes).  Only heads in
    complete_heads(id) count, if given.  A target with fewer pairs than
    min_support has no bodies, and so has an empty table.  relations restricts
    the legs.
    """
    goal = staged(facts.filter(F.col("rel") == target).select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct())
    use = facts if relations is None else facts.filter(F.col("rel").isin([*relations, target]))
    all_legs = legs(use)
    start = all_legs if complete_heads is None else all_legs.join(complete_heads.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    k1, k2 = ["r1", "inv1"], ["r2", "inv2"]
    l1 = start.select(F.col("rel").alias("r1"), F.col("inv").alias("inv1"), F.col("a").alias("x"), F.col("b").alias("m"))
    l2 = all_legs.select(F.col("a").alias("m"), F.col("rel").alias("r2"), F.col("inv").alias("inv2"), F.col("b").alias("y"))
    if not options.target_in_body:
        l1, l2 = l1.filter(F.col("r1") != target), l2.filter(F.col("r2") != target)
    l1, l2 = staged(l1), staged(l2)
    one = l1.filter((F.col("r1") != target) & (F.col("x") != F.col("m"))).select(*k1, "x", F.col("m").alias("y"))
    single = one.join(goal.withColumn("_hit", F.lit(1)), ["x", "y"], "left").groupBy(*k1).agg(F.count("*").alias("body"), F.count("_hit").alias("support"))
    single = single.select(*k1, F.lit("").alias("r2"), F.lit(False).alias("inv2"), "body", "support")
    shape = [*k1, *k2]
    sizes = path_sizes(l1, l2, k1, k2)
    if not options.target_self_loop:
        sizes = sizes.filter((F.col("r1") != target) | (F.col("r2") != target))
    both = sizes.join(_loops(l1, l2, k1, k2), shape, "left").join(path_hits(l1, l2, k1, k2, goal.filter("x <> y")), shape, "left")
    body = F.col("pairs") - F.coalesce("loops", F.lit(0))
    counts = single.unionByName(both.select(*shape, body.alias("body"), F.coalesce("hits", F.lit(0)).alias("support"))).filter("body > 0")
    if goal.limit(options.min_support).count() < options.min_support:
        counts = counts.filter(F.lit(False))
    name = F.concat(F.lit(f"{target}<="), _signed("r1", "inv1"), F.when(F.col("r2") == "", "").otherwise(F.concat(F.lit("."), _signed("r2", "inv2"))))
    return counts.select(name.alias("name"), *shape, "body", "support", (F.col("support") / F.col("body")).alias("confidence"))


def mine(facts: DataFrame, target: str, complete_heads: DataFrame | None = None, relations: list[str] | None = None, options: Mining = Mining()) -> DataFrame:
    """The best candidates over support and confidence; ties by body length and name."""
    c = candidates(facts, target, complete_heads, relations, options)
    good = c.filter((F.col("body") >= options.min_support) & (F.col("support") >= options.min_support) & (100 * F.col("support") >= options.confidence_percent * F.col("body")))
    return good.orderBy(F.desc("confidence"), F.desc("support"), (F.col("r2") != ""), "name").limit(options.max_rules)


def to_rule(row, target: str) -> Rule:
    """The rule of a mined row."""
    leg = lambda a, r, inv, b: (b, r, a) if inv else (a, r, b)
    body = (leg("?x", row["r1"], row["inv1"], "?m"), leg("?m", row["r2"], row["inv2"], "?y")) if row["r2"] else (leg("?x", row["r1"], row["inv1"], "?y"),)
    return Rule(row["name"], body, ("?x", target, "?y"), (("?x", "?y"),))


def ready(teacher: DataFrame, synthesised: DataFrame, trigger: int = 10) -> DataFrame:
    """Relations with at least trigger complete heads that haven't been mined: teacher(head, relation, answers) counts empty answers too."""
    return teacher.groupBy("relation").agg(F.countDistinct("head").alias("heads")).filter(F.col("heads") >= trigger).join(synthesised, "relation", "left_anti")


def _forward(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = staged(edges.select("src", "rel", "dst").distinct())
    return e, e.select(F.col("rel").alias("r1"), F.col("src").alias("x"), F.col("dst").alias("m")), e.select(F.col("rel").alias("r2"), F.col("src").alias("m"), F.col("dst").alias("y"))


def amie(edges: DataFrame, min_support: int = 10, min_pca: float = 0.5, min_head_coverage: float = 0.01, max_rules: int | None = None) -> DataFrame:
    """(body1, body2, head, support, body_size, pca_body, head_coverage, std_confidence, pca_confidence) of forward paths of two.

    The PCA body has the pairs whose x has any edge of the head relation.
    max_rules keeps the best by PCA confidence and support, ties by name.  An
    empty table gives no rows.
    """
    e, a, b = _forward(edges)
    head = e.select(F.col("rel").alias("head"), F.col("src").alias("x"), F.col("dst").alias("y"))
    support = path_hits(a, b, ["r1"], ["r2"], head).withColumnRenamed("hits", "support").filter(F.col("support") >= min_support)
    sets, fan, same = _fans(a, b, ["r1"], ["r2"], True)
    size = fan.groupBy("r1", "r2").agg(F.sum(F.col("_xs") * F.col("_ys")).alias("body_size"))
    pca = _labelled_sizes(sets, fan, same, ["r1", "r2"], head.select("x", F.col("head").alias("label"))).select("r1", "r2", F.col("label").alias("head"), F.col("pairs").alias("pca_body"))
    total = head.groupBy("head").agg(F.count("*").alias("head_size"))
    out = support.join(size, ["r1", "r2"]).join(pca, ["r1", "r2", "head"]).join(total, "head").withColumnsRenamed({"r1": "body1", "r2": "body2"})
    out = out.withColumn("head_coverage", F.col("support") / F.col("head_size")).withColumn("std_confidence", F.col("support") / F.col("body_size")).withColumn("pca_confidence", F.col("support") / F.col("pca_body"))
    out = out.filter((F.col("pca_confidence") >= min_pca) & (F.col("head_coverage") >= min_head_coverage))
    if max_rules is not None:
        out = out.orderBy(F.desc("pca_confidence"), F.desc("support"), "body1", "body2", "head").limit(max_rules)
    return out.select("body1", "body2", "head", "support", "body_size", "pca_body", "head_coverage", "std_confidence", "pca_confidence")


def overlap(mined: DataFrame, induced: DataFrame) -> DataFrame:
    """One row comparing two sets of path bodies (r1, r2): both, mined, induced and the recall of each."""
    m, i = mined.select("r1", "r2").distinct(), induced.select("r1", "r2").distinct()
    side = m.withColumn("m", F.lit(1)).join(i.withColumn("i", F.lit(1)), ["r1", "r2"], "full")
    out = side.agg(F.count(F.when(F.col("m").isNotNull() & F.col("i").isNotNull(), 1)).alias("both"), F.count("m").alias("mined"), F.count("i").alias("induced"))
    return out.withColumn("recall_of_mined", F.col("both") / F.nullif("mined", F.lit(0))).withColumn("recall_of_induced", F.col("both") / F.nullif("induced", F.lit(0)))


def induce_relations(edges: DataFrame, min_support: int = 10, max_proposals: int = 10) -> DataFrame:
    """(name, r1, r2, support): forward paths of two by distinct (x, y), x <> y; an empty table gives no rows."""
    _, a, b = _forward(edges)
    n = path_sizes(a, b, ["r1"], ["r2"]).join(_loops(a, b, ["r1"], ["r2"]), ["r1", "r2"], "left")
    named = n.withColumn("support", F.col("pairs") - F.coalesce("loops", F.lit(0))).filter(F.col("support") >= min_support).withColumn("name", F.concat_ws(".", "r1", "r2"))
    return named.orderBy(F.desc("support"), "name").limit(max_proposals).select("name", "r1", "r2", "support")


def mine_cases(atoms: DataFrame, targets: DataFrame, min_support: int = 5, confidence_percent: int = 90, max_atoms: int = 3) -> DataFrame:
    """(pattern, target, size, support, matched, confidence) of frequent atom sets that imply a target, without those a smaller one covers.

    atoms(case_id, atom) and targets(case_id, target); pattern is a sorted array.
    Level by level, a set grows by a later atom of the same case and only from
    frequent sets.
    """
    base = atoms.select("case_id", "atom").distinct()
    level = base.select("case_id", F.array("atom").alias("pattern"), F.col("atom").alias("last"))
    found = None
    for size in range(1, max_atoms + 1):
        counts = level.groupBy("pattern").agg(F.count("*").alias("matched")).filter(F.col("matched") >= min_support)
        frequent = staged(level.join(counts, "pattern"))
        hits = frequent.join(targets.select("case_id", "target").distinct(), "case_id").groupBy("pattern", "target", "matched").agg(F.count("*").alias("support"))
        good = hits.filter((F.col("support") >= min_support) & (100 * F.col("support") >= confidence_percent * F.col("matched"))).withColumn("size", F.lit(size))
        found = good if found is None else found.unionByName(good)
        if size < max_atoms:
            level = frequent.select("case_id", "pattern", "last").join(base, "case_id").filter(F.col("atom") > F.col("last"))
            level = level.select("case_id", F.concat("pattern", F.array("atom")).alias("pattern"), F.col("atom").alias("last"))
    found = staged(found.withColumn("confidence", F.col("support") / F.col("matched")))
    # every proper subset of a pattern is looked up by equality: patterns have max_atoms atoms at most
    n = F.size("pattern")
    bits = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 2)
    subsets = F.transform(bits, lambda m: F.filter("pattern", lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    small = found.select(F.col("pattern").alias("sub"), "target", F.col("confidence").alias("c"))
    covered = found.filter(n > 1).withColumn("sub", F.explode(subsets)).join(small, ["sub", "target"]).filter(F.col("c") >= F.col("confidence")).select("pattern", "target")
    return found.join(covered.distinct(), ["pattern", "target"], "left_anti").select("pattern", "target", "size", "support", "matched", "confidence")


def world_precision(rule: Rule, truth: DataFrame) -> DataFrame:
    """One row (name, body, correct, precision): distinct (x, y) of the body in the true world; precision 0 for an empty body."""
    pairs = join_body([truth] * len(rule.body), rule.body)
    for a, b in rule.distinct:
        pairs = pairs.filter(F.col(f"`{a}`") != F.col(f"`{b}`"))
    pairs = pairs.select(F.col(f"`{rule.head[0]}`").alias("src"), F.col(f"`{rule.head[2]}`").alias("dst")).distinct()
    head = truth.filter(F.col("rel") == rule.head[1]).select("src", "dst").distinct().withColumn("_hit", F.lit(1))
    out = pairs.join(head, ["src", "dst"], "left").agg(F.count("*").alias("body"), F.count("_hit").alias("correct"))
    return out.select(F.lit(rule.name).alias("name"), "body", "correct", F.coalesce(F.col("correct") / F.nullif("body", F.lit(0)), F.lit(0.0)).alias("precision"))


def threshold_sweep(scored: DataFrame, thresholds: list[int]) -> DataFrame:
    """(gamma_percent, installed, mean_precision) over candidates(body, support, precision): one pass for all thresholds."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("gamma_percent")
    each = scored.select("*", t).filter(100 * F.col("support") >= F.col("gamma_percent") * F.col("body"))
    return each.groupBy("gamma_percent").agg(F.count("*").alias("installed"), F.avg("precision").alias("mean_precision"))


def half(id_: Column, seed: str = "0") -> Column:
    """0 or 1 by the last hex digit of a SHA-256."""
    return F.conv(F.right(F.sha2(F.concat_ws(":", F.lit(seed), id_.cast("string")), 256), F.lit(1)), 16, 10).cast("int") % 2


def admission(fit: Column, check: Column, composition: Column) -> Column:
    """Decision on a rule from its precision on the fitting half, on the other half, and of its composition; null without data."""
    return (
        F.when(fit.isNull() | check.isNull(), "undecided")
        .when(fit < 0.90, "not_candidate")
        .when((composition >= 0.95) & (check >= 0.90), "admit")
        .when(check < 0.85, "reject_leak")
        .otherwise("hold")
    )


def gate(confidence: Column, risk: Column) -> Column:
    return (confidence >= 0.55) & (risk <= 0.5)


def gated(rules: DataFrame) -> DataFrame:
    """rules(confidence, fired, matched, ...) with risk, the unmatched share of what fired, and admitted.

    A rule that never fired has risk 1; one with a missing figure isn't admitted.
    """
    known = F.col("confidence").isNotNull() & F.col("fired").isNotNull() & F.col("matched").isNotNull()
    risk = F.when(~known | (F.col("fired") == 0), 1.0).otherwise(1 - F.col("matched") / F.nullif("fired", F.lit(0)))
    return rules.withColumn("risk", risk).withColumn("admitted", known & gate(F.coalesce("confidence", F.lit(0.0)), F.col("risk")))


def gate_stats(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rules, reject_leakage, keep_composition, delta, agreement) of rules(class, admitted, precision, other_admitted).

    delta is the mean precision of admitted compositions less that of admitted
    leaks, or without the latter where none is admitted; shares of an empty
    class are null.
    """
    comp, leak, ok = F.col("class") == "composition", F.col("class") == "leakage", F.col("admitted")
    share = lambda part, of: F.avg(F.when(of, part.cast("double")))
    good, bad = F.avg(F.when(comp & ok, F.col("precision"))), F.avg(F.when(leak & ok, F.col("precision")))
    return rules.groupBy(*keys).agg(
        F.count("*").alias("n_rules"),
        share(~ok, leak).alias("reject_leakage"),
        share(ok, comp).alias("keep_composition"),
        (good - F.coalesce(bad, F.lit(0.0))).alias("delta"),
        F.avg((ok == F.col("other_admitted")).cast("double")).alias("agreement"),
    )


def rule_classes(rules: DataFrame, composition: list[str], name: str = "rule") -> DataFrame:
    """rules with class: composition if the body names all of composition, else self_referential if it names the target, else other."""
    body = F.substring_index(F.col(name), "<=", -1)
    target = F.trim(F.regexp_replace(F.substring_index(F.col(name), "<=", 1), "^syn:", ""))
    every = F.forall(F.array(*[F.lit(x) for x in composition]), lambda x: F.contains(body, x))
    return rules.withColumn("class", F.when(every, "composition").when((target != "") & F.contains(body, target), "self_referential").otherwise("other"))


def cell_names(cells: DataFrame, short: dict[str, tuple[str, int]] | None = None, stem: str = "stem") -> DataFrame:
    """cells with slug, seed and match_key of file names vendor__model_hop2_lim300_s3, maybe ending in _forbid; short names some outright.

    match_key drops the dots, which one side's names lack.  A name of neither
    form has nulls.
    """
    plain = F.regexp_replace(stem, "_forbid$", "")
    raw = F.regexp_extract(plain, r"^(.+?)_hop2_lim300_s(\d+)$", 1)
    parted = F.when(F.contains(raw, F.lit("__")), F.replace(raw, F.lit("__"), F.lit("/"))).otherwise(F.regexp_replace(raw, "^([^_]*)_", "$1/"))
    slug = F.when(raw != "", parted)
    seed = F.when(raw != "", F.regexp_extract(plain, r"_s(\d+)$", 1).cast("int"))
    for k, (s, n) in (short or {}).items():
        slug, seed = F.when(plain == k, F.lit(s)).otherwise(slug), F.when(plain == k, F.lit(n)).otherwise(seed)
    return cells.withColumn("slug", slug).withColumn("seed", seed).withColumn("match_key", F.concat_ws("#", F.replace("slug", F.lit("."), F.lit("")), "seed"))


def case_rules(found: DataFrame) -> list[Rule]:
    """Rules of mined case patterns, slot=value atoms, with constants: an article is violated, permit is a verdict.

    One for each row: max_rules of the miner bounds what the driver takes.
    """
    out = []
    for r in found.orderBy("target", F.array_join("pattern", "&")).collect():
        body = tuple(("?c", f"has_{slot}", f"{slot}:{value}") for slot, value in (a.split("=", 1) for a in r["pattern"]))
        head = ("?c", "permit", "yes") if r["target"] == "permit" else ("?c", "violates", r["target"])
        out.append(Rule(f"case:{r['target']}<={'&'.join(r['pattern'])}", body, head))
    return out


def near_miss_world(cases: DataFrame, theta: float, seed: int = 0, n_entities: int = 200, zipf_a: float = 1.3) -> DataFrame:
    """(case_id, entity, half, gold, leak_fired, leak_answer) of a world by modular arithmetic, over cases(case_id).

    The true target of entity x is the shared image 7 m + 3 of its middle m = 11 x + 5,
    modulo the number of entities.  A leak fires on a share theta of the cases
    and is right on a share 1 - theta of these; draws come from hashes, entities
    from a Zipf law by inversion of a power.
    """
    key = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), "case_id")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # the continuous law with density x^-a on [1, n]
    p = 1 - zipf_a
    entity = F.least(F.lit(n_entities - 1), F.floor(F.pow(key("entity") * (F.lit(float(n_entities)) ** p - 1) + 1, F.lit(1 / p))).cast("int") - 1)
    c = cases.select("case_id").withColumn("entity", entity)
    middle = (F.col("entity") * 11 + 5) % n_entities
    image = (middle * 7 + 3) % n_entities
    gold = F.when((middle != F.col("entity")) & (image != F.col("entity")), image)
    wrong = (F.col("entity") + 1 + F.floor(key("wrong") * (n_entities - 1)).cast("int")) % n_entities
    c = c.withColumn("gold", gold).withColumn("leak_fired", key("fired") < theta)
    leak = F.when(F.col("leak_fired"), F.when((key("right") < 1 - theta) & F.col("gold").isNotNull(), F.col("gold")).otherwise(wrong))
    return c.select("case_id", "entity", half(F.col("case_id"), str(seed)).alias("half"), "gold", "leak_fired", leak.alias("leak_answer"))


def near_miss_cell(world: DataFrame) -> DataFrame:
    """One row (comp_estimate, leak_estimate, leak_exact, estimated, exact, matches): what the validation half says against all cases.

    The composition is right on every head that it covers.
    """
    right = (F.col("leak_answer") == F.col("gold")).cast("double")
    held = F.col("half") == 1
    out = world.agg(
        F.avg(F.when(held & F.col("gold").isNotNull(), 1.0)).alias("comp_estimate"),
        F.avg(F.when(held & F.col("leak_fired"), F.coalesce(right, F.lit(0.0)))).alias("leak_estimate"),
        F.avg(F.when(F.col("leak_fired"), F.coalesce(right, F.lit(0.0)))).alias("leak_exact"),
    )
    verdict = lambda comp, leak: F.when(leak.isNull(), "NO_LEAK_EVIDENCE").when((leak < 0.85) & (comp >= 0.90), "ADMIT_COMPOSITION_REJECT_LEAK").when(comp < 0.10, "REJECT_COMPOSITION").otherwise("DEAD_ZONE")
    out = out.withColumn("estimated", verdict(F.coalesce("comp_estimate", F.lit(0.0)), F.col("leak_estimate"))).withColumn("exact", verdict(F.lit(1.0), F.col("leak_exact")))
    return out.withColumn("matches", F.col("estimated") == F.col("exact"))


def campaign(cells: DataFrame) -> DataFrame:
    """One row (decision, match_share) over cells(theta, comp_estimate, leak_estimate, matches)."""
    delta = F.col("comp_estimate") - F.col("leak_estimate")
    low = F.col("theta") <= 0.40
    out = cells.agg(
        F.coalesce(F.bool_and(F.when(low, F.coalesce(delta >= 0.20, F.lit(False)))), F.lit(False)).alias("_low"),
        F.coalesce(F.bool_or(delta < 0.05), F.lit(False)).alias("_blind"),
        F.coalesce(F.avg(F.col("matches").cast("double")), F.lit(0.0)).alias("match_share"),
    )
    return out.select(F.when(F.col("_low") & (F.col("match_share") >= 0.90), "POSITIVE").when(F.col("_blind"), "NEGATIVE").otherwise("NEUTRAL").alias("decision"), "match_share")


def score_rules(rules: list[Rule], truth: DataFrame, seed: str = "0") -> DataFrame:
    """(name, class, fit, check, composition, decision) of rules judged on two halves of the heads.

    fit and check are world precisions over heads of half 0 and half 1, and
    class is composition where the precision over all heads is 0.95 or more,
    else leakage.
    """
    out = None
    for r in rules:
        pairs = join_body([truth] * len(r.body), r.body)
        for a, b in r.distinct:
            pairs = pairs.filter(F.col(f"`{a}`") != F.col(f"`{b}`"))
        pairs = pairs.select(F.col(f"`{r.head[0]}`").alias("src"), F.col(f"`{r.head[2]}`").alias("dst")).distinct()
        hit = truth.filter(F.col("rel") == r.head[1]).select("src", "dst").distinct().withColumn("_hit", F.lit(1))
        right, side = F.col("_hit").isNotNull().cast("double"), half(F.col("src"), seed)
        row = pairs.join(hit, ["src", "dst"], "left").agg(F.avg(F.when(side == 0, right)).alias("fit"), F.avg(F.when(side == 1, right)).alias("check"), F.avg(right).alias("composition"))
        row = row.select(F.lit(r.name).alias("name"), F.when(F.col("composition") >= 0.95, "composition").otherwise("leakage").alias("class"), "*", admission(F.col("fit"), F.col("check"), F.col("composition")).alias("decision"))
        out = row if out is None else out.unionByName(row)
    return out


def synthesise(facts: DataFrame, teacher: DataFrame, synthesised: DataFrame, options: Mining = Mining(), trigger: int = 10) -> dict[str, list[Rule]]:
    """{relation: rules} of the relations that are ready, mined over facts and what the teacher(head, relation, answers) said."""
    told = teacher_facts(teacher)
    every = staged(facts.select("src", "rel", "dst").union(told).distinct())
    out = {}
    for r in ready(teacher, synthesised, trigger).orderBy("relation").collect():  # a row a relation
        heads_ = teacher.filter(F.col("relation") == r.relation).select(F.col("head").alias("id")).distinct()
        out[r.relation] = [to_rule(row, r.relation) for row in mine(every, r.relation, heads_, options=options).collect()]
    return out


def teacher_facts(teacher: DataFrame) -> DataFrame:
    """(src, rel, dst) of what the teacher(head, relation, answers) said: what embeddings are refitted on beside the graph."""
    return teacher.select(F.col("head").alias("src"), F.col("relation").alias("rel"), F.explode("answers").alias("dst")).distinct()


def rule_shape(name: Column, target: Column) -> Column:
    """pure_self_loop, mixed_recursive or base_only from a rule's name."""
    parts = F.transform(F.split(F.element_at(F.split(name, "<="), 2), r"\."), lambda x: F.regexp_replace(x, "^~", ""))
    hits = F.size(F.filter(parts, lambda x: x == target))
    return F.when(hits == F.size(parts), "pure_self_loop").when(hits > 0, "mixed_recursive").otherwise("base_only")


def shadow(log: DataFrame, k: int = 3) -> DataFrame:
    """(rule, state, at) from a log(rule, idx, head, agrees) of a rule's silent predictions.

    The k-th distinct head that agrees promotes a rule unless a disagreement came first; the first disagreement demotes.
    """
    first_seen = log.groupBy("rule", "head", "agrees").agg(F.min("idx").alias("idx"))
    no = first_seen.filter("NOT agrees").groupBy("rule").agg(F.min("idx").alias("no"))
    # the k smallest of each of a few buckets, then of a rule: no rule is sorted in one task
    bucket = F.pmod(F.xxhash64("head"), F.lit(64)).alias("_b")
    few = lambda c: F.slice(F.array_sort(c), 1, k)
    near = first_seen.filter("agrees").withColumn("_n", F.row_number().over(Window.partitionBy("rule", bucket).orderBy("idx"))).filter(F.col("_n") <= k)
    yes = near.groupBy("rule").agg(few(F.collect_list("idx")).alias("_f")).select("rule", F.get("_f", F.lit(k - 1)).alias("yes"))
    marks = log.select("rule").distinct().join(no, "rule", "left").join(yes, "rule", "left")
    promoted = F.col("yes").isNotNull() & (F.col("no").isNull() | (F.col("yes") < F.col("no")))
    state = F.when(promoted, "promoted").when(F.col("no").isNotNull(), "demoted").otherwise("shadow")
    return marks.select("rule", state.alias("state"), F.when(promoted, F.col("yes")).otherwise(F.col("no")).alias("at"))


def majority(samples: DataFrame, k: int) -> DataFrame:
    """(head, relation, answers) that at least half of the k samples(head, relation, sample, answers) have."""
    votes = samples.select("head", "relation", "sample", F.explode(F.array_distinct("answers")).alias("a")).distinct().groupBy("head", "relation", "a").count()
    kept = votes.filter(F.col("count") >= (k + 1) // 2).groupBy("head", "relation").agg(F.array_sort(F.collect_set("a")).alias("answers"))
    none = F.array().cast("array<string>")
    return samples.select("head", "relation").distinct().join(kept, ["head", "relation"], "left").withColumn("answers", F.coalesce("answers", none))
