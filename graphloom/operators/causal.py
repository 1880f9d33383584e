"""Structural causal models over finite domains: given or fitted to a table, sampled as columns, and asked of the rows of a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import axiom_rules, closure
from graphloom.plans.stage import staged

Mechanism = Callable[[dict[str, Column], Column], Column]


@dataclass
class Variable:
    name: str
    domain: tuple
    parents: tuple[str, ...]
    mechanism: Mechanism
    cells: Callable[[dict[str, Column]], Column] | None = None  # of fitted variables: (low, upto, value) in order, by the parents


@dataclass
class CausalModel:
    """Parents have to be there before their children, so that the graph has no cycle; bidirected pairs share hidden causes."""

    variables: dict[str, Variable] = field(default_factory=dict)
    bidirected: set[frozenset] = field(default_factory=set)
    seed: str = "0"

    def add(self, name: str, domain: tuple, parents: tuple[str, ...], mechanism: Mechanism, cells: Callable[[dict[str, Column]], Column] | None = None) -> None:
        if name in self.variables:
            raise ValueError(f"{name} is there already")
        if missing := [p for p in parents if p not in self.variables]:
            raise ValueError(f"unknown parents {missing}")
        self.variables[name] = Variable(name, domain, parents, mechanism, cells)

    def add_bidirected(self, a: str, b: str) -> None:
        if a == b or not {a, b} <= set(self.variables):
            raise ValueError("two known variables are needed")
        self.bidirected.add(frozenset((a, b)))

    def noise(self, name: str) -> Column:
        """Uniform in [0, 1) from a hash of seed, variable and row."""
        key = F.concat_ws(":", F.lit(self.seed), F.lit(name), F.col("id").cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)

    def columns(self, do: dict | None = None) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for v in self.variables.values():
            out[v.name] = F.lit(do[v.name]) if do and v.name in do else v.mechanism({p: F.col(p) for p in v.parents}, self.noise(v.name))
        return out

    def sample(self, units: SparkSession | DataFrame, n: int = 5000, evidence: dict | None = None, do: dict | None = None) -> DataFrame:
        """(id, a column per variable) of the draws that fit the evidence: n of a session, or one for each row of units(id)."""
        rows = units.select("id") if isinstance(units, DataFrame) else units.range(n)
        for name, c in self.columns(do).items():
            rows = rows.withColumn(name, c)
        for name, x in (evidence or {}).items():
            rows = rows.filter(F.col(name) == x)
        return rows

    def distribution(self, units: SparkSession | DataFrame, target: str, n: int = 5000, evidence: dict | None = None, do: dict | None = None) -> DataFrame:
        """(value, n, probability) for the whole domain of target; probability is null without samples."""
        counts = self.sample(units, n, evidence, do).groupBy(F.col(target).alias("value")).count()
        domain = counts.sparkSession.createDataFrame([(x,) for x in self.variables[target].domain], ["value"])
        out = domain.join(counts, "value", "left").select("value", F.coalesce("count", F.lit(0)).alias("n"))
        total = out.agg(F.sum("n").alias("total"))
        return out.crossJoin(total).select("value", "n", (F.col("n") / F.nullif("total", F.lit(0))).alias("probability"))

    def probability(self, units: SparkSession | DataFrame, target: str, value, n: int = 5000, evidence: dict | None = None, do: dict | None = None) -> DataFrame:
        """One row (probability, n): the share of draws that fit the evidence in which target has the value; null without any."""
        return self.sample(units, n, evidence, do).agg(F.avg((F.col(target) == value).cast("double")).alias("probability"), F.count("*").alias("n"))

    def estimands(self, units: SparkSession | DataFrame, x: str, y: str, n: int = 5000) -> DataFrame:
        """(estimand, value) for binary x and y: association, P(y = 1 | x = 1), the same under do(x = 1) and do(x = 0), and their difference."""
        named = lambda name, df: df.select(F.lit(name).alias("estimand"), F.col("probability").alias("value"))
        one, zero = (self.probability(units, y, 1, n, do={x: v}) for v in (1, 0))
        effect = one.select(F.col("probability").alias("a")).crossJoin(zero.select(F.col("probability").alias("b"))).select(F.lit("average_effect").alias("estimand"), (F.col("a") - F.col("b")).alias("value"))
        return named("association", self.probability(units, y, 1, n, evidence={x: 1})).union(named("do_1", one)).union(named("do_0", zero)).union(effect)

    def counterfactual(self, units: SparkSession | DataFrame, evidence: dict, do: dict, target: str, n: int = 5000) -> DataFrame:
        """(value, n) of target had do been so: rows whose factual values fit the evidence are replayed with the same noise."""
        rows = self.sample(units, n, evidence).select("id")
        for name, c in self.columns(do).items():
            rows = rows.withColumn(name, c)
        return rows.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))

    def twins(self, rows: DataFrame, do: dict) -> DataFrame:
        """rows(id, a column per variable) with had_<name> for each variable: what a fitted model says it had been under do.

        Noise is drawn anew for each variable of a row, within the range in
        which its mechanism gives what was observed; it then runs through the
        model under do.  A variable that nothing changed stays as it was.
        Values that the model never saw with these parents give null.
        """
        out = rows
        for v in self.variables.values():
            if v.name in do:
                had = F.lit(do[v.name])
            elif v.cells is None:
                raise ValueError(f"{v.name} has no fitted mechanism")
            else:
                seen = F.get(F.filter(v.cells({p: F.col(p) for p in v.parents}), lambda c: c["value"] == F.col(v.name)), F.lit(0))
                had = v.mechanism({p: F.col(f"had_{p}") for p in v.parents}, seen["low"] + (seen["upto"] - seen["low"]) * self.noise(v.name))
            out = out.withColumn(f"had_{v.name}", had)
        return out

    def children(self, x: str) -> set[str]:
        return {v.name for v in self.variables.values() if x in v.parents}

    def _reach(self, x: str, step: Callable[[str], set[str]]) -> set[str]:
        out: set[str] = set()
        todo = [x]
        while todo:
            for y in step(todo.pop()) - out:
                out.add(y)
                todo.append(y)
        return out

    def ancestors(self, x: str) -> set[str]:
        return self._reach(x, lambda v: set(self.variables[v].parents))

    def descendants(self, x: str) -> set[str]:
        return self._reach(x, self.children)

    def paths(self, a: str, b: str) -> list[list[str]]:
        """Directed paths from a to b."""
        if a == b:
            return [[a]]
        return [[a, *rest] for c in sorted(self.children(a)) for rest in self.paths(c, b)]

    def backdoor_set(self, x: str, y: str) -> set[str]:
        return set(self.variables[x].parents) - self.descendants(x) - {y}

    def front_door_set(self, x: str, y: str, most: int = 2) -> set[str] | None:
        """The smallest set of mediators that every directed path meets and that no hidden cause ties to either side."""
        routes = [set(p[1:-1]) for p in self.paths(x, y)]
        mediators = sorted(set().union(*routes)) if routes else []
        tied = lambda a, b: frozenset((a, b)) in self.bidirected
        for k in range(1, most + 1):
            for s in combinations(mediators, k):
                if all(r & set(s) for r in routes) and not any(tied(m, v) for m in s for v in (x, y)):
                    return set(s)
        return None

    def instruments(self, x: str, y: str) -> list[str]:
        """Causes of x that reach y only through x and share no hidden cause with y."""
        through = lambda z: all(x in p for p in self.paths(z, y))
        return [z for z in self.variables if z not in (x, y) and x in self.descendants(z) and through(z) and frozenset((z, y)) not in self.bidirected]


def adjusted(rows: DataFrame, x: str, y: str, z: list[str]) -> DataFrame:
    """(x, effect): the sum over z of P(y = 1 | x, z) P(z)."""
    n = rows.agg(F.count("*").alias("total"))
    pz = rows.groupBy(*z).agg(F.count("*").alias("nz"))
    py = rows.groupBy(x, *z).agg(F.avg(F.col(y).cast("double")).alias("p"))
    return py.join(pz, z).crossJoin(n).groupBy(x).agg(F.sum(F.col("p") * F.col("nz") / F.col("total")).alias("effect"))


#: Cells that the table of one variable of a fitted model may have; they become literals of its expressions.
CELLS = 1024


def fitted(rows: DataFrame, parents: dict[str, tuple[str, ...]], seed: str = "0") -> CausalModel:
    """A model with the shares that rows has: each variable of parents, in that order, given the values of its parents.

    Rows are counted once, by all variables together; those with a null among
    them are left out.  Values have the order of their type.  Values of parents
    that no row has give the shares over all rows.  A variable of more than
    CELLS combinations with its parents raises, as does an empty table.
    """
    names = list(parents)
    joint = staged(rows.select(*names).dropna().groupBy(*names).count())
    model = CausalModel(seed=seed)
    for name in names:
        own = parents[name]
        cells = joint.groupBy(*own, name).agg(F.sum("count").alias("n")).orderBy(*own, name).limit(CELLS + 1).collect()
        if not 0 < len(cells) <= CELLS:
            raise ValueError(f"{name} has {'no values' if not cells else f'more than {CELLS} combinations with its parents'}")
        by: dict[tuple, dict] = {}
        every: dict = {}
        for r in cells:
            by.setdefault(tuple(r[:-2]), {})[r[-2]] = r.n
            every[r[-2]] = every.get(r[-2], 0) + r.n
        table, marginal = {k: _ranges(c) for k, c in by.items()}, _ranges(every)
        model.add(name, tuple(sorted(every)), own, *_mechanism(table, marginal, own))
    return model


def _ranges(counts: dict) -> Column:
    """Array of (low, upto, value): the unit interval in parts as long as the shares of the values, in their order."""
    total, upto, out = sum(counts.values()), 0, []
    for value, n in sorted(counts.items()):
        out.append(F.struct(F.lit(upto / total).alias("low"), F.lit((upto + n) / total).alias("upto"), F.lit(value).alias("value")))
        upto += n
    return F.array(*out)


def _mechanism(table: dict[tuple, Column], marginal: Column, parents: tuple[str, ...]) -> tuple[Mechanism, Callable[[dict[str, Column]], Column]]:
    at = F.create_map(*[x for k, c in table.items() for x in (F.struct(*[F.lit(v).alias(f"p{i}") for i, v in enumerate(k)]) if k else F.lit(0), c)])

    def cells(p: dict[str, Column]) -> Column:
        return F.coalesce(F.try_element_at(at, F.struct(*[p[x].alias(f"p{i}") for i, x in enumerate(parents)]) if parents else F.lit(0)), marginal)

    return lambda p, u: F.get(F.filter(cells(p), lambda c: u < c["upto"]), F.lit(0))["value"], cells


def lineages(edges: DataFrame) -> DataFrame:
    """(src, dst): every cause with all that it leads to, for a causal graph that is a table of edges(src, dst)."""
    return closure(edges.select("src", F.lit("causes").alias("rel"), "dst").distinct(), axiom_rules([{"name": "causes", "transitive": True}]), by_steps=True).filter("rel = 'causes'").select("src", "dst")


def backdoor_sets(edges: DataFrame, pairs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(x, y, z), a row for each variable z to adjust for, of pairs(x, y) in a causal graph that is a table of edges(src, dst): causes of x that x doesn't lead to, without y.

    lines are the lineages of the graph, where they are there already.
    """
    lines = lineages(edges) if lines is None else lines
    z = pairs.select("x", "y").distinct().join(edges.select(F.col("dst").alias("x"), F.col("src").alias("z")).distinct(), "x").filter("z <> y AND z <> x")
    # a cause that x leads to is one of a loop through x: other lines needn't be looked through
    loops = staged(lines.filter("src = dst").select(F.col("src").alias("x")))
    return z.join(lines.select(F.col("src").alias("x"), F.col("dst").alias("z")).join(loops, "x", "left_semi"), ["x", "z"], "left_anti").select("x", "y", "z")
