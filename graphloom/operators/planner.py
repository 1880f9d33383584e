"""Planning by uniform-cost search over ground actions; states are small sets of facts on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

from graphloom.plans.rules import Pattern, Rule, is_var

Fact = tuple[str, str, str]


@dataclass(frozen=True)
class Action:
    name: str
    needs: tuple[Pattern, ...]
    adds: tuple[Pattern, ...]
    removes: tuple[Pattern, ...] = ()
    cost: float = 1.0


def match(pattern: Pattern, fact: Fact, bound: dict[str, str]) -> dict[str, str] | None:
    out = dict(bound)
    for p, f in zip(pattern, fact):
        if is_var(p):
            if out.setdefault(p, f) != f:
                return None
        elif p != f:
            return None
    return out


def ground(action: Action, facts: frozenset[Fact], entities: list[str]) -> Iterator[dict[str, str]]:
    """Bindings under which all that action needs is there; variables that only its effects have take every entity."""

    def needs(i: int, bound: dict[str, str]) -> Iterator[dict[str, str]]:
        if i == len(action.needs):
            yield from free(sorted({x for p in (*action.adds, *action.removes) for x in p if is_var(x)} - set(bound)), bound)
            return
        for f in sorted(facts):
            if (b := match(action.needs[i], f, bound)) is not None:
                yield from needs(i + 1, b)

    def free(names: list[str], bound: dict[str, str]) -> Iterator[dict[str, str]]:
        if not names:
            yield bound
            return
        for e in entities:
            yield from free(names[1:], bound | {names[0]: e})

    seen = set()
    for b in needs(0, {}):
        if (k := tuple(sorted(b.items()))) not in seen:
            seen.add(k)
            yield b


def fill(pattern: Pattern, bound: dict[str, str]) -> Fact:
    return tuple(bound.get(x, x) for x in pattern)


def satisfied(goal: list[Pattern], facts: frozenset[Fact]) -> bool:
    """Each pattern by itself."""
    return all(any(match(g, f, {}) is not None for f in facts) for g in goal)


def closed(facts: frozenset[Fact], rules: list[Rule]) -> frozenset[Fact]:
    """The facts of one state and all that the rules derive from them; states are small, graphs are closed by plans.fixpoint."""
    known, new = set(facts), set(facts)
    while new and rules:
        found = set()
        for r in rules:
            for i in range(len(r.body)):  # one premise is new
                rows = [b for f in new if (b := match(r.body[i], f, {})) is not None]
                for j in (j for j in range(len(r.body)) if j != i):
                    rows = [b2 for b in rows for f in known if (b2 := match(r.body[j], f, b)) is not None]
                found |= {fill(r.head, b) for b in rows if all(b.get(x, x) != b.get(y, y) for x, y in r.distinct)}
        new = found - known
        known |= new
    return frozenset(known)


def plan(start: set[Fact], goal: list[Pattern], actions: list[Action], max_depth: int = 6, max_nodes: int = 5000, rules: list[Rule] | None = None, entities: set[str] | None = None) -> tuple[float, list[str]] | None:
    """(cost, steps) of a cheapest plan, or None within the bounds.

    It starts from the closure of the start under the rules, and the goal is
    tested on the closure of a state.  Free variables of effects take the given
    entities beside those of the facts.
    """
    rules = rules or []
    first = closed(frozenset(start), rules)
    queue, best, n, tried = [(0.0, 0, first, [])], {first: 0.0}, 0, 0
    while queue and tried < max_nodes:
        cost, _, facts, steps = heapq.heappop(queue)
        if satisfied(goal, closed(facts, rules)):
            return cost, steps
        tried += 1
        if len(steps) == max_depth or cost > best[facts]:
            continue
        names = sorted({x for s, _, o in facts for x in (s, o)} | (entities or set()))
        for a in actions:
            for b in ground(a, facts, names):
                nxt = (facts - {fill(p, b) for p in a.removes}) | {fill(p, b) for p in a.adds}
                if cost + a.cost < best.get(nxt, float("inf")):
                    best[nxt] = cost + a.cost
                    n += 1
                    heapq.heappush(queue, (cost + a.cost, n, nxt, [*steps, f"{a.name}({', '.join(b[k] for k in sorted(b))})"]))
    return None
