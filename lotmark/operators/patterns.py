"""Patterns over the edges of a graph: chains, stars and trees of relations, all of their matches at once.

Before anything is joined, every step's edges are reduced to those that take part in a match: by semi-joins from the
pattern's ends to its first step, and back. What joins make after that grows with the edges and the matches alone; an
edge that leads nowhere, even of a hub, isn't carried on.

Where all edges of a match lie in one scope, as those of a project do, they are dealt to tasks by it and meet there,
so a task holds its scopes' edges alone. Semi-joins from the ends to the first step are enough then,
as joins start at that step and each row they make is part of a match.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.operators.linking import checkpoint, stored
from lotmark.sources.tables import dealt


@dataclasses.dataclass(frozen=True)
class Step:
    """An edge of a relation from a node to a node; nodes of one name are the same node."""

    relation: str
    start: str
    end: str


def tree(steps: list[Step]) -> list[tuple[int, int, list[str]]]:
    """The steps behind the first as (step, earlier step that it hangs on, nodes that they share), in an order for joins.

    ValueError for a pattern that isn't connected, and for one with a cycle, which semi-joins can't reduce.
    """
    left, done, out = list(range(1, len(steps))), [0], []
    nodes = lambda k: {steps[k].start, steps[k].end}
    while left:
        seen = set().union(*map(nodes, done))
        near = [k for k in left if nodes(k) & seen]
        if not near:
            raise ValueError("the steps aren't connected")
        k = near[0]
        shared = nodes(k) & seen
        on = [d for d in done if shared <= nodes(d)]
        if not on:
            raise ValueError("the steps have a cycle")
        out.append((k, on[0], sorted(shared)))
        left.remove(k)
        done.append(k)
    return out


def _met(left: DataFrame, right: DataFrame, shared: list[str], scope: str | None, how: str = "inner") -> DataFrame:
    """left joined with right on the nodes that they share, in their scope."""
    if scope is None:
        return left.join(right, shared, how)
    on, other = F.col(scope) == F.col(f"_{scope}"), right.withColumnsRenamed({c: f"_{c}" for c in [scope, *shared]})
    for c in shared:  # as two bounds, a node is no key of the join, and edges meet where they lie, by scope
        on &= (F.col(c) <= F.col(f"_{c}")) & (F.col(c) >= F.col(f"_{c}"))
    return left.join(other, on, how).drop(*[f"_{c}" for c in [scope, *shared]])


def _own(edges: DataFrame, step: Step, where: dict[str, list[str]] | None) -> DataFrame:
    """A relation's edges as a step's: columns named as its nodes, which may be what `where` says alone."""
    own = edges.withColumnsRenamed({"source": step.start, "target": step.end})
    for node in {step.start, step.end} & set(where or {}):
        own = own.where(F.col(node).isin(*where[node]))
    return own


def reduced(edges: DataFrame, steps: list[Step], where: dict[str, list[str]] | None = None) -> list[DataFrame]:
    """For each step the distinct edges, columns named as its nodes, that are part of a match. edges: source, target, relation.
    where: for nodes, the few uids that they may be."""
    tables, order = [_own(edges.where(F.col("relation") == step.relation).select("source", "target"), step, where).distinct() for step in steps], tree(steps)
    for k, on, shared in reversed(order):
        tables[k] = checkpoint(tables[k])
        tables[on] = tables[on].join(tables[k].select(*shared), shared, "left_semi")
    tables[0] = checkpoint(tables[0])
    for k, on, shared in order:
        tables[k] = checkpoint(tables[k].join(tables[on].select(*shared), shared, "left_semi"))
    return tables


def reduced_within(edges: DataFrame, steps: list[Step], scope: str, n: int | None, where: dict[str, list[str]] | None = None) -> list[DataFrame]:
    """For each step the distinct edges, with their scope, that lead on to a match of all later steps that hang on them. Steps that are
    alike, and hang on the same nodes of the same step, reduce it once. A relation's edges are stored once for all of its steps."""
    held = {}
    for relation in {step.relation: None for step in steps}:
        own = edges.where((F.col("relation") == relation) & F.col(scope).isNotNull()).select(scope, "source", "target")
        held[relation] = dealt(stored(dealt(own, scope, n).distinct()), scope, n)
    tables, once = [_own(held[step.relation], step, where) for step in steps], set()
    for k, on, shared in reversed(tree(steps)):
        ends = tuple(node if node in shared else tuple((where or {}).get(node, ())) for node in (steps[k].start, steps[k].end))
        hanging = any(up == k for _, up, _ in tree(steps))
        if hanging or (steps[k].relation, on, ends) not in once:
            tables[on] = _met(tables[on], tables[k].select(scope, *shared), shared, scope, "left_semi")
        once |= set() if hanging else {(steps[k].relation, on, ends)}
    return tables


def matches(
    edges: DataFrame, steps: list[Step], keep: list[str], where: dict[str, list[str]] | None = None, only: Callable[[], Column] | None = None, scope: str | None = None, n: int | None = None
) -> DataFrame:
    """The distinct values of the nodes `keep` in all matches. Nodes that no later step needs leave the join as soon as they can.
    only: a condition on the nodes of a match, all of which stay until then. scope: a column of edges whose values are the same in all
    edges of a match and null in none, and n tasks that they are dealt to by it (without n, as Spark deals them); `keep` may name it, too."""
    order = tree(steps)
    tables = reduced(edges, steps, where) if scope is None else reduced_within(edges, steps, scope, n, where)
    out, used = tables[0], {*keep, *([scope] if scope else [])}
    for i, (k, _, shared) in enumerate(order):
        later = set().union(*[set(s) for _, _, s in order[i + 1 :]], used)
        out = _met(out, tables[k], shared, scope)
        if only is None:
            out = out.select(*[c for c in out.columns if c in later])
    if only is not None:
        out = out.where(only())
    return out.select(*keep).distinct()


def counted(found: DataFrame, by: list[str], project: str, package: str) -> DataFrame:
    """by, projects, packages of distinct matches in which a package is of one project: packages are counted a project first, so no
    distinct count expands rows."""
    per = found.groupBy(*by, project).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.count("*").alias("projects"), F.sum("n").alias("packages"))
