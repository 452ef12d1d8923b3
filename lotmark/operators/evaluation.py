"""Gold against predictions: alignment, counts, metrics, duplicates, differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions.states import warning_category
from lotmark.operators.linking import components, solved, stored


def counts(df: DataFrame, keys: list[str], gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn of two boolean columns."""
    aggs = {"tp": gold & predicted, "fp": ~gold & predicted, "fn": gold & ~predicted, "tn": ~gold & ~predicted}
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in aggs.items()])


def metrics(counted: DataFrame, places: int = 6) -> DataFrame:
    """precision, recall, f1, accuracy and 0.4 accuracy + 0.3 precision + 0.3 recall; null where nothing is divided by."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    p, r, acc = share(tp, tp + fp), share(tp, tp + fn), share(tp + tn, tp + fp + fn + tn)
    out = {"precision": p, "recall": r, "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": acc, "weighted": 0.4 * acc + 0.3 * p + 0.3 * r}
    return counted.select("*", *[F.round(c, places).alias(n) for n, c in out.items()])


def field_status(gold: Column, predicted: Column, equal: Column) -> Column:
    """empty, extra, missing, correct or wrong."""
    return F.when(gold.isNull() & predicted.isNull(), "empty").when(gold.isNull(), "extra").when(predicted.isNull(), "missing").when(equal, "correct").otherwise("wrong")


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total weight; pairs of weight 0 stay apart.

    Shortest augmenting paths: rows enter one at a time, and prices of rows and columns keep reduced costs from
    becoming negative, so each search is Dijkstra's over columns, a vector operation per step.
    """
    w = np.asarray(weights, dtype=float)
    if not w.size:
        return []
    n, m = w.shape
    cost = np.hstack([w.max() - w, np.full((n, n), w.max())])  # a column for every row to stay alone
    row_price, col_price = np.zeros(n), np.zeros(m + n)
    owner = np.full(m + n, -1)
    for start in range(n):
        reach, via, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, dtype=bool)
        row, so_far = start, 0.0
        while True:
            through = so_far + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], row
            col = int(np.argmin(np.where(done, np.inf, reach)))
            so_far = reach[col]
            if owner[col] < 0:
                break
            done[col] = True
            row = owner[col]
        row_price[owner[done]] += so_far - reach[done]
        row_price[start] += so_far
        col_price[done] -= so_far - reach[done]
        while True:
            row = via[col]
            owner[col], col_next = row, np.flatnonzero(owner == row)
            col_next = col_next[col_next != col]
            if row == start:
                break
            col = int(col_next[0])
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and w[owner[j], j] > 0)


#: Rows of a scope that a task takes at once; the components of larger scopes are found by joins.
SCOPE_ROWS = 10_000


def _linked(rows: list[tuple]) -> list[list[int]]:
    """Components of rows (side, no, cells), as places in their order: rows of which both sides have a value are linked by it."""
    by_value: dict[tuple, tuple[list[int], list[int]]] = {}
    for i, (side, _, cells) in enumerate(rows):
        for pair in enumerate(cells):
            if pair[1] is not None:
                by_value.setdefault(pair, ([], []))[side].append(i)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for left, right in by_value.values():
        if left and right:
            for i in (*left, *right):
                parent[root(i)] = root(left[0])
    out: dict[int, list[int]] = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(i)
    return [part for part in out.values() if len(part) > 1]


def _paired(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(gold_no, predicted_no, weight) of rows (side, no, cells), which lie in order."""
    g, p = ([(no, cells) for side, no, cells in rows if side == n] for n in (0, 1))
    weight = lambda x, y: sum(v is not None and v == w for v, w in zip(x, y, strict=True))
    if len(g) == len(p) == 1:
        w = weight(g[0][1], p[0][1])
        return [(g[0][0], p[0][0], w)] if w else []
    if len(rows) < 20:
        weights = np.array([[weight(x, y) for _, y in p] for _, x in g], dtype=int).reshape(len(g), len(p))
    else:
        weights = np.zeros((len(g), len(p)), dtype=int)
        for x, y in zip(zip(*(c for _, c in g), strict=True), zip(*(c for _, c in p), strict=True), strict=True):
            x, y = np.array(x, dtype=object), np.array(y, dtype=object)
            weights += (x[:, None] == y[None, :]) & np.array([v is not None for v in x])[:, None]
    return [(g[i][0], p[j][0], int(weights[i, j])) for i, j in assignment(weights)]


def align(gold: DataFrame, predicted: DataFrame, scope: str, fields: list[str]) -> DataFrame:
    """scope, gold_no, predicted_no, weight: one-to-one pairs that share the most equal fields in each scope.

    Both sides have scope, `no` and the fields; null equals nothing. Equal rows are paired first, in one shuffle of both sides: as the
    weight is a number of equal fields, some best alignment has these pairs. What is left of a scope, the rows that differ, is split into
    components: rows of both sides that equal values of a field link, directly or through others. No pair
    across components has a weight, so each is solved alone. A task finds the components of a scope with at most SCOPE_ROWS rows left;
    those of larger ones are found by joins, and each is one Python call of its own.
    """
    sided = lambda df, n: df.select(scope, F.col("no").cast("long").alias("no"), *fields, F.lit(n).alias("side"))
    rows = sided(gold, 0).unionByName(sided(predicted, 1)).repartition(scope, *fields)
    nth = F.row_number().over(Window.partitionBy(scope, *fields, "side").orderBy("no"))
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)).cast("long")
    of = lambda n: F.max(F.when(F.col("side") == n, F.col("no")))
    met = rows.withColumn("_nth", nth).groupBy(scope, *fields, "_nth").agg(of(0).alias("gold_no"), of(1).alias("predicted_no"))
    met = met.select(scope, "gold_no", "predicted_no", filled.alias("weight"), F.array(*[F.col(f).cast("string") for f in fields]).alias("cells"))
    # a null scope pairs equal rows, and links no others
    met = stored(met.where("weight > 0"))
    exact = met.where("gold_no is not null and predicted_no is not null").select(scope, "gold_no", "predicted_no", "weight")
    left = met.where("gold_no is null or predicted_no is null").select(scope, F.when(F.col("gold_no").isNull(), 1).otherwise(0).alias("side"), F.coalesce("gold_no", "predicted_no").alias("no"), "cells").where(F.col(scope).isNotNull())
    kind = dict(gold.dtypes)[scope]
    schema = f"{scope} {kind}, gold_no long, predicted_no long, weight long"

    def solve(key: tuple, group: pd.DataFrame) -> list[tuple]:
        return [(key[0], *pair) for pair in _paired(list(zip(group["side"], group["no"], group["cells"], strict=True)))]

    large = stored(left.groupBy(scope).count().where(F.col("count") > SCOPE_ROWS).select(scope))
    if large.isEmpty():
        return exact.unionByName(_solved_scopes(left, scope, schema))
    small = left.join(large, scope, "left_anti")
    nodes = stored(left.join(large, scope, "left_semi").withColumn("node", F.monotonically_increasing_id()))
    # a value that both sides have links its rows to the smallest of them
    values = nodes.select("node", "side", scope, F.posexplode("cells").alias("field", "value")).where("value is not null")
    hubs = values.groupBy(scope, "field", "value").agg(F.min("node").alias("hub"), F.min("side").alias("first"), F.max("side").alias("last")).where("first < last")
    edges = stored(values.join(hubs, [scope, "field", "value"]).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    linked = components(edges)
    linked = linked.union(linked.select(F.col("component").alias("node"), "component").distinct())
    parts = stored(nodes.join(linked, "node"))
    rest = solved(parts.select(scope, "component", "side", "no", "cells"), [scope, "component"], ["side", "no"], solve, schema)
    return exact.unionByName(_solved_scopes(small, scope, schema)).unionByName(rest)


def _solved_scopes(left: DataFrame, scope: str, schema: str) -> DataFrame:
    """The pairs of scopes that a task can hold, one scope behind the other in sorted partitions."""
    dealt = left.repartition(scope).sortWithinPartitions(scope, "side", "no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        last, held = None, []

        def pairs() -> list[tuple]:
            return [(last, *pair) for part in _linked(held) for pair in _paired([held[i] for i in part])]

        for frame in frames:
            out = []
            for key, side, no, cells in zip(frame[scope], frame["side"], frame["no"], frame["cells"], strict=True):
                if held and key != last:
                    out += pairs()
                    held = []
                last = key
                held.append((side, no, tuple(cells)))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(pairs(), columns=names)

    return dealt.mapInPandas(run, schema)


def duplicates(df: DataFrame, keys: list[str], fingerprint: Column) -> DataFrame:
    """Per key: how many fingerprints occur more than once, and how many rows are surplus."""
    per = df.withColumn("_f", fingerprint).groupBy(*keys, "_f").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("extra_rows"))


def set_alignment(gold: DataFrame, predicted: DataFrame, scope: str, member: str) -> DataFrame:
    """Per scope, the sets of members compared: tp, fp, fn, and whether they are equal."""
    g = gold.select(scope, member).distinct().withColumn("g", F.lit(True))
    p = predicted.select(scope, member).distinct().withColumn("p", F.lit(True))
    both = g.join(p, [scope, member], "full")
    out = both.groupBy(scope).agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return out.withColumn("exact", (F.col("fp") == 0) & (F.col("fn") == 0))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows either side has beyond the other, as multisets; two equal contents give 0 and 0."""
    count = lambda x, y, side: x.exceptAll(y).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(a, b, "only_first").unionByName(count(b, a, "only_second"))


def conflicts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that both sides have with different values: a merge reports these and picks none."""
    x, y = a.select(key, F.col(value).alias("first_value")), b.select(key, F.col(value).alias("second_value"))
    return x.join(y, key).where(~F.col("first_value").eqNullSafe(F.col("second_value")))


def latencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and nearest-rank 95th percentile."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.median(value), 6).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.max(value).alias("most")
    )


def distribution(rows: DataFrame, keys: list[str], warning: str) -> DataFrame:
    """keys, category, n, share: how the warnings' categories are distributed."""
    per = rows.groupBy(*keys, warning_category(F.col(warning)).alias("category")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


def recommended(scores: DataFrame, key: str, option: str, *order: Column) -> DataFrame:
    """The best option of each key by the scores in order; ties go to the smaller option."""
    w = Window.partitionBy(key).orderBy(*order, option)
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chosen_routes(scores: DataFrame, key: str, routes: tuple[str, ...], final: bool = True) -> DataFrame:
    """key, status, route, tie_break: the route of each key by scores (key, route, status, field_score, record_score, exact_rate, duplicates,
    requests), one row per key and route.

    The best has the highest lesser of the two scores, then the highest mean, then the highest rate (tie_break `quality`); of equal ones the
    fewest duplicates, then the fewest requests, then the first of `routes`. Without both scores a route comes last; null rates
    and requests are 0, null duplicates last. `blocked` unless every route is done; `pending` unless the stage is final."""
    both = F.col("field_score").isNotNull() & F.col("record_score").isNotNull()
    down = lambda c: -F.when(both, c.cast("double")).otherwise(F.lit(float("-inf")))
    quality = F.struct(down(F.least("field_score", "record_score")).alias("least"), down((F.col("field_score") + F.col("record_score")) / 2).alias("mean"), down(F.coalesce("exact_rate", F.lit(0))).alias("rate"))
    place = F.array_position(F.array(*map(F.lit, routes)), F.col("route"))
    duplicates = F.coalesce(F.col("duplicates").cast("long"), F.lit(2**63 - 1))
    row = F.struct(quality.alias("quality"), duplicates.alias("duplicates"), F.coalesce(F.col("requests").cast("long"), F.lit(0)).alias("requests"), place.alias("place"), "route")
    done = F.count_distinct(F.when(F.col("status") == "done", F.col("route"))) == len(routes)
    # a group has no more rows than there are routes
    per = scores.where(F.col("route").isin(*routes)).groupBy(key).agg(done.alias("_done"), F.array_sort(F.collect_set(row)).alias("_rows"))
    first, second = F.get("_rows", F.lit(0)), F.get("_rows", F.lit(1))
    how = F.when(second.isNull() | (first["quality"] != second["quality"]), "quality").when(first["duplicates"] != second["duplicates"], "duplicates").otherwise("requests")
    ready = F.col("_done") & F.lit(final)
    status = F.when(~F.lit(final), "pending").when(~F.col("_done"), "blocked").otherwise("determined")
    return per.select(key, status.alias("status"), F.when(ready, first["route"]).alias("route"), F.when(ready, how).alias("tie_break"))
