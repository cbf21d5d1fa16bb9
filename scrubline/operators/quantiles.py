"""Exact quantiles without holding a column in one task.

``percentile`` keeps every distinct value of a group in one hash map. Here a
sketch brackets each wanted rank, and a pass counts the values below and inside each
bracket, which proves that the rank lies inside, whatever the sketch did. Wide brackets
are narrowed by a sketch of their inside, and only brackets of at most ``GATHER`` rows or of
one value come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.session import stage_table

ACCURACY = 10_000
# values of one bracket that may come to the driver
GATHER = 5_000

Requests = Mapping[str, tuple[Column, list[float]]]


def exact_quantiles(df: DataFrame, requests: Requests) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns at once.

    ``requests`` maps a name to (double column, probabilities); NULLs are ignored. The wanted columns are staged, so
    that the three or four passes over them read numbers and do not evaluate the frame's plan again.
    """
    if not requests:
        return {}
    names = list(requests)
    values = stage_table(df.select(*[requests[n][0].cast("double").alias(f"x{i}") for i, n in enumerate(names)]), "quantile-columns")
    probs = [requests[n][1] for n in names]
    counts, brackets = _bracket(values, probs, ACCURACY)
    answers: dict[tuple[int, int], float | None] = {}
    todo = {}
    for i, ps in enumerate(probs):
        for j, p in enumerate(ps):
            if counts[i] == 0:
                answers[i, j] = None
            else:
                todo[i, j] = brackets[i, j]
    while todo:
        below, inside, narrower = _count(values, counts, probs, todo)
        ready, again = {}, {}
        for k, (lo, hi) in todo.items():
            first, last = _positions(counts, probs, k)
            if not below[k] <= first <= last < below[k] + inside[k]:
                # the rank is outside its bracket (sketch error): look again around it
                again[k] = _widen((lo, hi))
            elif lo == hi:
                answers[k] = lo
            elif inside[k] <= GATHER or narrower[k] in ((lo, hi), None):
                ready[k] = (lo, hi)
            else:
                again[k] = narrower[k]
        answers.update(_gather(values, counts, probs, ready, below))
        todo = again
    return {n: [answers[i, j] for j in range(len(probs[i]))] for i, n in enumerate(names)}


def _bracket(values: DataFrame, probs: list[list[float]], accuracy: int):
    slack = 2 / accuracy
    aggs = []
    for i, ps in enumerate(probs):
        around = [q for p in ps for q in (max(0.0, p - slack), min(1.0, p + slack))]
        aggs += [
            F.count(f"x{i}").alias(f"n{i}"),
            F.percentile_approx(f"x{i}", around, accuracy).alias(f"q{i}"),
        ]
    row = values.agg(*aggs).first()
    brackets = {}
    for i, ps in enumerate(probs):
        for j in range(len(ps)):
            if row[f"n{i}"]:
                brackets[i, j] = (row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1])
    return [row[f"n{i}"] for i in range(len(probs))], brackets


def _widen(bracket: tuple[float, float]) -> tuple[float, float]:
    lo, hi = bracket
    margin = max(hi - lo, 1e-9 * max(abs(lo), abs(hi), 1.0)) * 16
    return lo - margin, hi + margin


def _positions(counts, probs, k) -> tuple[int, int]:
    position = probs[k[0]][k[1]] * (counts[k[0]] - 1)
    return math.floor(position), math.ceil(position)


def _count(values, counts, probs, todo):
    """Per wanted rank: rows below its bracket, rows inside, and a narrower bracket by a sketch of the inside."""
    aggs = []
    for n, ((i, _), (lo, hi)) in enumerate(todo.items()):
        x = F.col(f"x{i}")
        inside = (x >= lo) & (x <= hi)
        aggs += [F.count_if(x < lo).alias(f"b{n}"), F.count_if(inside).alias(f"c{n}")]
    row = values.agg(*aggs).first()
    below = {k: row[f"b{n}"] for n, k in enumerate(todo)}
    inside = {k: row[f"c{n}"] for n, k in enumerate(todo)}
    aggs = []
    for n, (k, (lo, hi)) in enumerate(todo.items()):
        if inside[k] > GATHER and lo < hi:
            x, (first, last) = F.col(f"x{k[0]}"), _positions(counts, probs, k)
            around = [max(0.0, (first - below[k]) / inside[k] - 2 / ACCURACY), min(1.0, (last - below[k] + 1) / inside[k] + 2 / ACCURACY)]
            aggs.append(F.percentile_approx(F.when((x >= lo) & (x <= hi), x), [max(0.0, min(1.0, p)) for p in around], ACCURACY).alias(f"q{n}"))
    row = values.agg(*aggs).first().asDict() if aggs else {}
    narrower = {k: tuple(row[f"q{n}"]) if row.get(f"q{n}") else None for n, k in enumerate(todo)}
    return below, inside, narrower


def _gather(values, counts, probs, ready, below) -> dict[tuple[int, int], float]:
    """The wanted values of brackets that hold few rows, or few different values."""
    if not ready:
        return {}
    cells = []
    for n, ((i, _), (lo, hi)) in enumerate(ready.items()):
        x = F.col(f"x{i}")
        cells.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(n).alias("k"), x.alias("x"))))
    some = values.select(F.filter(F.array(*cells), lambda c: c.isNotNull()).alias("c")).where(F.size("c") > 0)
    seen: dict[int, list[tuple[float, int]]] = {n: [] for n in range(len(ready))}
    for k, x, n in some.select(F.explode("c").alias("c")).groupBy("c.k", "c.x").count().collect():
        seen[k].append((x, n))
    found = {}
    for n, k in enumerate(ready):
        position = probs[k[0]][k[1]] * (counts[k[0]] - 1)
        lower, upper = _positions(counts, probs, k)
        a, b = (_at_rank(seen[n], rank - below[k]) for rank in (lower, upper))
        found[k] = a if lower == upper else a + (b - a) * (position - lower)
    return found


def ranked_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float]:
    """Many exact quantiles of one column, by ranks of its sorted different values.

    Values are range-partitioned; one sum per partition and the wanted values reach the driver.
    """
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    parts = stage_table(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranks")
    total, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in parts.groupBy("part").agg(F.sum("n")).collect()):
        starts.append((part, total))
        total += n
    if not total:
        return []
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    ranked = parts.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("upto", F.col("start") + upto)
    ranked = ranked.select("x", (F.col("upto") - F.col("n")).alias("since"), "upto")
    wanted = sorted({f(p * (total - 1)) for p in probs for f in (math.floor, math.ceil)})
    ranks = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("since")) & (w < F.col("upto")))
    at = {r["w"]: r["x"] for r in ranked.select("x", F.explode(ranks).alias("w")).collect()}
    out = []
    for p in probs:
        position = p * (total - 1)
        a, b = at[math.floor(position)], at[math.ceil(position)]
        out.append(a + (b - a) * (position - math.floor(position)))
    return out


def _at_rank(pairs: list[tuple[float, int]], rank: int) -> float | None:
    if rank < 0:
        return None
    for x, n in sorted(pairs):
        if rank < n:
            return x
        rank -= n
    return None
