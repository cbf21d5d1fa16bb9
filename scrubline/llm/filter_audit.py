"""Which of several filters removes what, in every order: coalition counts and exact Shapley values.

Each document is reduced to the set of filters that it fails, and the sets to one count for each part and set. What a
coalition of filters removes is a sum of such counts, so all 32 coalitions give every step of all 120 orders by
differences. The Shapley values come from the same table: they are the least squares fit of an additive game to the
coalition values under the Shapley kernel, with the efficiency constraint, solved in rationals. The system depends on
the number of filters only, so it is solved once, for every unit coalition value, and applied as a column.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.text import words
from scrubline.session import stage_table

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
MARKS = "[#$%&*|]"
# the filter that depends on other documents
COPY = 1 << FILTERS.index("E")
# orders are listed, and coalitions tabulated, for each part
MAX_FILTERS = 6


def shapley_weights(n: int) -> list[list[int]]:
    """n! times the Shapley value of each of ``n`` players, as whole weights of the 2**n coalition values.

    Minimises the kernel-weighted squares of v(S) - v(0) - sum of S's values over all proper coalitions,
    subject to the values summing to v(all) - v(0). The right-hand side has a column for each coalition value.
    """
    if not 1 <= n <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters, not {n}")
    full = (1 << n) - 1
    members = [[i for i in range(n) if s >> i & 1] for s in range(full + 1)]
    system = [[Fraction(0)] * (n + 1 + full + 1) for _ in range(n + 1)]
    for s in range(1, full):
        size = len(members[s])
        weight = Fraction(n - 1, math.comb(n, size) * size * (n - size))
        for i in members[s]:
            for j in members[s]:
                system[i][j] += weight
            system[i][n + 1 + s] += weight
            system[i][n + 1] -= weight
    for i in range(n):
        # the multiplier of the constraint, and the constraint
        system[i][n] = system[n][i] = Fraction(1)
    system[n][n + 1 + full] += 1
    system[n][n + 1] -= 1
    solved = _eliminated(system)
    scaled = [[x * math.factorial(n) for x in row[n + 1 :]] for row in solved[:n]]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def _eliminated(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination of the leading square."""
    rows = [list(r) for r in rows]
    for c in range(len(rows)):
        at = next(r for r in range(c, len(rows)) if rows[r][c])
        rows[c], rows[at] = rows[at], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(len(rows)):
            if r != c and rows[r][c]:
                factor = rows[r][c]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[c], strict=True)]
    return rows


def _failed_alone(w: Column, text: Column) -> Column:
    """Bits of the filters that a text fails whatever the other texts are."""
    fails = [
        F.size(w) < MIN_WORDS,
        F.size(F.array_distinct(w)) * 100 < F.size(w) * DISTINCT_PERCENT,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        text.rlike(MARKS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents of a part that fail exactly the filters in the bits of ``failed``.

    Whole texts; null is empty. A text counts as a copy if a smaller doc_id has the same text anywhere in the table;
    a document without an id is nobody's copy and has no copies or labels. Rows that repeat an id and a text are
    documents of their own, and none of them is the other's copy. A document is good (toxic) if any of its label rows
    says so. Hot texts shrink to a row for each task, part and label before they are shuffled by text.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    cut = plain.withColumn("w", words(F.col("text")))
    digest = cut.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("body"), _failed_alone(F.col("w"), F.col("text")).alias("failed")
    )
    digest = stage_table(digest, "digest")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    no = F.lit(False)
    known = digest.where("doc_id is not null").groupBy("doc_id", "part", "body", "failed").agg(F.count("*").alias("n"))
    known = known.join(marked, "doc_id", "left")
    known = known.select("doc_id", "part", "body", "failed", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    alike = known.groupBy("body", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("body"))
    alike = alike.withColumn("n_first", F.when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0)))
    sets = F.array(
        F.struct(F.col("failed"), F.col("n_first").alias("n")),
        F.struct(F.col("failed").bitwiseOR(COPY).alias("failed"), (F.col("n") - F.col("n_first")).alias("n")),
    )
    counted = alike.select("part", "good", "toxic", F.explode(sets).alias("x")).select("part", "x.failed", "x.n", "good", "toxic")
    nameless = digest.where("doc_id is null").select("part", "failed", F.lit(1).cast("long").alias("n"), no.alias("good"), no.alias("toxic"))
    return (
        counted.where("n > 0")
        .unionByName(nameless)
        .groupBy("part", "failed")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
        )
    )


def coalitions(counts: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, total, removed, good, toxic): what each coalition removes, as arrays indexed by its bits."""
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))).alias("coalition")
    spread = counts.select("part", "failed", "n", "n_good", "n_toxic", every)
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    sums = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(a) for c, a in (("n", "removed"), ("n_good", "good"), ("n_toxic", "toxic"))]
    table = spread.groupBy("part", "coalition").agg(*sums, F.sum("n").alias("total"))
    row = F.sort_array(F.collect_list(F.struct("coalition", "removed", "good", "toxic"))).alias("v")
    gathered = table.groupBy("part").agg(row, F.max("total").alias("total"))
    return gathered.select("part", "total", "v.removed", "v.good", "v.toxic")


def _steps(filters: str) -> list[dict]:
    """Every step of every order with the coalitions before and after it."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    found = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | bit[f]
            found.append({"filter_order": "".join(order), "step": step, "own": filters.index(f), "before": before, "after": after})
            before = after
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns are ignored. Columns:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the removals of
    the step's filter, summed over all orders). An empty table has no parts and gives no rows; a null source is the
    empty part; an order in which nothing is removed is listed with zeros. Nulls, copies and repeated rows: ``failures``.
    """
    n = len(FILTERS)
    game = coalitions(failures(docs, labels))
    weights = F.from_json(F.lit(json.dumps(shapley_weights(n))), "array<array<long>>")
    add = lambda acc, x: acc + x
    value = lambda w: F.aggregate(F.zip_with(w, "removed", lambda a, b: a * b), F.lit(0).cast("long"), add)
    game = game.withColumn("shapley", F.transform(weights, value))
    steps = "array<struct<filter_order:string,step:int,own:int,before:int,after:int>>"
    listed = game.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(_steps(FILTERS))), steps)))
    full = (1 << n) - 1
    at = lambda c, i: F.get(c, i)
    own_bit = F.expr("shiftleft(1, s.own)")
    removed = at("removed", F.col("s.after")) - at("removed", F.col("s.before"))
    return listed.select(
        "part",
        "s.filter_order",
        "s.step",
        (F.col("total") - at("removed", F.col("s.after"))).alias("kept"),
        removed.alias("removed"),
        (at("removed", own_bit) - removed).alias("redundant"),
        (at("removed", F.lit(full)) - at("removed", F.lit(full) - own_bit)).alias("unique_fails"),
        (at("good", F.col("s.after")) - at("good", F.col("s.before"))).alias("good_lost"),
        (at("toxic", F.col("s.after")) - at("toxic", F.col("s.before"))).alias("toxic_lost"),
        at("shapley", F.col("s.own")).alias("shapley"),
    )
