"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed lower-case terms. The score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: besides its own weight each term has a factor vector,
so a pair such as an insult and a group mention may count for more (or less) than its parts.

Learning uses at most about ``SAMPLE_ROWS`` labelled rows, picked by a hash of their id. Terms are
kept if their counts among the two classes differ beyond chance, or if they do so among the rows that
hold one of the ``LEADS`` most telling terms: a group word may say nothing alone and much beside an
insult. Counts are made by Spark, and only the kept buckets of a row come to the driver. A pair neither
of whose terms tells anything alone is not found. Scoring reads every whole text.

Null and empty texts have no terms and get the score of the bias. Labels that are null are ignored;
a document with several labels takes the largest. Without labelled rows of both classes the score
is the share of positive labels, or 0 without any. Repeated rows get equal scores; extra columns
stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.session import stage_table

BUCKETS = 1 << 20
SAMPLE_ROWS = 24_000
MAX_TERMS = 2_048
MIN_ROWS = 8
MIN_CHI2 = 20.0
# terms beside which others are tested, and the limit for so many more tests
LEADS = 64
MIN_PAIR_CHI2 = 40.0
FACTORS = 8
STEMS = (4, 5, 6)
THRESHOLD = 0.3


def term_buckets(text: Column) -> Column:
    """Distinct buckets of a text's terms: runs of letters, lower case, and their stems.

    Stems are the first four, five and six letters, so that inflected forms share a bucket.
    """
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\P{L}+", " "))
    terms = F.array_distinct(F.split(plain, " "))
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")

    def stem(k: int) -> Column:
        # a word that is no longer than the stem keeps its own bucket
        return F.transform(terms, lambda w: F.when(F.length(w) > k, bucket(F.substring(w, 1, k), F.lit(k))).otherwise(bucket(w)))

    return F.array_distinct(F.flatten(F.array(F.transform(terms, lambda w: bucket(w)), *map(stem, STEMS))))


@dataclass
class FactorMachine:
    buckets: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities; ``at`` are places in ``buckets``, row r has at[starts[r]:starts[r+1]]."""
        rows = len(starts) - 1
        row = np.repeat(np.arange(rows), np.diff(starts))
        linear = np.bincount(row, self.weights[at], rows)
        pairs = np.zeros(rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            pairs += np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def fit(rows: list[list[int]], labels: list[int], terms: int, epochs: int = 40, rate: float = 0.1, decay: float = 2e-4, seed: int = 11) -> tuple:
    """Bias, weights and factors by AdaGrad on the logistic loss, in minibatches."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    b, w = float(np.log(prior / (1 - prior))), np.zeros(terms)
    v = rng.normal(0, 0.05, (terms, FACTORS))
    gb, gw, gv = 1e-8, np.full(terms, 1e-8), np.full((terms, FACTORS), 1e-8)
    sizes = np.array([len(r) for r in rows])
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 256)):
            n = sizes[batch]
            row = np.repeat(np.arange(len(batch)), n)
            shift = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = flat[np.arange(n.sum()) - np.repeat(shift, n) + np.repeat(starts[batch], n)]
            va = v[at]
            total = np.zeros((len(batch), FACTORS))
            np.add.at(total, row, va)
            pairs = (total**2).sum(1) - np.bincount(row, (va * va).sum(1), len(batch))
            z = b + np.bincount(row, w[at], len(batch)) + pairs / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            dw = np.bincount(at, g[row], terms) + decay * w * (len(batch) / len(rows)) ** 0.5
            dv = np.zeros_like(v)
            np.add.at(dv, at, g[row, None] * (total[row] - va))
            dv += decay * v
            db = g.sum()
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            b -= rate * db / np.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return b, w, v


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorMachine:
    """A machine from the labelled rows of ``labels`` that have a text in ``docs``."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    y = y.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        prior = float(next(iter(counts), 0)) if total else 0.0
        none = np.zeros(0)
        return FactorMachine(none.astype(np.int64), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), none, np.zeros((0, FACTORS)))
    step = max(1, -(-total // SAMPLE_ROWS))
    picked = y.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(step)) == 0).limit(2 * SAMPLE_ROWS)
    ids = {r["id"]: r["y"] for r in picked.collect()}
    # a bounded table by now, so it may travel
    spark = docs.sparkSession
    sample = spark.createDataFrame(sorted(ids.items()), f"id {dict(labels.dtypes)[id_col]}, y int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = stage_table(rows.select("id", "y", term_buckets(F.col("text")).alias("terms")), "toxic-sample")
    sums = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = sums["n"], sums["p"] or 0
    by = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("a"))
    chi2 = _chi2(F.lit(float(n)), F.lit(float(p)))
    own = by.where((F.col("n") >= MIN_ROWS) & (F.col("n") < n)).withColumn("chi2", chi2)
    own = own.where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "t").limit(MAX_TERMS).collect()
    kept = {r["t"] for r in own} | _beside(rows, _leads(own, n, p))
    buckets = np.array(sorted(kept), dtype=np.int64)
    chosen = F.array(*[F.lit(int(x)) for x in buckets]).cast("array<int>")
    data = rows.select("id", "y", F.array_intersect("terms", chosen).alias("terms")).orderBy("id", "terms").collect()
    places = [np.searchsorted(buckets, sorted(r["terms"])).tolist() for r in data]
    bias, w, v = fit(places, [r["y"] for r in data], len(buckets))
    return FactorMachine(buckets, bias, w, v)


def _chi2(rows: Column, positive: Column) -> Column:
    """Of a term in ``n`` rows, ``a`` of them positive, among ``rows`` with ``positive`` positive ones; 0 if either class is empty."""
    n, a = F.col("n").cast("double"), F.col("a").cast("double")
    cross = a * (rows - positive - n + a) - (n - a) * (positive - a)
    spread = n * (rows - n) * positive * (rows - positive)
    return F.when(spread > 0, rows * cross * cross / spread).otherwise(0.0)


def _leads(own: list, rows: int, positive: int) -> list[tuple[int, int, int]]:
    """(term, rows, positive rows) of the most telling terms that at least double the odds of a positive label.

    A word and its stems that stand in as many rows of each class are one lead.
    """
    found = {}
    for r in own:
        if r["a"] * (rows - positive) >= 2 * (r["n"] - r["a"]) * positive:
            found.setdefault((r["n"], r["a"]), r["t"])
    return [(t, n, a) for (n, a), t in list(found.items())[:LEADS]]


def _beside(rows: DataFrame, leads: list[tuple[int, int, int]]) -> set[int]:
    """At most ``MAX_TERMS`` terms whose presence changes the labels of the rows that hold a lead."""
    if not leads:
        return set()
    chosen = F.array(*[F.lit(t) for t, _, _ in leads]).cast("array<int>")
    sizes = rows.sparkSession.createDataFrame(leads, "lead int, held int, hit int")
    pairs = rows.select("y", "terms", F.explode(F.array_intersect("terms", chosen)).alias("lead"))
    pairs = pairs.select("y", "lead", F.explode("terms").alias("t")).groupBy("lead", "t").agg(F.count("*").alias("n"), F.sum("y").alias("a"))
    pairs = pairs.where(F.col("n") >= MIN_ROWS).join(F.broadcast(sizes), "lead")
    pairs = pairs.withColumn("chi2", _chi2(F.col("held").cast("double"), F.col("hit").cast("double")))
    best = pairs.where(F.col("chi2") >= MIN_PAIR_CHI2).groupBy("t").agg(F.max("chi2").alias("chi2"))
    return {r["t"] for r in best.orderBy(F.desc("chi2"), "t").limit(MAX_TERMS).collect()}


def score(docs: DataFrame, model: FactorMachine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; only the few learnt buckets of a text leave the JVM."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for terms in batches:
            values = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            yield pa.array(model.scores(starts, np.searchsorted(model.buckets, values)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    chosen = F.array(*[F.lit(int(x)) for x in model.buckets]).cast("array<int>")
    df = docs.drop("score", "predicted")
    # sorted, so that equal sets add up in the same order
    hits = F.sort_array(F.array_intersect(term_buckets(F.col(text_col)), chosen))
    df = df.withColumn("score", F.arrow_udf(run, "double")(hits))
    return df.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
