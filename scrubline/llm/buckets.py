"""From colliding band keys to components of verified links, without all pairs of a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.graph import components
from scrubline.session import stage_table

GROWTH = 8
# a blob of at least this many ids is compared by SALTS tasks
LARGE = 500
SALTS = 16
# tables of up to this many rows of two numbers travel to every executor
SMALL_ROWS = 500_000


def jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose distinct shingles overlap enough; ``sets`` has (id, n, s)."""
    near = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
    near = near.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    # sets whose sizes differ more can't be that similar
    near = near.where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb"))
    near = near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    near = near.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    near = near.where(shared >= F.lit(similarity) * (F.col("na") + F.col("nb") - shared))
    return near.select(*pairs.columns)


def linked(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(id, component) of the graph of all pairs that share a bucket and are similar enough.

    ``members`` has distinct (key, id), ``sets`` (id, n, s) with the n distinct shingles of each id.
    Each bucket first compares everything with its least id, one pair for each member. Buckets that
    then still hold several components are joined into blobs (components of the shared buckets), so that
    an id and its shingles are one row. Members of a blob, picked by hash, are compared with the
    members of other components, eight times as many in each round, until the blob is one
    component or all pairs between its components have been compared: no link is lost. The comparison
    is the condition of the join, so only links come out of it, and a large blob is split over tasks.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = stage_table(members.join(counts, "key"), "crowd")
    crowd = crowd.join(crowd.groupBy("key").agg(F.min("id").alias("lead")), "key")
    pairs = crowd.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    label = stage_table(components(jaccard_links(pairs, sets, similarity)), "labels")
    # all pairs of a bucket of two have been compared
    wide = _labelled(crowd.where("n > 2"), label)
    split = wide.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    wide = wide.join(split.select("key"), "key", "left_semi")
    blobs = components(wide.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    blobs = stage_table(blobs.withColumnRenamed("component", "blob"), "blobs")
    own = stage_table(sets.join(blobs, "id"), "open")
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    picked, start = 2 * GROWTH, 0
    while not own.isEmpty():
        own = _labelled(own, label)
        sizes = own.groupBy("blob").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y"))
        sizes = stage_table(sizes.where(f"x <> y and m > {start}").select("blob", "m"), "sizes")
        own = stage_table(own.join(small(sizes), "blob"), "open")
        pivots = own.where((place >= F.lit(float(start)) / F.col("m")) & (place < F.lit(float(picked)) / F.col("m")))
        label = _merge(label, components(_links_in_blobs(pivots, own, similarity), "low", "high"))
        own = own.drop("m", "component")
        picked, start = picked * GROWTH, picked
    return label


def _links_in_blobs(pivots: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """(low, high): pairs of components that a similar pair of a pivot and another member connects."""
    salts = F.when(F.col("m") >= LARGE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = pivots.select("blob", F.explode(salts).alias("salt"), F.col("component").alias("pc"), F.col("n").alias("pn"), F.col("s").alias("ps"))
    salt = F.when(F.col("m") >= LARGE, F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    right = own.select(F.col("blob").alias("b"), salt.alias("t"), "component", "n", "s")
    shared = F.size(F.array_intersect("ps", "s"))
    near = (
        (F.col("blob") == F.col("b")) & (F.col("salt") == F.col("t")) & (F.col("pc") != F.col("component"))
        & (F.least("pn", "n") >= F.lit(similarity) * F.greatest("pn", "n"))
        & (shared >= F.lit(similarity) * (F.col("pn") + F.col("n") - shared))
    )
    return left.join(right, near).select(F.least("pc", "component").alias("low"), F.greatest("pc", "component").alias("high")).distinct()


def small(df: DataFrame) -> DataFrame:
    """A staged table, broadcast if it is known to be short."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component of each id: itself where it has no link."""
    known = small(label).select(F.col("id").alias("__i"), F.col("component").alias("__c"))
    return rows.join(known, F.col("id") == F.col("__i"), "left").withColumn("component", F.coalesce("__c", "id")).drop("__i", "__c")


def _merge(label: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after some components have become one; components may be ids that had no link before."""
    merged = stage_table(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "merged")
    moved = label.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = merged.join(label.select(F.col("id").alias("component")), "component", "left_anti")
    return stage_table(moved.union(new.select(F.col("component").alias("id"), F.col("to").alias("component"))), "labels")
