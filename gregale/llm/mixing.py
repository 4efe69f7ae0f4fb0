"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target of words. Whole passes over the source fill it as often as they fit; the rest is filled by a subset of
its documents. That subset is found on counts of documents by exact length: first an even part of each length's count, then one
document of each length from the longest down while it fits, and then a bounded-knapsack dynamic programme over the lengths that
are left closes what remains of the budget as exactly as their sums allow. Documents of one length are picked in seeded order.

Rows meet only as counts by (source, length); documents of a hot length are ranked in buckets of their seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gregale.llm.common import WORD, read

#: Words that the dynamic programme may cover; what remains of a budget beyond them goes to whole documents first.
WINDOW = 1 << 15
#: Documents of one source and length that are ranked together.
BUCKET_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with each source's target: its weight's part of share times all words, at most `most` times its own.

    What is cut off goes to the others by weight until none is above: the uncut ones then stand at one common level per weight,
    and exactly the sources with the smallest most * size / weight are cut. Weights repeat over the sources by code point, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy("level", F.col("source").asc_nulls_last())
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    one = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("level", F.col("cap") / F.col("weight"))
    # level if all from this source on are uncut; of the sources that stay below their own cut, the first sets it, which has the highest
    ranked = ranked.withColumn("common", (F.lit(share) * F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("common", F.max(F.when(F.col("common") <= F.col("level"), F.col("common"))).over(one))
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come closest to the budget without passing it."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    take = np.zeros_like(counts)
    if not budget:
        return take
    take = np.floor(counts * (max(0, budget - WINDOW // 2) / total)).astype(np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= WINDOW:
            break
        more = int(min(counts[i] - take[i], (left - WINDOW // 2) // lengths[i] if lengths[i] else 0))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    # bounded knapsack: item[j] is the last package (length, copies) of the first way found to reach j words
    item = np.full(left + 1, -1, np.int64)
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    packages: list[tuple[int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        size, free = int(lengths[i]), int(counts[i] - take[i])
        if not size or size > left or not free or reached[left]:
            continue
        free, part = min(free, left // size), 1
        while free > 0:
            part = min(part, free)
            weight = part * size
            if weight <= left:
                new = np.zeros(left + 1, bool)
                new[weight:] = reached[: left + 1 - weight]
                new &= ~reached
                item[new] = len(packages)
                reached |= new
                packages.append((int(i), part, weight))
            free -= part
            part *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, part, weight = packages[item[at]]
        take[i] += part
        at -= weight
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ascending=False, kind="stable")
    size, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
    passes = min(int(target // size), 2**31 - 1) if size else 0
    rows = rows.assign(passes=passes, take=fit_counts(rows["size"].to_numpy(), rows["count"].to_numpy(), round(target - passes * size)))
    return rows[["source", "size", "count", "source_size", "target", "passes", "take"]]


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) with size, source_size, target and copies, the number of times the mix takes each.

    Null texts have no words; documents without words are taken as often as their source's whole passes say. A null source is a
    source of its own. Rows of one id and size are ordered by a hash of their texts; equal rows are told apart by no more than their
    place in a bucket, so that either may be taken.
    Columns of docs whose names clash with the new ones are replaced, and those that begin with two underscores left out. A target
    of `most` times the source's size takes every document that often; no document is taken oftener than ceil(most) times.
    """
    new = ["size", "source_size", "target", "copies"]
    sized = docs.select(*[c for c in docs.columns if c not in new and not c.startswith("__")], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("count"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).cast("long").alias("source_size"))
    goals = targets(sizes, weights, share, most)
    plan = (
        counts.join(goals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        .groupBy("source").applyInPandas(_fit_source, "source string, size long, count long, source_size long, target double, passes int, take long")
    )
    plan = plan.withColumnsRenamed({"source": "__s", "size": "__z", "count": "__count", "take": "__take", "passes": "__passes", "source_size": "__source_size", "target": "__target"})
    # ranks within (source, size), in buckets of the seeded hash; only a bucket on the edge needs the order of its rows
    keyed = sized.withColumn("__u", F.xxhash64(F.lit(seed), "doc_id"))
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
    rows = rows.withColumn("__buckets", F.ceil(F.col("__count") / BUCKET_ROWS)).withColumn("__bucket", F.when(F.col("__buckets") <= 1, 0).otherwise(F.floor((F.shiftrightunsigned("__u", 40)) * F.col("__buckets") / F.lit(1 << 24))))
    partly = (F.col("__take") > 0) & (F.col("__take") < F.col("__count"))
    tally = rows.where(partly & (F.col("__buckets") > 1)).groupBy("__s", "__z", "__bucket").count()
    edge = tally.select(F.col("__s").alias("__s2"), F.col("__z").alias("__z2"), F.col("__bucket").alias("__b2"), (F.sum("count").over(Window.partitionBy("__s", "__z").orderBy("__bucket")) - F.col("count")).alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__z", "__bucket").orderBy("__u", "doc_id", F.xxhash64("text"))))
    ranked = ranked.join(edge, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__z") == F.col("__z2")) & (F.col("__bucket") == F.col("__b2")), "left")
    chosen = (F.col("__rank") + F.coalesce("__before", F.lit(0)) <= F.col("__take")).cast("int")
    return ranked.select(*sized.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__passes") + chosen).alias("copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
