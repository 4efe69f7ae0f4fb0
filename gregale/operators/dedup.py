"""Keeping one row per cluster, and giving kept values back to all of its rows.

Tables with an entry for each row are merged with the rows, never broadcast: a file's size says too little of what they are in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _members(df: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """df's rows in clusters (id, cluster), with `cluster`; a column of that name in df is left out."""
    return df.drop("cluster").join(clusters.select(F.col("id").alias(f"_{id_col}"), "cluster").hint("merge"), F.col(id_col) == F.col(f"_{id_col}")).drop(f"_{id_col}")


def keep_one(df: DataFrame, clusters: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """df without the clusters' (id, cluster) rows that come after the first by order; rows outside clusters stay."""
    ranked = _members(df, clusters, id_col).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))
    return df.join(ranked.where("r > 1").select(id_col).hint("merge"), id_col, "left_anti")


def keep_first(df: DataFrame, clusters: DataFrame, id_col: str, pos: str) -> DataFrame:
    return keep_one(df, clusters, id_col, [F.col(pos)])


def keep_newest_longest(df: DataFrame, clusters: DataFrame, id_col: str, pos: str, time_col: str, text_col: str) -> DataFrame:
    """The newest row, then the one with the longest text, then the first."""
    return keep_one(df, clusters, id_col, [F.col(time_col).desc(), F.length(text_col).desc_nulls_last(), F.col(pos)])


def keep_majority_owner(df: DataFrame, clusters: DataFrame, id_col: str, pos: str, owner_col: str, defaults: list[str]) -> DataFrame:
    """The first row of the owner with the most rows, defaults and nulls aside; of equals the owner seen first; else the first row."""
    rows = _members(df, clusters, id_col)
    real = rows.where(F.col(owner_col).isNotNull() & ~F.col(owner_col).isin(defaults))
    votes = real.groupBy("cluster", owner_col).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("seen"))
    chosen = votes.groupBy("cluster").agg(F.max_by(owner_col, F.struct("n", -F.col("seen"))).alias("chosen"))
    kept = rows.join(chosen.hint("merge"), "cluster", "left").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.coalesce(F.col(owner_col) == F.col("chosen"), F.lit(False)).desc(), pos)))
    return df.join(kept.where("r > 1").select(id_col).hint("merge"), id_col, "left_anti")


def group_labels(df: DataFrame, clusters: DataFrame, id_col: str, num_col: str) -> DataFrame:
    """(cluster, label): a cluster's numbers in their own order, joined by commas."""
    rows = clusters.join(df.select(F.col(id_col).alias("id"), F.col(num_col).alias("num")).hint("merge"), "id")
    return rows.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("num")), lambda n: n.cast("string")), ",").alias("label"))


def labels(df: DataFrame, clusters: DataFrame, id_col: str, num_col: str) -> DataFrame:
    """(id, label): each row with its cluster's label."""
    return clusters.join(group_labels(df, clusters, id_col, num_col).hint("merge"), "cluster").select("id", "label")


def populate(df: DataFrame, clusters: DataFrame, id_col: str, pos: str, columns: list[str]) -> DataFrame:
    """df with columns taken, in each cluster, from the row with the most non-null values, the first of equals."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    rows = _members(df, clusters, id_col)
    best = rows.groupBy("cluster").agg(F.max_by(F.struct(*columns), F.struct(filled, -F.col(pos))).alias("best"))
    given = clusters.join(best.hint("merge"), "cluster").select(F.col("id").alias("_id"), "best")
    out = df.join(given.hint("merge"), df[id_col] == F.col("_id"), "left")
    return out.select(*[F.when(F.col("_id").isNotNull(), F.col(f"best.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
