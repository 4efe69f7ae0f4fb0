"""Best historical match of each new row, and copying its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gregale.operators.similarity import candidate_pairs, candidate_terms, edit_distance, first_candidates
from gregale.operators.storing import stored


def threshold_for(key: Column, prefixes: dict[str, float], default: float) -> Column:
    """The threshold of the first prefix that key begins with."""
    out = F.lit(default)
    for prefix, value in reversed(list(prefixes.items())):
        out = F.when(key.startswith(prefix), value).otherwise(out)
    return out


def ratio(old: Column, new: Column) -> Column:
    """Similarity by edit distance, over the old text's length; below 0 for far longer new texts."""
    return (F.length(old) - edit_distance(old, new)) / F.length(old)


def best_match(scored: DataFrame) -> DataFrame:
    """(new_id, old_id, ratio) from (new_id, old_id, old_pos, ratio, least, answer, time).

    Candidates are met in old_pos order. One whose ratio suffices takes the lead if the leader's answer is empty and its own isn't,
    or if it is newer; so a newer one without an answer can displace one with an answer, as the order decides. Candidates stream by,
    sorted, and only the leader is kept, so that a row may have any number of them.
    """
    order = ["new_id", "old_pos", "old_id", "ratio", "size", "time"]
    rows = scored.where(F.col("ratio") >= F.col("least")).select(
        F.col("new_id").cast("long").alias("new_id"), F.col("old_pos").cast("long").alias("old_pos"), F.col("old_id").cast("long").alias("old_id"), F.col("ratio").cast("double").alias("ratio"),
        F.length(F.coalesce("answer", F.lit(""))).alias("size"), F.col("time").cast("long").alias("time"),
    )
    rows = rows.repartition("new_id").sortWithinPartitions(*order).select("new_id", "old_id", "ratio", "size", "time")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["new_id", "old_id", "ratio"]
        best: tuple | None = None
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if best is None or best[0] != row[0]:
                    if best is not None:
                        done.append(best[:3])
                    best = row
                elif (best[3] == 0 and row[3] > 0) or best[4] is None or (row[4] is not None and row[4] > best[4]):
                    best = row
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=names)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[i]], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=names)

    return rows.mapInArrow(run, "new_id long, old_id long, ratio double")


def of_first_project(old: DataFrame, new: DataFrame, id_col: str, project_col: str = "origin_project") -> DataFrame:
    """Old rows of the project of the first new row.

    In a store that is partitioned by project, only that project's files are read: the one row is broadcast, and its comparison with
    a text, which any project passes, is what Spark takes it for selective by.
    """
    first = new.agg(F.min_by(project_col, id_col).alias("_project")).where(F.col("_project") >= "")  # one row
    return old.join(F.broadcast(first), F.col(project_col) == F.col("_project")).drop("_project")


#: Which old rows a column's search looks at: (old, new, id column) -> old rows. Add to it for other filters.
ColumnFilter = Callable[[DataFrame, DataFrame, str], DataFrame]


def matches(old: DataFrame, new: DataFrame, column: str, block: list[str], least: float, ratio_least: float, overrides: dict[str, float], id_col: str) -> DataFrame:
    """(new_id, old_id, ratio): each new row's best match in the old rows (timestamp, Réponse, column, block) by the column.

    Candidates reach the cosine `least` in their block; their ratio must reach ratio_least, or what overrides says of the new text's beginning.
    Texts are compared once, however many rows have them, and new rows of a text have one match. Where all old rows have an answer and
    a time, a newer one takes the lead and nothing else does: each new text tries old ones, the newest first, until one is near enough.
    Else the order decides, and all near pairs meet in it.
    """
    both = [df.select((F.col(id_col) * 2 + i).alias("__id"), *block, F.col(column).alias("__text")) for i, df in enumerate((old, new))]  # ids of both may be equal
    terms, classes = candidate_terms(*both, block, "__id", "__text", least)
    classes = stored(classes.select("first", F.shiftright("id", 1).alias("id"), (F.col("id") % 2).alias("new")))
    told = old.select(F.col(id_col).alias("id"), F.col("Réponse").alias("answer"), F.col("timestamp").cast("long").alias("time"))
    found = classes.where("new = 0").select(F.col("first").alias("b"), "id").join(told, "id")
    enough = threshold_for(F.col("__text"), overrides, ratio_least).cast("double").alias("least")
    if not told.where("coalesce(answer, '') = '' OR time IS NULL").take(1):
        # of a text's rows, the first of the newest
        found = found.groupBy("b").agg(F.max_by(F.struct("id", "answer", "time"), F.struct("time", -F.col("id"))).alias("m")).select("b", "m.*")
        o, n = both
        o = o.join(found.select(F.col("b").alias("__id"), "time", F.col("id").alias("old_pos")), "__id")
        n = n.select("*", F.lit(None).cast("long").alias("time"), F.lit(None).cast(found.schema["id"].dataType).alias("old_pos"))
        texts = o.unionByName(n).select(F.col("__id").alias("id"), F.col("__text").alias("text"), enough, "time", "old_pos")
        near = first_candidates(terms, texts, least, [F.desc("time"), F.asc("old_pos")]).join(n.select(F.col("__id").alias("a"), enough), "a")
    else:
        o, n = both
        near = candidate_pairs(terms, least).join(n.select(F.col("__id").alias("a"), F.col("__text").alias("new_text"), enough), "a").join(o.select(F.col("__id").alias("b"), F.col("__text").alias("old_text")), "b")
        near = near.select("a", "b", ratio(F.col("old_text"), F.col("new_text")).alias("ratio"), "least").where(F.col("ratio") >= F.col("least"))
    rows = near.join(found, "b").select(F.col("a").alias("new_id"), F.col("id").alias("old_id"), F.col("id").alias("old_pos"), "ratio", "least", "answer", "time")
    best = best_match(rows).withColumnRenamed("new_id", "first")
    return classes.where("new = 1").join(best, "first").select(F.col("id").alias("new_id"), "old_id", "ratio")


def merge_matches(by_column: list[tuple[str, DataFrame]]) -> DataFrame:
    """(new_id, old_id, ratio, column): the match of the highest ratio over columns; of equals the column named first."""
    all_matches = None
    for i, (name, matches) in enumerate(by_column):
        rows = matches.select("new_id", "old_id", "ratio", F.lit(name).alias("column"), F.lit(-i).alias("order"))
        all_matches = rows if all_matches is None else all_matches.unionByName(rows)
    best = all_matches.groupBy("new_id").agg(F.max_by(F.struct("old_id", "ratio", "column"), F.struct("ratio", "order")).alias("m"))
    return best.select("new_id", "m.*")


@dataclass(frozen=True)
class Copy:
    """A column to copy; with a condition, only values that contain it, in any case."""

    column: str
    enabled: bool = True
    condition: str | None = None


def copy_columns(target: DataFrame, old: DataFrame, matches: DataFrame, copies: list[Copy], overwrite: bool = True) -> DataFrame:
    """target (id, Commentaires, ...) with columns copied from each row's match, and a comment that says where from.

    old: (id, num, lecture, organe, project, and the copied columns). A null is copied even under a condition. The comment names
    all enabled columns, whether copied or not.
    """
    on = [c for c in copies if c.enabled]
    names = [c.column for c in on if c.column in old.columns]
    source = old.select(F.col("id").alias("old_id"), "num", "lecture", "organe", "project", *[F.col(c).alias(f"old_{c}") for c in names])
    rows = target.join(matches.select(F.col("new_id").alias("id"), F.col("old_id").alias("_old"), "column"), "id", "left")
    rows = rows.join(source, rows["_old"] == source["old_id"], "left")
    found, note = F.col("old_id").isNotNull(), F.concat(
        # fixed values: the comment's wording
        F.lit(f"Copie de {', '.join(c.column for c in on)} depuis : "), F.coalesce("project", F.lit("Projet inconnu")),
        F.lit("\nNuméro d'amendement : "), F.coalesce(F.col("num").cast("string"), F.lit("")), F.lit("\nLecture : "), F.coalesce("lecture", F.lit("")),
        F.lit("\nOrgane : "), F.coalesce("organe", F.lit("")), F.lit("\nColonne similaire : "), F.col("column"),
    )
    values = {}
    for c in on:
        if c.column not in names:
            continue
        was, now = F.col(f"old_{c.column}"), F.col(c.column) if c.column in target.columns else F.lit(None).cast("string")
        free = found if overwrite else found & F.coalesce(F.trim(now.cast("string")) == "", F.lit(True))
        if c.condition is not None:
            holds = F.contains(F.lower(was.cast("string")), F.lit(c.condition.lower()))
            note = F.concat(note, F.when(free & was.isNotNull() & holds, F.concat(F.lit(f"\n{c.column} copié : "), was.cast("string"))).otherwise(""))
            free = free & (was.isNull() | holds)
        values[c.column] = F.when(free, was).otherwise(now)
    comment = F.when(found, F.concat_ws("\n", F.nullif("Commentaires", F.lit("")), note)).otherwise(F.col("Commentaires"))
    return rows.withColumns(values | {"Commentaires": comment}).select(*dict.fromkeys([*target.columns, *values]))
