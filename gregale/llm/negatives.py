"""Hard negatives: for each anchor and each of its positives, near rows of other labels, by a full sort of integer scores.

An anchor's scores of all rows are sorted by score and id; a positive's upper limit is found in that order by binary search, and the
entries of other labels that follow are read until k are found or the lower limit is passed. Scores are integers, so that order,
limits and ties are exact.

Anchors are a stated query set that meets all rows, block by block: a task holds ANCHOR_CELLS components of anchors, which one pass over
the rows sends to all tasks, and BLOCK rows at a time, whose scores it sorts for each anchor. The best k of a block are merged with the
best k of the task's earlier blocks, and those of all tasks by a window with a rank limit; the best k of all rows are among them, so
that results are whole. Each block of anchors takes two passes, the first for the positives, and its result is written before the next
begins. Scores of all pairs exist inside tasks only, a tile at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gregale.llm.common import Scratch, read

#: Components of the anchors of one block (8 MB of numbers).
ANCHOR_CELLS = 1 << 20
#: Rows whose scores are sorted at once.
BLOCK = 4096
#: Scores of a tile, and components of a block, at most.
TILE, BLOCK_CELLS = 1 << 20, 1 << 22
_OUT = "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"


class Block:
    """Rows in the order of their ids, those without one last: ids, whether there is one, labels, and vectors filled up with zeros."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.known, self.labels, self.vectors = ids, known, labels, vectors


def arrays(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, ...]:
    """The arrays of a Block."""
    known, own = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((own, ~known))
    return own[order], known[order], labels.to_numpy(zero_copy_only=False)[order], matrix[order]


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Block]:
    """Batches of (id, label, vector) in blocks of so many rows, fewer where vectors are long."""
    held: list[pa.RecordBatch] = []
    n, width = 0, 1

    def close() -> Block:
        return Block(*arrays(*[pa.concat_arrays([h.column(i) for h in held]) for i in range(3)]))

    for batch in batches:
        wide = max(1, pc.max(batch.column(2).value_lengths()).as_py() or 0)
        step = max(1, min(rows, BLOCK_CELLS // wide))
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            if held and (n + len(part) > rows or (n + len(part)) * max(wide, width) > BLOCK_CELLS):
                yield close()
                held, n, width = [], 0, 1
            held.append(part)
            n, width = n + len(part), max(width, wide)
    if held:
        yield close()


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact; components that one side lacks count as 0. Scores of 2^56 or more are an error."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    most = width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)  # all sums are whole numbers below 2^53
    if most >= 1 << 56:
        raise ValueError("components are too large for whole scores")
    return a @ b.T


def tiles(anchors: Block, rows: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, its scores of the rows in order, the rows in order): larger scores first, ties by smaller ids, rows without an id last.

    Places in the block are in the order of ids, and stand for them.
    """
    places = np.arange(len(rows.ids))
    step = max(1, TILE // max(1, len(rows.ids)))
    for lo in range(0, len(anchors.ids), step):
        found = scores(anchors.vectors[lo : lo + step], rows.vectors)
        order = np.lexsort((np.broadcast_to(places, found.shape), -found), axis=-1)
        for i in range(len(found)):
            yield lo + i, found[i][order[i]], order[i]


def first_positives(anchors: Block, rows: Iterator[Block], n: int) -> dict[int, list[tuple[int, bool, int]]]:
    """By anchor: (-score, has no id, id) of the first n other rows of its label, in order."""
    best: dict[int, list] = {}
    for block in rows:
        for a, found, order in tiles(anchors, block):
            same = block.labels[order] == anchors.labels[a]
            same &= ~(block.known[order] & anchors.known[a] & (block.ids[order] == anchors.ids[a]))
            at = np.flatnonzero(same)[:n]
            if len(at):
                own = [(-int(s), not bool(k), int(i)) for s, k, i in zip(found[at], block.known[order[at]], block.ids[order[at]], strict=True)]
                best[a] = sorted(best.get(a, []) + own)[:n]
    return best


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and the largest negative score with low * score <= 100 * it <= high * score."""
    return -(-low * score // 100), high * score // 100


def next_negatives(anchors: Block, positives: dict[int, list[tuple[int, int]]], rows: Iterator[Block], k: int, low: int, high: int) -> dict[tuple[int, int], list[tuple[int, bool, int]]]:
    """By anchor and positive (place, score): (-score, has no id, id) of the first k rows of other labels within the limits, in order."""
    best: dict[tuple[int, int], list] = {}
    for block in rows:
        for a, found, order in tiles(anchors, block):
            if a not in positives:
                continue
            other = block.labels[order] != anchors.labels[a]
            order, falling = order[other], -found[other]
            for place, score in positives[a]:
                lower, upper = limits(score, low, high)
                first = np.searchsorted(falling, -upper, "left")  # the first score that isn't above the upper limit
                at = slice(first, min(first + k, np.searchsorted(falling, -lower, "right")))
                own = [(int(s), not bool(known), int(i)) for s, known, i in zip(falling[at], block.known[order[at]], block.ids[order[at]], strict=True)]
                if own:
                    best[a, place] = sorted(best.get((a, place), []) + own)[:k]
    return best


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double; null for a null vector, or one with a component that is null or not finite."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(fit, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, anchor_cells: int = ANCHOR_CELLS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), up to k rows for each anchor and positive.

    rows: whole-number vectors (see `whole`), of which those with a null label or vector take no part; anchor: a condition on rows.
    An anchor's positives are its first rows of its label by score, rows of its own id left out; negatives are the first rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Ties go by smaller id, rows without an
    id last. Repeated rows are rows each: a repeated anchor repeats its results. Vectors of different lengths count as filled up
    with zeros. No anchors, or no rows: no rows. Other columns are left behind.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    table = scratch.keep(known.where("label IS NOT NULL AND v IS NOT NULL"), "rows")
    heads = scratch.keep(table.where("anchor").groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")), "anchors")  # equal anchors have equal results
    cells = heads.agg(F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(1))), F.lit(0))).first()[0]
    parts = cells // anchor_cells + 1
    data = table.select("id", "label", "v")
    where = f"{scratch.root}/found"
    for part in range(parts):
        own = heads.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(parts)) == part).toArrow()  # about anchor_cells components
        _mined(spark, data, own, positives, k, low, high, block).write.mode("append").parquet(where)
    scratch.keep_only()
    found = spark.read.parquet(where).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mined(spark: SparkSession, rows: DataFrame, own: pa.Table, positives: int, k: int, low: int, high: int, block: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, copies) of one block of anchors."""
    own = own.sort_by([("id", "ascending")])  # nulls last, as in a Block
    shipped = spark.sparkContext.broadcast(arrays(*[own.column(c).combine_chunks() for c in ("id", "label", "v")]))

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(a, *p) for a, best in first_positives(Block(*shipped.value), blocks(batches, block), positives).items() for p in best]
        kinds = {"anchor": pa.int64(), "falling": pa.int64(), "idless": pa.bool_(), "id": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    order = Window.partitionBy("anchor").orderBy("falling", "idless", "id")
    first = rows.mapInArrow(positive, "anchor long, falling long, idless boolean, id long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs: dict[int, list] = {}
    for r in sorted(first.collect(), key=lambda r: (r.anchor, r.place)):  # `positives` rows for each of a block's anchors
        pairs.setdefault(r.anchor, []).append((r.place, -r.falling, None if r.idless else r.id))
    wanted = spark.sparkContext.broadcast(pairs)

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs_ = Block(*shipped.value), wanted.value
        found = next_negatives(held, {a: [(place, score) for place, score, _ in p] for a, p in pairs_.items()}, blocks(batches, block), k, low, high)
        out = []
        for (a, place), best in found.items():
            _, score, positive_id = pairs_[a][place - 1]
            out += [(a, int(held.ids[a]) if held.known[a] else None, place, positive_id, score, None if idless else i, -s) for s, idless, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=[x.split()[0] for x in _OUT.split(", ")])

    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    out = rows.mapInArrow(negative, _OUT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copies = spark.createDataFrame([(i, int(c)) for i, c in enumerate(own.column("copies").to_pylist())], "anchor long, copies long")  # a row for each of the block's anchors
    return out.join(F.broadcast(copies), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "copies")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL12 = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND (a.label <> b.label OR a.id <> b.id)
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
