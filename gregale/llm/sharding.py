"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A ring of 2^64 points carries `replicas` virtual nodes of each shard. A document's point is a hash of its id; it goes to the
first shard clockwise that still has room. Rooms are counted in rows and add up to the number of documents (slack 0), so that
shard sizes differ by one row at most; with slack, each shard may take (1 + slack) times its even part, and fewer documents move
when the number of shards changes.

Documents meet the shards in rounds: in round r every document without a place asks the r-th different shard clockwise of its
point, and a shard takes those that ask in the order of their points until it is full. A document has asked every shard after as
many rounds as there are shards, and as rooms suffice for all, it has a place by then.

The rounds work on counts only: the ring is cut into equal segments, of which each has all its virtual node decisions in common, and
the driver sees one count for each segment (a number that the ring decides, whatever the input). Rows then find their places by their
rank within their segment; texts aren't shuffled.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gregale.llm.common import read

SEGMENT_BITS = 14


def segment_bits(shards: int, replicas: int) -> int:
    """So many segments that virtual nodes are rarely in one: eight for each of them at least, and 2^14 for any ring of up to 2048 nodes."""
    return max(SEGMENT_BITS, (8 * shards * replicas - 1).bit_length())


def ring_orders(shards: int, replicas: int) -> np.ndarray:
    """[segment, r]: the r-th different shard clockwise of the segment's start. Virtual nodes stand at segment starts, those of one segment in the order of their hashes."""
    bits = segment_bits(shards, replicas)
    hashed = sorted((int.from_bytes(hashlib.blake2b(f"shard-{s}-{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(replicas))
    nodes = [(p >> (64 - bits), s) for p, s in hashed]
    starts = [p for p, _ in nodes]
    after: dict[int, list[int]] = {}
    orders = np.empty((1 << bits, shards), np.int32)
    for segment in range(1 << bits):
        at = bisect.bisect_left(starts, segment) % len(nodes)
        if at not in after:
            after[at] = list(dict.fromkeys(nodes[(at + i) % len(nodes)][1] for i in range(len(nodes))))
        orders[segment] = after[at]
    return orders


def rooms(total: int, shards: int, slack: float) -> np.ndarray:
    if slack <= 0:
        return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    return np.full(shards, int(np.ceil(total * (1 + slack) / shards)), np.int64)


def place(counts: np.ndarray, orders: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(segment, first rank, rank after the last, shard, first slot) for the documents of each segment, by rank."""
    left, load = counts.astype(np.int64).copy(), np.zeros_like(room)
    places = []
    for r in range(orders.shape[1]):
        open_segments = np.flatnonzero(left)
        if not len(open_segments):
            break
        asked = orders[open_segments, r]
        for shard in np.unique(asked):
            own = open_segments[asked == shard]
            before = np.cumsum(left[own]) - left[own]
            taken = np.clip(room[shard] - load[shard] - before, 0, left[own])
            for segment, take, ahead in zip(own[taken > 0], taken[taken > 0], before[taken > 0], strict=True):
                first = counts[segment] - left[segment]
                places.append((int(segment), int(first), int(first + take), int(shard), int(load[shard] + ahead)))
            left[own] -= taken
            load[shard] += taken.sum()
    return places


def shard_documents(docs: DataFrame, shards: int = 24, replicas: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    size: UTF-8 bytes of the text (null: none) plus 8. slot: gapless from 0 in each shard. A row without an id has the point of its
    text; repeated rows get slots of their own. Other columns are left behind. No rows: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = segment_bits(shards, replicas)
    point = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(text))
    segment = F.shiftrightunsigned(point, 64 - bits).cast("int")
    counts = np.zeros(1 << bits, np.int64)
    for s, n in docs.groupBy(segment.alias("segment")).count().collect():  # one row per segment
        counts[s] = n
    places = place(counts, ring_orders(shards, replicas), rooms(int(counts.sum()), shards, slack))
    by_segment: dict[int, list[tuple[int, int, int, int]]] = {}
    for s, *rest in places:
        by_segment.setdefault(s, []).append(tuple(rest))
    plan = spark.createDataFrame(list(by_segment.items()), "segment int, places array<struct<lo:bigint,hi:bigint,shard:int,slot:bigint>>")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), point.alias("point"), segment.alias("segment"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy("point", id_col, "text_crc32", "size")).cast("long") - 1)
    return (
        ranked.join(F.broadcast(plan), "segment")  # one row per segment
        .withColumn("at", F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0])
        .select(id_col, "size", "text_crc32", F.col("at.shard").alias("shard"), (F.col("at.slot") + F.col("rank") - F.col("at.lo")).alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards; the law is `rows`: counts are at most one apart."""
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
