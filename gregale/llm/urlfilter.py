"""URL filters: rules by host and path, and a Bloom filter cascade that answers exactly for every key of the corpus.

A cascade alternates levels: the first Bloom filter holds the listed keys; the second holds the unlisted keys that the first lets
through, the third the listed keys that the second lets through, and so on until a level lets nothing wrong through. A key that some
level doesn't hold is decided by that level's place, so that answers are exact for all keys that the cascade was fitted on, at a few
bits a key. It is fitted on the corpus's complete key universe, listed and unlisted.

Keys are dealt into shards by hash, about SHARD_KEYS distinct keys each, and each shard's levels are built in one task; the number of
shards grows with the corpus, a task doesn't. Rows are then tested without a join: shards that come to BROADCAST_BYTES at most are
sent to all tasks; larger ones meet their rows, in the order of shards, in tasks of some DEALT_ROWS rows, so that the rows of one hot
key lie in many tasks.

A key's identity is two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gregale.llm.common import Scratch, read

#: Distinct keys of a shard, about.
SHARD_KEYS = 1 << 20
#: What all tasks get at once, at most.
BROADCAST_BYTES = 32 << 20
#: Rows of a task that holds one shard at a time.
DEALT_ROWS = 1 << 20
#: Levels beyond which keys must have equal hashes.
MOST_LEVELS = 64
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A host of which this part of the pages or more is blocked by rule is listed.
LISTED_SHARE = 0.125
_SHARDS = "shard long, levels array<struct<bits:bigint,hashes:int,words:binary>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case, and the path up to `?`, `#` or the end.

    Both are empty for null and where there is no `://`. Ports and users stay in the host.
    """
    there = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    part = lambda pattern, group: F.when(there, F.regexp_extract(rest, pattern, group)).otherwise("")
    return F.translate(part("^[^/?#]*", 0), _UPPER, _LOWER), part("^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. rules: (verdict, host/path).

    A rule fits its host and all subdomains where the path begins with the rule's. Of rules of one length that with the longer host
    wins. Rules are few, an expression each; long lists belong into a cascade.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules; put the list into a cascade")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _mixed(x: np.ndarray, level: int, salt: int) -> np.ndarray:
    """The hashes, anew for each level."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (2 * level + salt + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _places(h: np.ndarray, g: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    a, b = _mixed(h, level, 0), _mixed(g, level, 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(hashes):
            yield (a + np.uint64(i) * b) % np.uint64(bits)


def _holds(level: int, bits: int, hashes: int, words: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    held = np.ones(len(h), bool)
    for at in _places(h, g, level, bits, hashes):
        held &= (words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return held


def build_levels(h: np.ndarray, g: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hashes, words) of each level, for the distinct keys of a shard.

    The first level lets through about sqrt(1/2) as many unlisted keys as there are listed ones, later ones half of what they see,
    which is near the fewest bits in all.
    """
    held, other, levels = (h[listed], g[listed]), (h[~listed], g[~listed]), []
    while len(held[0]):
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed and an unlisted key have equal hashes")
        rate = min(0.5, math.sqrt(0.5) * len(held[0]) / max(1, len(other[0]))) if not levels else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(8, math.ceil(len(held[0]) * -math.log(rate) / math.log(2) ** 2))
        words = np.zeros((bits + 7) // 8, np.uint8)
        for at in _places(*held, len(levels), bits, hashes):
            np.bitwise_or.at(words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        through = _holds(len(levels), bits, hashes, words, *other)
        levels.append((bits, hashes, words.tobytes()))
        held, other = (other[0][through], other[1][through]), held
    return levels


def decide(levels: list[tuple[int, int, np.ndarray]], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that doesn't hold it says so by its place, the last by its own."""
    out, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for i, (bits, hashes, words) in enumerate(levels):
        held = _holds(i, bits, hashes, words, h[open_], g[open_])
        out[open_[~held]] = i % 2 == 1
        open_ = open_[held]
    out[open_] = len(levels) % 2 == 1
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("__h"), F.xxhash64(F.lit(1), key).alias("__g")]


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), F.col("__h")), F.lit(shards)).alias("__shard")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class Cascade:
    """A fitted cascade: its shards (shard, levels) as a stored table, and how many there are."""

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    def bytes(self) -> int:
        """The size of all levels of all shards."""
        size = F.aggregate("levels", F.lit(0).cast("long"), lambda n, level: n + F.octet_length(level["words"]))
        return self.table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def fit_cascade(keys: DataFrame, key_col: str, listed_col: str, shard_keys: int = SHARD_KEYS) -> Cascade:
    """A cascade over all keys. A key that repeats is listed if one of its rows is; a null key is a key, a null mark is none.

    No keys at all: a cascade that lists nothing. Each shard's distinct keys are in one task, about shard_keys of them.
    """
    spark = keys.sparkSession
    scratch = Scratch(spark, "cascade")
    own = keys.select(*_hashes(F.col(key_col)), F.coalesce(F.col(listed_col), F.lit(False)).alias("listed"))
    universe = scratch.keep(own.groupBy("__h", "__g").agg(F.max("listed").alias("listed")), "universe")
    shards = universe.count() // shard_keys + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come by shard, so a task holds one shard's at a time."""
        at, parts = None, []

        def close() -> pa.RecordBatch:
            h, g, listed = (np.concatenate([p[i] for p in parts]) for i in range(3))
            levels = [{"bits": b, "hashes": k, "words": w} for b, k, w in build_levels(h, g, listed)]
            kind = pa.list_(pa.struct([("bits", pa.int64()), ("hashes", pa.int32()), ("words", pa.binary())]))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([levels], kind)], names=["shard", "levels"])

        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            columns = (_unsigned(batch.column(1)), _unsigned(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False).astype(bool))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if parts and shard[lo] != at:
                        yield close()
                        parts = []
                    at = int(shard[lo])
                    parts.append(tuple(c[lo:hi] for c in columns))
        if parts:
            yield close()

    dealt = universe.select(_shard(shards), "__h", "__g", "listed").repartition(shards, "__shard").sortWithinPartitions("__shard")
    table = scratch.keep(dealt.mapInArrow(build, _SHARDS), "shards")
    scratch.keep_only("shards")
    return Cascade(table, shards)


def _opened(levels: list[dict]) -> list[tuple[int, int, np.ndarray]]:
    return [(x["bits"], x["hashes"], np.frombuffer(x["words"], np.uint8)) for x in levels]


def mark_listed(df: DataFrame, key_col: str, cascade: Cascade, out_col: str = "listed", broadcast_bytes: int = BROADCAST_BYTES, dealt_rows: int = DEALT_ROWS) -> DataFrame:
    """df with out_col: whether the row's key is listed, exact for all keys that the cascade was fitted on.

    Rows that share a key get one answer, in any order; a column of that name is replaced. Keep columns that aren't needed out of df,
    as all of them pass through Python.
    """
    df = df.select(*[c for c in df.columns if c != out_col])
    if cascade.bytes() <= broadcast_bytes:
        return _mark_sent(df, key_col, cascade, out_col)
    return _mark_dealt(df, key_col, cascade, out_col, dealt_rows)


def _mark_sent(df: DataFrame, key_col: str, cascade: Cascade, out_col: str) -> DataFrame:
    """All shards are sent to all tasks; nothing is shuffled."""
    shipped = df.sparkSession.sparkContext.broadcast({r.shard: [x.asDict() for x in r.levels] for r in cascade.table.collect()})  # BROADCAST_BYTES at most
    n, schema = len(df.columns), StructType([*df.schema, StructField(out_col, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: _opened(v) for k, v in shipped.value.items()}
        for batch in batches:
            h, g, shard = _unsigned(batch.column(n)), _unsigned(batch.column(n + 1)), batch.column(n + 2).to_numpy(zero_copy_only=False)
            out = np.zeros(len(h), bool)
            for s in np.unique(shard):
                own = shard == s
                out[own] = decide(shards.get(int(s), []), h[own], g[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out)], names=schema.names)

    return df.select("*", *_hashes(F.col(key_col))).select("*", _shard(cascade.shards)).mapInArrow(run, schema)


def _mark_dealt(df: DataFrame, key_col: str, cascade: Cascade, out_col: str, dealt_rows: int) -> DataFrame:
    """Each task holds one shard at a time. Rows and shards are sorted into one stream by (shard, part), the shard's levels first.

    A shard with many rows, as one hot key makes it, has them dealt into parts, each with a copy of its levels.
    """
    spark, n = df.sparkSession, len(df.columns)
    schema = StructType([*df.schema, StructField(out_col, BooleanType())])
    keyed = df.select("*", *_hashes(F.col(key_col))).select("*", _shard(cascade.shards))
    parts = keyed.groupBy("__shard").agg((F.floor(F.count(F.lit(1)) / dealt_rows) + 1).alias("__parts"))  # a row for each SHARD_KEYS keys
    rows = keyed.join(parts, "__shard").select(*df.columns, "__h", "__g", "__shard", F.pmod(F.xxhash64(F.lit(3), *[F.col(c) for c in df.columns]), "__parts").alias("__part"), F.lit(None).cast("array<struct<bits:bigint,hashes:int,words:binary>>").alias("__levels"))
    levels = cascade.table.join(parts, F.col("shard") == F.col("__shard")).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    levels = levels.select(*empty, F.lit(None).cast("long").alias("__h"), F.lit(None).cast("long").alias("__g"), "__shard", "__part", F.col("levels").alias("__levels"))
    tasks = max(cascade.shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = rows.unionByName(levels).repartition(tasks, "__shard", "__part").sortWithinPartitions("__shard", "__part", F.col("__levels").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [])
        for batch in batches:
            shard, part, own = batch.column(n + 2).to_pylist(), batch.column(n + 3).to_pylist(), batch.column(n + 4)
            starts = [i for i in range(len(shard)) if own[i].is_valid]
            cuts = sorted({0, len(shard), *starts, *(i + 1 for i in starts), *(i for i in range(1, len(shard)) if (shard[i], part[i]) != (shard[i - 1], part[i - 1]))})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if own[lo].is_valid:
                    held = ((shard[lo], part[lo]), _opened(own[lo].as_py()))
                    continue
                levels_ = held[1] if held[0] == (shard[lo], part[lo]) else []
                piece = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], pa.array(decide(levels_, _unsigned(piece.column(n)), _unsigned(piece.column(n + 1))))], names=schema.names)

    return stream.mapInArrow(run, schema)


def filter_urls(pages: DataFrame, rules=RULES, share: float = LISTED_SHARE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row.

    The rule's verdict counts; without a rule, pages of a listed host are blocked. A host is listed if `share` of its pages or more
    are blocked by rule. All hosts of the pages, listed and unlisted, are the cascade's keys. Null urls and those without `://` have
    an empty host, which is a key like any; null ids and repeated rows are judged like any, and count in their host's share. Other
    columns are left behind. No rows: no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    hosts = rows.groupBy("host").agg((F.count(F.when(F.col("said") == "block", 1)) >= F.lit(share) * F.count(F.lit(1))).alias("listed"))
    marked = mark_listed(rows, "host", fit_cascade(hosts, "host", "listed"))
    return marked.select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op11_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"))


def _said(column: int) -> str:
    fits = {text: (text.partition("/")[0], "/" + text.partition("/")[2], what) for what, text in sorted(RULES, key=lambda r: (-len(r[1]), -r[1].index("/")))}
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(text, what)[column]}'" for text, (h, p, what) in fits.items()) + " END"


SQL11 = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_said(0)} AS rule, {_said(1)} AS said FROM p),
h AS (SELECT host, count(CASE WHEN said = 'block' THEN 1 END) >= {LISTED_SHARE} * count(*) AS listed FROM r GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r JOIN h ON r.host = h.host
"""
