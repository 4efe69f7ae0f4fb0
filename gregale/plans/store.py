"""The historical store: built from batches, and kept by blocks, so that adding or removing files builds only the blocks that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.functions.text import disambiguate_body, drop_gage, extend_expose, fill_blank, fold, is_blank, normalize_text
from gregale.operators.cluster import get_clusters
from gregale.operators.dedup import keep_newest_longest
from gregale.operators.storing import delete_path, stored

BLOCK = ("Lecture", "origin_project", "Num article")
#: Folders of a kept store's tables; a block lies in one.
FOLDERS = 64


def build(batches: DataFrame, block: tuple[str, ...] = BLOCK, eps: float = 0.1, threshold: float = 0.99) -> DataFrame:
    """Answered rows of batches, normalised, one of each group of near-identical statements: the newest, then the longest answer.

    batches: amdt_idx, timestamp, the block columns, `Corps amdt`, `Exposé amdt`, `Réponse` and others, which stay.
    """
    body, expose = F.col("Corps amdt"), F.col("Exposé amdt")
    df = batches.where(~is_blank(F.col("Réponse")))
    df = df.withColumn("Corps amdt", disambiguate_body(body, F.col("Num article"))).withColumn("Exposé amdt", extend_expose(expose, body))
    df = df.withColumns({c: normalize_text(drop_gage(fold(F.col(c)))) for c in ("Corps amdt", "Exposé amdt")})
    df = df.withColumn("Exposé amdt", fill_blank(expose, F.col("amdt_idx"), "vide "))
    df = stored(df)
    _, groups = get_clusters(df, list(block), "amdt_idx", "Exposé amdt", eps, threshold)
    return keep_newest_longest(df, groups, "amdt_idx", "amdt_idx", "timestamp", "Réponse")


def append(spark: SparkSession, raw: DataFrame, more: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Raw rows of both; files that are there already are an error."""
    if raw.select(hash_col).intersect(more.select(hash_col)).take(1):
        raise ValueError("some of these files are in the store already")
    return raw.unionByName(more, allowMissingColumns=True)


def remove(raw: DataFrame, hashes: list[str], hash_col: str = "file_hash") -> DataFrame:
    """Raw rows without those of the given files; no such file, or nothing left, is an error."""
    rest = raw.where(~F.col(hash_col).isin(hashes))
    if not raw.where(F.col(hash_col).isin(hashes)).take(1) or not rest.take(1):
        raise ValueError("these files aren't in the store, or they are all of it")
    return rest


class KeptStore:
    """A store in a folder: raw rows with their file's hash, and the rows built of them, both in FOLDERS folders by block.

    A block is clustered by itself, so that a change to some blocks leaves all others as they are: append and remove read and write
    the folders of those blocks alone, by dynamic partition overwrite, and build those blocks alone. The result is that of a whole build.
    """

    def __init__(self, spark: SparkSession, path: str, block: tuple[str, ...] = BLOCK, eps: float = 0.1, threshold: float = 0.99):
        self.spark, self.path, self.block, self.eps, self.threshold = spark, path, block, eps, threshold

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def raw(self) -> DataFrame:
        return self._read("raw").drop("block_key", "folder")

    def rows(self) -> DataFrame:
        """What the search reads."""
        return self._read("rows").drop("block_key", "folder")

    def _keyed(self, df: DataFrame) -> DataFrame:
        """With the block's hash; blocks of one hash are built together, which does no harm."""
        key = F.xxhash64(*[F.col(c) for c in self.block])
        return df.withColumns({"block_key": key, "folder": F.pmod(key, F.lit(FOLDERS)).cast("int")})

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        writer = df.repartition("folder").write.mode(mode).partitionBy("folder").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{self.path}/{table}")

    def _replace(self, df: DataFrame, table: str, folders: list[int]) -> None:
        """These folders now hold df's rows, or are gone."""
        df = stored(df)  # it is made of the folders themselves
        self._write(df, table, "overwrite")
        left = {r.folder for r in df.select("folder").distinct().collect()}  # FOLDERS at most
        for folder in set(folders) - left:
            delete_path(self.spark, f"{self.path}/{table}/folder={folder}")

    def create(self, raw: DataFrame) -> None:
        self._write(self._keyed(raw), "raw", "overwrite")
        self._write(self._keyed(build(self.raw(), self.block, self.eps, self.threshold)), "rows", "overwrite")

    def _rebuild(self, changed: DataFrame) -> None:
        """Builds the blocks of changed (block_key, folder) anew."""
        folders = [r.folder for r in changed.select("folder").distinct().collect()]  # FOLDERS at most
        near = self._read("raw").where(F.col("folder").isin(folders)).join(changed.select("block_key"), "block_key", "left_semi").drop("block_key", "folder")
        built = self._keyed(build(near, self.block, self.eps, self.threshold))
        others = self._read("rows").where(F.col("folder").isin(folders)).join(changed.select("block_key"), "block_key", "left_anti")
        self._replace(others.unionByName(built, allowMissingColumns=True), "rows", folders)

    def append(self, more: DataFrame, hash_col: str = "file_hash") -> None:
        """Adds files' rows, numbered after those that are there; files that are there already are an error."""
        raw = self._read("raw")
        if raw.select(hash_col).intersect(more.select(hash_col)).take(1):
            raise ValueError("some of these files are in the store already")
        top = raw.agg(F.max("amdt_idx") + 1).first()[0]
        new = stored(self._keyed(more.withColumn("amdt_idx", F.col("amdt_idx") + top)))
        self._write(new, "raw", "append")
        self._rebuild(new.select("block_key", "folder").distinct())

    def remove(self, hashes: list[str], hash_col: str = "file_hash") -> None:
        """Takes files' rows away; no such file, or nothing left, is an error."""
        raw = self._read("raw")
        of_files = F.col(hash_col).isin(hashes)
        changed = stored(raw.where(of_files).select("block_key", "folder").distinct())
        if not changed.take(1) or not raw.where(~of_files).take(1):
            raise ValueError("these files aren't in the store, or they are all of it")
        folders = [r.folder for r in changed.select("folder").distinct().collect()]
        self._replace(raw.where(F.col("folder").isin(folders) & ~of_files), "raw", folders)
        self._rebuild(changed)
