"""Shapes of queries over the catalogue: users, stores' manifests, permissions. All are joins and filters that Spark plans."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram, and folders of a gram table.
GRAM, GRAM_FOLDERS = 3, 64


def people_like(users: DataFrame, part: str, myself: str, email_col: str = "email", most: int = 10) -> DataFrame:
    """The first users, by address, whose address contains part, in any case, other than oneself. Wildcards in part stand for themselves."""
    quoted = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return users.where(F.col(email_col).ilike(f"%{quoted}%") & (F.col(email_col) != myself)).orderBy(email_col).limit(most)


def _grams(text: Column) -> Column:
    """The different grams of a text in lower case; none of shorter texts."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


def write_grams(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """The lists of a contains-search: (gram, id) of all texts, in folders by gram, sorted by it, so that a search reads a few lists alone."""
    rows = df.select(F.col(id_col).alias("id"), F.explode(_grams(F.col(text_col))).alias("gram")).withColumn("folder", (F.crc32(F.col("gram").cast("binary")) % GRAM_FOLDERS).cast("int"))
    # a common gram's list is dealt over tasks by range, and so over files
    rows.repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id").write.mode("overwrite").partitionBy("folder").parquet(path)


def containing(df: DataFrame, grams: DataFrame, part: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of df whose text contains part, in any case; grams: the table of write_grams. Wildcards stand for themselves.

    Rows that are in the lists of all of part's grams are looked at alone; a part shorter than a gram is looked for everywhere.
    """
    low = part.lower()
    found = F.contains(F.lower(text_col), F.lower(F.lit(part)))
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return df.where(found)
    folders = sorted({zlib.crc32(g.encode()) % GRAM_FOLDERS for g in wanted})
    hits = grams.where(F.col("folder").isin(folders) & F.col("gram").isin(wanted)).groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return df.join(hits.select(F.col("id").alias(id_col)), id_col, "left_semi").where(found)


def page(df: DataFrame, order: str, offset: int, size: int) -> DataFrame:
    """Rows of a page, by order, each with `total`, the number of all rows. One row of counts joins the page."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(order).offset(offset).limit(size).join(total, F.lit(True)).orderBy(order)


def newest_first(df: DataFrame, time_col: str, id_col: str, most: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(time_col).desc(), id_col)
    return out.limit(most) if most is not None else out


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(F.col(flag))


def with_roles(permissions: DataFrame, roles: list[str], role_col: str = "role") -> DataFrame:
    return permissions.where(F.col(role_col).isin(roles))


def granted(manifests: DataFrame, permissions: DataFrame, user, roles: list[str], key: str, time_col: str) -> DataFrame:
    """Active manifests with the user's role in them, newest first. permissions: (key, user_id, role)."""
    mine = with_roles(permissions, roles).where(F.col("user_id") == user).select(key, "role")
    return newest_first(active(manifests).join(mine, key), time_col, key)


def holders(permissions: DataFrame, users: DataFrame) -> DataFrame:
    """Permissions with their user's columns, null where the user is gone."""
    return permissions.join(users, "user_id", "left")


def visible(manifests: DataFrame, permissions: DataFrame, user, key: str, is_admin: bool = False) -> DataFrame:
    """Manifests that the user has a permission for; all of them for administrators."""
    return manifests if is_admin else manifests.join(permissions.where(F.col("user_id") == user), key, "left_semi")


def manifest_files(manifests: DataFrame, name_col: str, json_col: str) -> DataFrame:
    """(name, hash, filename, uploaded): the files that manifests name, one row each, from JSON {"files": [{"hash", "filename", "uploaded"}]}."""
    files = F.from_json(json_col, "files array<struct<hash:string,filename:string,uploaded:string>>")["files"]
    return manifests.select(F.col(name_col).alias("name"), F.explode(files).alias("f")).select("name", "f.*")
