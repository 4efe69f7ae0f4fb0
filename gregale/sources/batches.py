"""Readers and writers of batches: JSON exports, CSV, workbooks, and the historical store in Parquet."""

from __future__ import annotations

import io
import logging
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gregale.functions.text import html_to_text
from gregale.operators.storing import stored

log = logging.getLogger(__name__)

# Names of an export's fields, and of the batch's columns.
RENAMES = {
    "affectation_email": "Affectation (email)", "affectation_name": "Affectation (nom)", "article": "Num article",
    "avis": "Avis du Gouvernement", "computed_batch": "Allotissement", "corps": "Corps amdt", "expose": "Exposé amdt",
    "groupe": "Groupe", "has_ever_been_on_dossier_de_banc": "A été dans le Dossier de Banc", "mission_titre_court": "Mission",
    "num": "Num amdt", "objet": "Objet amdt", "organe": "Organe", "pilot_entity": "Entité Pilote", "reponse": "Réponse", "sort": "Sort",
}
PRIVATE = "auteur"
EXPORT = (
    "num long, article string, chambre string, legislature long, organe string, groupe string, mission_titre_court string, corps string, "
    "expose string, objet string, sort string, reponse string, avis string, computed_batch array<long>, affectation_email string, "
    "affectation_name string, pilot_entity string, has_ever_been_on_dossier_de_banc boolean, auteur string, date_derniere_modif string"
)


def epoch(c: Column, default: int | None) -> Column:
    """Seconds since 1970 in UTC of a time with or without a fraction; the default for blanks and what can't be read."""
    filled = F.nullif(F.trim(c), F.lit(""))
    time = F.coalesce(F.try_to_timestamp(filled, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(filled, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(filled, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.unix_timestamp(time), F.lit(default).cast("long"))


#: Fields that all exports' rows together may have.
MOST_FIELDS = 10_000


def _rows(content: Column) -> Column:
    """The rows of an export, each as it comes: an array of variants at the top level's `amendements`.

    A byte-order mark is passed over; what isn't JSON, or has no such array, is an error.
    """
    text = F.regexp_replace(content, "^\\x{FEFF}", "")
    rows = F.from_json(text, "amendements array<variant>", {"mode": "FAILFAST"})["amendements"]
    return F.coalesce(rows, F.raise_error(F.lit("an export has no array `amendements`")).cast("array<variant>"))


def _known_fields() -> dict[str, str]:
    return dict(f.split(" ", 1) for f in EXPORT.split(", "))


def field_types(rows: DataFrame) -> dict[str, str]:
    """{field: type} of variants (a): EXPORT's types where the values have them, for other fields those of their values; text where they differ.

    Fields stand in EXPORT's order, others by name after them. Lists and objects of unknown fields become JSON texts.
    """
    pairs = rows.select(F.explode(F.try_variant_get("a", "$", "map<string,variant>")).alias("key", "value"))
    kinds = pairs.select("key", F.schema_of_variant("value").alias("kind")).where("kind <> 'VOID'").groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    found = {r.key: r.kinds for r in kinds.limit(MOST_FIELDS + 1).collect()}
    if len(found) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    fits = {"long": {"BIGINT"}, "boolean": {"BOOLEAN"}, "double": {"BIGINT", "DOUBLE"}}
    out = {}
    for key, known in (_known_fields() | {k: None for k in sorted(found) if k not in _known_fields()}).items():
        own = {"DOUBLE" if k.startswith("DECIMAL") else k for k in found.get(key, [])}
        if known is None:
            known = next((t for t in ("boolean", "long", "double") if own and own <= fits[t]), "string")
        elif known in fits and not own <= fits[known]:
            known = "string"
        elif known.startswith("array") and any(not k.startswith("ARRAY") for k in own):
            known = "string"
        out[key] = known
    return out


def numbered(parts: list[DataFrame], id_col: str = "amdt_idx") -> DataFrame:
    """All rows, numbered without gaps in the order of the parts (at: places from 0, within each)."""
    sizes = [p.agg(F.coalesce(F.max("at") + 1, F.lit(0)).alias("n")) for p in parts]
    table = sizes[0].withColumn("part", F.lit(0))
    for i, n in enumerate(sizes[1:], 1):
        table = table.unionByName(n.withColumn("part", F.lit(i)))
    shift = table.alias("x").join(table.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))  # one row per part
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)), allowMissingColumns=True)
    return out.join(shift, "part").withColumn(id_col, (F.col("before") + F.col("at")).cast("long")).drop("part", "before", "at")


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(part, value, file_hash) of all files, read at once; part: the file's place in paths, of which one may be named twice."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    whole = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        whole.append(where.getFileSystem(conf).makeQualified(where).toString())
    places = spark.createDataFrame(list(enumerate(whole)), "part int, path string")  # a row for each given path
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = spark.read.text(sorted(set(paths)), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return read.join(F.broadcast(places), F.url_decode(F.replace(plain("file"), F.lit("+"), F.lit("%2B"))) == plain("path")).select("part", "value", F.sha2(F.encode("value", "UTF-8"), 256).alias("file_hash"))


def read_exports(spark: SparkSession, paths: list[str], project: str | None = None, default_time: int = 0) -> DataFrame:
    """The rows of JSON exports, numbered in the order of the paths and by their places, with their file's hash (file_hash).

    A malformed file, or one without an array of rows, is an error. Fields that EXPORT doesn't name come along, and values of other
    types than its own make their column text. Personal columns are dropped, lots become text, and HTML becomes plain text beside
    the body.
    """
    rows = stored(_files(spark, paths).select("part", "file_hash", F.posexplode(_rows(F.col("value"))).alias("at", "a")))
    types = field_types(rows)

    def value(name: str, kind: str) -> Column:
        if '"' in name:  # no path can say it
            return F.try_variant_get(F.try_element_at(F.try_variant_get("a", "$", "map<string,variant>"), F.lit(name)), "$", kind)
        return F.try_variant_get("a", f'$["{name}"]', kind)

    fields = [value(c, "variant" if c == "computed_batch" and t == "string" else t).alias(c) for c, t in types.items() if c not in (PRIVATE, "amdt_idx", "file_hash")]
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    df = rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).cast("long").alias("amdt_idx"), "file_hash", *fields)
    df = df.withColumns({"timestamp": epoch(F.col("date_derniere_modif"), default_time), "origin_project": F.lit(project).cast("string"), "Lecture": F.concat_ws(" ", "chambre", F.col("legislature").cast("string"))})
    lots = F.array_join(F.col("computed_batch").cast("array<string>"), ",") if types["computed_batch"] != "string" else F.col("computed_batch").cast("string")
    df = df.withColumns({"Corps amdt original": F.col("corps"), "computed_batch": lots})
    return df.withColumns({c: html_to_text(c) for c in ("corps", "expose", "objet", "reponse")}).withColumnsRenamed(RENAMES)


def first_modification(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, seconds) of each export: the first date of a row, in its order, that can be read, in UTC; null without one."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _rows(F.col("value")).alias("a"))
    return raw.select("file", first_date(F.transform("a", lambda r: F.try_variant_get(r, "$.date_derniere_modif", "string"))).alias("seconds"))


def first_date(dates: Column) -> Column:
    """Seconds of the first of an array of dates that can be read; null without one."""
    return F.get(F.filter(F.transform(dates, lambda d: epoch(d, None)), lambda s: s.isNotNull()), 0)


def _sheet_rows(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ET.Element]:
    """Rows of a sheet as they are parsed; each is let go when the next is read."""
    with z.open(part) as f:
        for _, element in ET.iterparse(f):
            if element.tag == tag:
                yield element
                element.clear()


def sheets(content: bytes) -> dict[str, pd.DataFrame]:
    """Sheets of an xlsx workbook, all cells as text; the first row names the columns."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        # a sheet's part is the one that its relationship names, whatever the sheets' order
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        office = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        titles = [(s.get("name"), targets[s.get(office)]) for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        out = {}
        for title, part in titles:
            table = []
            for row in _sheet_rows(z, posixpath.normpath(part[1:] if part.startswith("/") else f"xl/{part}"), f"{{{ns['m']}}}row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.findall("m:c", ns)):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else at
                    value = c.find("m:v", ns)
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if value is None else value.text or ""
                    cells[column] = shared[int(text)] if c.get("t") == "s" else text
                table.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
            width = len(table[0]) if table else 0
            out[title] = pd.DataFrame([(r + [None] * width)[:width] for r in table[1:]], columns=table[0] if table else [])
    return out


def read_workbooks(spark: SparkSession, paths: list[str], sheet: str, columns: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """(at, columns...): the named columns, as text, of one sheet of each workbook, and rows' places; columns that a workbook lacks are null there.

    aliases: other headings of columns, which count where a workbook lacks the column's own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                table = sheets(content).get(sheet, pd.DataFrame())
                table = table.rename(columns={a: c for a, c in (aliases or {}).items() if a in table and c not in table}).reindex(columns=columns).astype(object)
                table.insert(0, "at", range(len(table)))
                yield table

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, ", ".join(["at long", *[f"`{c}` string" for c in columns]]))


def read_workbook_batches(spark: SparkSession, paths: list[str], sheet: str = "Amendements", project: str | None = None, default_time: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Batches from workbooks, under export or batch names; rows are numbered in the order of the paths, all of the default time."""
    names = columns or [*RENAMES.values(), "chambre", "legislature", "Lecture"]
    df = numbered([read_workbooks(spark, [p], sheet, names, RENAMES) for p in paths])
    if {"chambre", "legislature"} <= set(names):
        df = df.withColumn("Lecture", F.coalesce(F.col("Lecture") if "Lecture" in names else F.lit(None), F.nullif(F.concat_ws(" ", "chambre", "legislature"), F.lit(""))))
    return df.withColumns({"timestamp": F.lit(default_time).cast("long"), "origin_project": F.lit(project).cast("string")}).drop("chambre", "legislature")


#: Readers by extension: (session, paths, **options) -> rows. Add to it to load other files.
HANDLERS = {
    ".json": read_exports,
    ".xlsx": read_workbook_batches,
    ".csv": lambda spark, paths, **_: spark.read.csv(paths, sep=";", header=True, multiLine=True, escape='"'),
    ".parquet": lambda spark, paths, **_: spark.read.parquet(*paths),
}


def load(spark: SparkSession, paths: list[str], strict: bool = False, **options) -> DataFrame | None:
    """Batches by extension, columns aligned by name; None without any. Unknown extensions are logged and skipped, or an error if strict."""
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(os.path.splitext(p)[1].lower(), []).append(p)
    out = None
    for extension, own in kinds.items():
        if extension not in HANDLERS:
            if strict:
                raise ValueError(f"no reader for {own}")
            log.warning("no reader for %s", own)
            continue
        part = HANDLERS[extension](spark, own, **options)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


class Stores:
    """Historical stores kept in memory by name, in any case and without their extension."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    @staticmethod
    def key(name: str) -> str:
        return os.path.splitext(name.strip().lower())[0]

    def get(self, name: str, path: str) -> DataFrame:
        if self.key(name) not in self.held:
            self.held[self.key(name)] = self.spark.read.parquet(path).cache()
        return self.held[self.key(name)]

    def remove(self, name: str) -> bool:
        df = self.held.pop(self.key(name), None)
        if df is not None:
            df.unpersist()
        return df is not None

    def clear(self) -> None:
        for name in list(self.held):
            self.remove(name)

    def info(self) -> dict[str, dict]:
        return {k: {"rows": df.count(), "columns": df.columns} for k, df in self.held.items()}


def catalogue(config: dict, projects: list[str] | None = None) -> list[dict]:
    """(path, project, default_time) of the files of the named projects, or of all, a path named last counting; faults are errors."""
    known = (config or {}).get("projects")
    if not known:
        raise ValueError("no projects")
    files: dict[str, dict] = {}
    for name in projects if projects is not None else known:
        if name not in known:
            raise ValueError(f"unknown project {name}; there are {sorted(known)}")
        for kind in ("json_configs", "excel_configs"):
            if not isinstance(known[name].get(kind), list):
                raise ValueError(f"{name} lacks a list {kind}")
            for entry in known[name][kind]:
                if lacks := [k for k in ("path", "default_processing_timestamp", "origin_project") if k not in entry]:
                    raise ValueError(f"{name}, {kind}: {', '.join(lacks)} missing")
                day = entry["default_processing_timestamp"]
                time = int(datetime(day["year"], day["month"], day["day"], tzinfo=UTC).timestamp())
                files[entry["path"]] = {"path": entry["path"], "project": entry["origin_project"], "default_time": time}
    return list(files.values())


def load_catalogue(spark: SparkSession, config: dict, projects: list[str] | None = None, root: str = "") -> DataFrame | None:
    """All rows of the catalogue's files, each with its project and default time; ids run over all files."""
    out = None
    for f in catalogue(config, projects):
        part = load(spark, [root + f["path"]], strict=True, project=f["project"], default_time=f["default_time"]).withColumnRenamed("amdt_idx", "at")
        out = [part] if out is None else [*out, part]
    return None if out is None else numbered(out)


def as_text(df: DataFrame) -> DataFrame:
    """Every column that isn't a plain value as text, as the store keeps them."""
    plain = ("string", "bigint", "int", "double", "float", "boolean", "smallint", "tinyint")
    text = lambda c, t: F.decode(F.col(c), "utf-8") if t == "binary" else F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return df.select(*[F.col(f"`{c}`") if t in plain else text(c, t).alias(c) for c, t in df.dtypes])


def write_store(df: DataFrame, path: str, partition: str | None = None) -> None:
    """The store's Parquet table, by partition if given."""
    writer = as_text(df).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, all columns as text; each part begins with a byte-order mark and a header, as spreadsheets want it."""
    text = as_text(df)
    text.withColumnRenamed(text.columns[0], "\ufeff" + text.columns[0]).write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def workbook(table: pd.DataFrame, title: str = "Sheet1") -> bytes:
    """An xlsx workbook of one sheet, all cells as text, empty for nulls."""
    def cell(column: int, row: int, value) -> str:
        name, n = "", column + 1
        while n:
            n, rest = divmod(n - 1, 26)
            name = chr(65 + rest) + name
        text = escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))
        return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    lines = [list(table.columns), *table.astype(object).values.tolist()]
    rows = "".join(f'<row r="{i}">{"".join(cell(k, i, v) for k, v in enumerate(line) if v is not None and v == v)}</row>' for i, line in enumerate(lines, 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(df: DataFrame, columns: list[str], id_col: str = "amdt_idx", rows: int = 100_000) -> DataFrame:
    """(part, content): xlsx workbooks of the id and the configured columns that df has, so many ids' range of rows each, in their order.

    Write them one by one, or store the table; no workbook holds more rows than `rows`, if ids are unique and without gaps.
    """
    if lacks := [c for c in columns if c not in df.columns]:
        log.warning("columns left out of the workbook: %s", lacks)
    known = as_text(df.select(*dict.fromkeys([id_col, *select_known(df, columns).columns])))

    def build(table: pd.DataFrame) -> pd.DataFrame:
        part = int(table.pop("__part").iloc[0])
        table = table.sort_values(id_col, key=lambda s: pd.to_numeric(s, errors="coerce"), kind="stable")
        return pd.DataFrame({"part": [part], "content": [workbook(table)]})

    return known.withColumn("__part", F.floor(F.col(id_col) / rows).cast("long")).groupBy("__part").applyInPandas(build, "part long, content binary")


def files(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(name, path, length, modified) of the files of a folder whose names begin with prefix (of a content hash, say); contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("name"), "path", "length", F.col("modificationTime").alias("modified")).where(name.startswith(prefix))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def select_known(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).limit(rows)


def content_key(content: Column, extension: Column, folder: str = "pool/") -> Column:
    return F.concat(F.lit(folder), F.sha2(content.cast("binary"), 256), extension)


def expand_env(config):
    """Config with ${NAME} replaced by the environment's values; unset names are an error."""
    if isinstance(config, dict):
        return {k: expand_env(v) for k, v in config.items()}
    if isinstance(config, list):
        return [expand_env(v) for v in config]
    if isinstance(config, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], config)
    return config
