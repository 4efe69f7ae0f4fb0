"""The registered queries and their SQL. documents stand for a batch, part names for short texts, orders for a history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.functions import text as tx
from gregale.operators import attribution as at
from gregale.operators import cluster, dedup, enrich, search
from gregale.operators import similarity as sim
from gregale.operators import storing
from gregale.plans import catalogue, features, store
from gregale.sources import batches
from gregale.sources.batches import epoch

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores are dealt out, as work on them outweighs that."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# SQL of the text kernel.
def _singular(w: str) -> str:
    irregular = " ".join(f"WHEN {w} = '{k}' THEN '{v}'" for k, v in tx.IRREGULAR.items())
    return f"CASE {irregular} WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(is|us|os|as)$') THEN {w}[:-2] WHEN {w} LIKE '%aux' AND {w} NOT LIKE '%eaux' THEN {w}[:-4] || 'al' WHEN {w} LIKE '%x' THEN {w}[:-2] ELSE {w} END"


def _digits(c: str) -> str:
    for words in sorted(tx.NUMBERS, key=len, reverse=True):
        c = f"regexp_replace({c}, '(?i)\\b{words}\\b', '{tx.NUMBERS[words]}', 'g')"
    return c


_FOLD = "strip_accents(replace(text, 'ß', 'ss'))"
_ROMAN = r"array_to_string(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: CASE WHEN regexp_full_match(w, '[IVX]{{1,5}}') THEN '' ELSE w END), '')"
_WORDS = r"string_split(trim(regexp_replace(regexp_replace({}, '%', ' % ', 'g'), '\s+', ' ', 'g')), ' ')"
_STOP = f"array_to_string(list_filter({_WORDS}, lambda w: lower(w) NOT IN ({_quoted(tx.STOP_WORDS)})), ' ')"
_SINGULAR = f"array_to_string(list_transform(string_split(trim(regexp_replace({{}}, '\\s+', ' ', 'g')), ' '), lambda w: {_singular('w')}), ' ')"


#: Dashes go, but those beside a digit.
_DASHES = r"replace(replace(regexp_replace(regexp_replace({}, '([0-9])-', '\1' || chr(1), 'g'), '-([0-9])', chr(1) || '\1', 'g'), '-', ' '), chr(1), '-')"


def _normal(text: str = "text", tighten: bool = True) -> str:
    c = f"lower(trim({_FOLD.replace('text', _ROMAN.format(text))}))"
    c = f"regexp_replace({c}, '[''`_]', ' ', 'g')"
    c = rf"regexp_replace({c}, '([0-9])\s*-\s*([0-9])', '\1-\2', 'g')" if tighten else c
    c = _DASHES.format(c)
    c = rf"regexp_replace({c}, '[^a-zA-Z0-9\s\-%]', '', 'g')"
    return _SINGULAR.format(_digits(_STOP.format(c)))


@query("SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\\S')")
def drop_blank(spark, d):
    return _t(spark, d, "documents").where(~tx.is_blank(F.col("text"))).select("doc_id", "text")


@query(rf"SELECT doc_id, {_ROMAN.format('text')} AS out FROM documents")
def roman_strip(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.strip_roman(F.col("text")).alias("out"))


@query(f"SELECT c_custkey, {_digits('c_name || $$ soixante dix huit quatre vingt dix$$')} AS out FROM customer")
def digitize_numbers(spark, d):
    return _t(spark, d, "customer").select("c_custkey", tx.digitize(F.concat("c_name", F.lit(" soixante dix huit quatre vingt dix"))).alias("out"))


@query(f"SELECT doc_id, {_STOP.format('text')} AS out FROM documents")
def stop_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.drop_stop_words(F.col("text")).alias("out"))


@query(f"SELECT doc_id, {_SINGULAR.format('text')} AS out FROM documents")
def singularize(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.singularize(F.col("text")).alias("out"))


@query(f"SELECT doc_id, {_normal()} AS out FROM documents")
def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("out"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents")
def word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'database') AS slug FROM part")
def slugify(spark, d):
    return _t(spark, d, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


_PLAIN = [r"Supprimer cet article\.?", "Supprimer l(?:''|’)alinéa [0-9]{1,5}\\.?", "Supprimer les alinéas [0-9]{1,5} (?:à|et) [0-9]{1,5}\\.?"]


#: Every third document begins with one of these bodies; most texts are long enough to show which rule they meet.
_BODIES = ["Supprimer cet article. ", "SUPPRIMER L'ARTICLE LIMINAIRE. ", "Supprimer l’alinéa 12. ", "supprimer cet article. ", "Supprimer les alinéas 3 à 7. ", "Supprimer l'alinéa. "]
_BODY = f"(SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN list_extract([{_quoted(_BODIES)}], 1 + (doc_id // 3) % 6) ELSE '' END || text AS text FROM documents)"
_LIMINARY = r"regexp_replace(text, '(?i)supprimer l''article liminaire\.?', 'Supprimer cet article.', 'g')"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{'|'.join(_PLAIN)}') OR length(text) < 50 THEN text || ' ' || source ELSE text END AS body FROM (SELECT doc_id, source, {_LIMINARY} AS text FROM {_BODY})")
def common_body(spark, d):
    body = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*map(F.lit, _BODIES)), (F.floor(F.col("doc_id") / 3) % 6 + 1).cast("int"))).otherwise("")
    return _t(spark, d, "documents").select("doc_id", tx.disambiguate_body(F.concat(body, "text"), F.col("source")).alias("body"))


_EDIT = "regexp_matches(strip_accents(lower(text)), '" + "|".join(tx.EDITORIAL).replace("'", "''") + "')"
_CONV = "(SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'Amendement rédactionnel. ' || text ELSE text END AS text FROM conversations)"


def _talk(spark, d):
    return _t(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Amendement rédactionnel. "), "text")).otherwise(F.col("text")))


@query(f"SELECT conv_id, turn, {_EDIT} AS is_redactional, CASE WHEN {_EDIT} OR length(text) < 50 THEN text || ' ' || role ELSE text END AS expose FROM {_CONV}")
def redactional_flag(spark, d):
    return _talk(spark, d).select("conv_id", "turn", tx.is_editorial(F.col("text")).alias("is_redactional"), tx.extend_expose(F.col("text"), F.col("role")).alias("expose"))


_STARTS = ["Amendement rédactionnel. ", "Correction d'erreur matérielle : ", "Un amendement de précision. ", "Amendement rédactionnel, ", "Il s'agit d'un Amendement d'appel. ", "Amendements d’appel : ", "amendement dappel ", ""]
_OPENS = f"(SELECT conv_id, turn, list_extract([{_quoted(_STARTS)}], 1 + (turn + length(text)) % 8) || text AS expose, CASE WHEN length(text) % 3 = 0 THEN 'SUPPRIMER  cet article. ' ELSE '' END || role AS corps FROM conversations)"
_SAID = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(replace(strip_accents({}), '’', ''''))), '[\n\r]', ' ', 'g'), '[^a-z0-9''.,!? \-"]', '', 'g'), '\s+', ' ', 'g'))"""


def _opened(spark, d):
    df = _t(spark, d, "conversations")
    start = F.element_at(F.array(*map(F.lit, _STARTS)), ((F.col("turn") + F.length("text")) % 8 + 1).cast("int"))
    return df.select("conv_id", "turn", F.concat(start, "text").alias("expose"), F.concat(F.when(F.length("text") % 3 == 0, "SUPPRIMER  cet article. ").otherwise(""), "role").alias("corps"))


@query(f"""SELECT conv_id, turn, CASE WHEN starts_with(e, 'amendement redactionnel.') OR regexp_matches(e, 'correction d''erreur materielle|{'|'.join(tx.EDITORIAL[2:])}') THEN 'Amendement rédactionnel.' WHEN starts_with(c, 'supprimer cet article') THEN 'Supprimer cet article.' ELSE '' END AS summary
FROM (SELECT conv_id, turn, {_SAID.format('expose')} AS e, {_SAID.format('corps')} AS c FROM {_OPENS})""")
def summary_rules(spark, d):
    return _opened(spark, d).select("conv_id", "turn", tx.predefined_summary(F.col("expose"), F.col("corps")).alias("summary"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(expose, '(?i)amendements? d.?appel') AND corps <> 'Supprimer cet article.' THEN 'APPEL : ' || corps ELSE corps END AS summary FROM (SELECT conv_id, turn, expose, CASE WHEN length(corps) % 2 = 0 THEN 'Supprimer cet article.' ELSE corps END AS corps FROM {_OPENS})")
def appel_prefix(spark, d):
    summary = F.when(F.length("corps") % 2 == 0, "Supprimer cet article.").otherwise(F.col("corps"))
    return _opened(spark, d).select("conv_id", "turn", tx.appeal_prefix(summary, F.col("expose")).alias("summary"))


_CUT = r"regexp_extract_all(t, '[.!?\n\t–\-]+|[^.!?\n\t–\-]+')"
_GAGED = "regexp_matches(lower(strip_accents(replace(trim(p[{}], chr(32) || chr(9) || chr(10) || chr(13)), '’', ''''))), '^(" + "|".join(tx.GAGE).replace("'", "''") + ")')"


@query(f"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN {_GAGED.format('i')} OR (i > 1 AND {_GAGED.format('i - 1')}) THEN NULL ELSE p[i] END), lambda x: x IS NOT NULL), ''), '') AS out
FROM (SELECT doc_id, {_CUT} AS p FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'La perte de recettes est compensée. ' WHEN 1 THEN 'Rien ici ! La charge pour l’État est compensée - à due concurrence. ' ELSE 'Pas la perte de recettes. ' END || text AS t FROM documents) WHERE t IS NOT NULL)""")
def gage_removal(spark, d):
    start = F.when(F.col("doc_id") % 3 == 0, "La perte de recettes est compensée. ").when(F.col("doc_id") % 3 == 1, "Rien ici ! La charge pour l’État est compensée - à due concurrence. ").otherwise("Pas la perte de recettes. ")
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.drop_gage(F.concat(start, "text")).alias("out"))


def _plain() -> str:
    """Text of pages, as a browser reads it: entities twice, no comments; what stands in scripts is text, in which tags are blanks."""
    c = r"replace(html, '\/', '/')"
    for _ in range(2):
        for entity, sign in {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "nbsp": "\u00a0"}.items():
            c = f"replace({c}, '&{entity};', '{sign}')"
        c = f"regexp_replace({c}, '&amp;?', '&', 'g')"
    for pattern, by in ((r"(?s)<!--.*?-->", ""), (r"(<script>[^<]*)<[^>]+>([^<]*</script>)", r"\1 \2"), (r"<[/!a-zA-Z][^>]*(>|$)", ""), (r"<[^>]+>", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    for escape in (r"\n", r"\t", r"\r"):
        c = f"replace({c}, '{escape}', ' ')"
    return rf"nfc_normalize(trim(regexp_replace({c}, '[\s\x0B\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')))"


@query(f"SELECT page_id, {_plain()} AS out FROM pages")
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.html_to_text("html").alias("out"))


_TFIDF = r"""
t AS (SELECT {block}, id, term, count(*) AS tf FROM (SELECT {block}, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')) AS term FROM base) GROUP BY {block}, id, term),
f AS (SELECT {block}, term, count(*) AS df FROM t GROUP BY {block}, term),
n AS (SELECT {block}, count(DISTINCT id) AS n FROM base GROUP BY {block}),
r AS (SELECT t.*, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS raw FROM t JOIN f USING ({block}, term) JOIN n USING ({block})),
w AS (SELECT {block}, id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {block}, id)) AS w FROM r)
"""
_COS = "c AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 9) AS cos FROM w a JOIN w b USING ({block}, term) WHERE {cond} GROUP BY a.id, b.id)"
_DOCS = "base AS (SELECT doc_id AS id, lang, source, text FROM documents)"


@query(f"WITH {_DOCS}, {_TFIDF.format(block='lang, source')}, {_COS.format(block='lang, source', cond='a.id < b.id')} SELECT a, b, round(cos, 6) AS cos FROM c WHERE cos >= 0.6")
def tfidf_cosine_pairs(spark, d):
    return sim.cosine_pairs(_t(spark, d, "documents"), ["lang", "source"], "doc_id", "text", 0.6).select("a", "b", F.round("cos", 6).alias("cos"))


@query(f"WITH {_DOCS}, {_TFIDF.format(block='lang, source')} SELECT lang, source, id, term, round(w, 6) AS w FROM w")
def tfidf_weights(spark, d):
    return sim.tfidf(_t(spark, d, "documents"), ["lang", "source"], "doc_id", "text").select("lang", "source", "id", "term", F.round("w", 6).alias("w"))


@query(f"WITH {_DOCS}, {_TFIDF.format(block='lang, source')}, {_COS.format(block='lang, source', cond='a.id % 40 >= 20 AND b.id % 40 < 20')} SELECT a AS new_id, b AS old_id, round(cos, 6) AS cos FROM c WHERE cos >= 0.4")
def tfidf_candidates_old_new(spark, d):
    """Sources follow the ids modulo 20, so that this division leaves old and new rows in each block."""
    docs = _t(spark, d, "documents")
    out = sim.cosine_candidates(docs.where("doc_id % 40 < 20"), docs.where("doc_id % 40 >= 20"), ["lang", "source"], "doc_id", "text", 0.4)
    return out.select(F.col("a").alias("new_id"), F.col("b").alias("old_id"), F.round("cos", 6).alias("cos"))


_PAIRS = "p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"


def _named_parts(spark, d):
    part = _t(spark, d, "part").where("p_brand IS NOT NULL AND p_size IS NOT NULL")
    return part.select(F.struct("p_brand", "p_size").alias("cluster"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


@query(f"WITH {_PAIRS} SELECT a, b, damerau_levenshtein(x, y) AS dist FROM p")
def edit_distance_pairs(spark, d):
    return sim.every_pair(_named_parts(spark, d), lambda p: p.withColumn("dist", sim.edit_distance(F.col("text_a"), F.col("text_b")).cast("long")))


@query(f"WITH {_PAIRS} SELECT a, b, round((1 - damerau_levenshtein(x, y) / greatest(length(x), length(y))) * 100, 6) AS pct FROM p")
def edit_similarity_pct(spark, d):
    return sim.every_pair(_named_parts(spark, d), lambda p: sim.edit_pairs(p, "text_a", "text_b").select("a", "b", F.round("pct", 6).alias("pct")))


@query(f"WITH {_PAIRS} SELECT a, b, damerau_levenshtein(x, y) <= 6 AS near FROM p")
def edit_within_bound(spark, d):
    return sim.every_pair(_named_parts(spark, d), lambda p: p.withColumn("near", sim.edit_within(F.col("text_a"), F.col("text_b"), F.lit(6))))


_PART = "base AS (SELECT p_partkey AS id, p_brand, p_name AS text FROM part)"
_REACH = "reach AS (SELECT a AS id, b AS o FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.o)"


@query(f"WITH RECURSIVE {_PART}, {_TFIDF.format(block='p_brand')}, {_COS.format(block='p_brand', cond='a.id <> b.id')}, e AS (SELECT a, b FROM c WHERE cos >= 0.75), {_REACH} SELECT id, min(o) AS cluster FROM reach GROUP BY id")
def clusters_tfidf(spark, d):
    return cluster.tfidf_clusters(_t(spark, d, "part"), ["p_brand"], "p_partkey", "p_name", 0.25)


@query(
    f"WITH RECURSIVE base AS (SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS cluster, p_partkey AS id, p_name AS text FROM part), e AS (SELECT a.id AS a, b.id AS b FROM base a JOIN base b ON a.cluster = b.cluster AND a.id <> b.id WHERE damerau_levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) <= 1 - 0.6), {_REACH} SELECT id, min(o) AS cluster FROM reach GROUP BY id"
)
def clusters_refined(spark, d):
    part = _t(spark, d, "part")
    first = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("cluster"))
    clusters = part.join(first, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("id"), "cluster")
    return cluster.refine(clusters, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), 0.6)


_LOTS = "lots AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster, count(*) OVER (PARTITION BY o_custkey) AS n, * FROM orders)"


def _lots(spark, d):
    orders = _t(spark, d, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return orders, orders.join(first, "o_custkey").select(F.col("o_orderkey").alias("id"), "cluster")


@query(f"WITH {_LOTS} SELECT o_orderkey, o_custkey FROM lots WHERE id = cluster")
def keep_first(spark, d):
    orders, lots = _lots(spark, d)
    return dedup.keep_first(orders, lots, "o_orderkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"WITH {_LOTS} SELECT o_orderkey, o_custkey FROM lots QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, length(o_orderpriority) DESC, o_orderkey) = 1")
def keep_newest_longest(spark, d):
    orders, lots = _lots(spark, d)
    return dedup.keep_newest_longest(orders, lots, "o_orderkey", "o_orderkey", "o_orderdate", "o_orderpriority").select("o_orderkey", "o_custkey")


@query(f"""WITH {_LOTS}, v AS (SELECT cluster, o_orderpriority AS owner, count(*) AS n, min(id) AS seen FROM lots WHERE o_orderpriority NOT IN ('5-LOW') GROUP BY 1, 2),
c AS (SELECT cluster, owner FROM v QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seen) = 1)
SELECT o_orderkey, o_custkey FROM lots LEFT JOIN c USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(o_orderpriority = owner, false) DESC, id) = 1""")
def keep_majority_owner(spark, d):
    orders, lots = _lots(spark, d)
    return dedup.keep_majority_owner(orders, lots, "o_orderkey", "o_orderkey", "o_orderpriority", ["5-LOW"]).select("o_orderkey", "o_custkey")


@query(f"WITH {_LOTS} SELECT id, (SELECT string_agg(x.id::VARCHAR, ',' ORDER BY x.id) FROM lots x WHERE x.cluster = lots.cluster) AS label FROM lots WHERE n > 1")
def allotment_labels(spark, d):
    orders, lots = _lots(spark, d)
    return dedup.labels(orders, lots, "o_orderkey", "o_orderkey")


@query(f"""WITH {_LOTS}, g AS (SELECT id, cluster, n, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS owner, o_totalprice AS price FROM lots),
b AS (SELECT cluster, owner, price FROM g WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (owner IS NOT NULL)::INT DESC, id) = 1)
SELECT g.id AS o_orderkey, CASE WHEN n > 1 THEN b.owner ELSE g.owner END AS owner, CASE WHEN n > 1 THEN b.price ELSE g.price END AS price FROM g LEFT JOIN b USING (cluster)""")
def populate_from_fullest(spark, d):
    orders, lots = _lots(spark, d)
    df = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("owner"), F.col("o_totalprice").alias("price"))
    return dedup.populate(df, lots, "o_orderkey", "o_orderkey", ["owner", "price"])


_FOLDED = """SELECT o_custkey AS new_id, list_reduce(list(struct_pack(id := o_orderkey, r := r, size := size, t := t) ORDER BY o_orderkey),
  lambda x, y: CASE WHEN (x.size = 0 AND y.size > 0) OR y.t > x.t THEN y ELSE x END) AS best FROM (
  SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS r, CASE WHEN o_orderstatus = 'O' THEN length(o_orderpriority) ELSE 0 END AS size, epoch(o_orderdate)::BIGINT AS t FROM orders
) WHERE r >= 0.2 GROUP BY o_custkey"""


def _scored(spark, d):
    return _t(spark, d, "orders").select(
        F.col("o_custkey").alias("new_id"), F.col("o_orderkey").alias("old_id"), F.col("o_orderkey").alias("old_pos"), (F.col("o_totalprice") / 500000).alias("ratio"), F.lit(0.2).alias("least"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("").alias("answer"), F.unix_timestamp("o_orderdate").alias("time"),
    )


@query(f"SELECT new_id, best.id AS old_id, round(best.r, 4) AS ratio FROM ({_FOLDED})")
def best_match_fold(spark, d):
    return search.best_match(_scored(spark, d)).select("new_id", "old_id", F.round("ratio", 4).alias("ratio"))


_MERGED = "m AS (SELECT o_custkey AS new_id, o_orderkey AS old_id, CASE WHEN o_orderstatus = 'O' THEN 'expose' ELSE 'corps' END AS col, o_totalprice AS ratio FROM orders), k AS (SELECT new_id, col, max_by(old_id, ratio) AS old_id, max(ratio) AS ratio FROM m GROUP BY 1, 2), best AS (SELECT new_id, old_id, ratio, col FROM k QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY ratio DESC, (col = 'expose')::INT DESC) = 1)"


def _merged(spark, d):
    def of(status):
        rows = _t(spark, d, "orders").where(F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)) == status)
        known = F.col("o_totalprice").isNotNull() & F.col("o_orderkey").isNotNull()
        best = F.max_by("o_orderkey", F.when(known, F.struct("o_totalprice", -F.col("o_orderkey"))))  # of equal prices the first order
        return rows.groupBy(F.col("o_custkey").alias("new_id")).agg(best.alias("old_id"), F.max("o_totalprice").alias("ratio"))

    return search.merge_matches([("expose", of(True)), ("corps", of(False))])


@query(f'WITH {_MERGED} SELECT new_id, old_id, ratio, col AS "column" FROM best')
def best_match_merge_columns(spark, d):
    return _merged(spark, d)


@query(f"""WITH {_MERGED} SELECT c_custkey AS id, CASE WHEN o.o_orderkey IS NOT NULL THEN o_orderpriority END AS answer,
 CASE WHEN o.o_orderkey IS NOT NULL AND contains(lower(o_orderstatus), 'o') THEN o_orderstatus ELSE c_mktsegment END AS fate,
 CASE WHEN o.o_orderkey IS NOT NULL THEN concat_ws(chr(10), nullif(CASE WHEN c_nationkey > 12 THEN c_name ELSE '' END, ''), 'Copie de answer, fate depuis : ' || o_orderstatus || chr(10) || 'Numéro d''amendement : ' || o_orderkey || chr(10) || 'Lecture : ' || o_orderpriority || chr(10) || 'Organe : ' || chr(10) || 'Colonne similaire : ' || col || CASE WHEN contains(lower(o_orderstatus), 'o') THEN chr(10) || 'fate copié : ' || o_orderstatus ELSE '' END) ELSE CASE WHEN c_nationkey > 12 THEN c_name ELSE '' END END AS "Commentaires"
 FROM customer LEFT JOIN best ON new_id = c_custkey LEFT JOIN orders o ON o.o_orderkey = old_id""")
def copy_with_condition(spark, d):
    target = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("answer"), F.col("c_mktsegment").alias("fate"), F.when(F.col("c_nationkey") > 12, F.col("c_name")).otherwise("").alias("Commentaires"))
    old = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("num"), F.col("o_orderpriority").alias("lecture"), F.lit("").alias("organe"), F.col("o_orderstatus").alias("project"), F.col("o_orderpriority").alias("answer"), F.col("o_orderstatus").alias("fate"))
    return search.copy_columns(target, old, _merged(spark, d), [search.Copy("answer"), search.Copy("fate", condition="O"), search.Copy("other", enabled=False)])


@query(f"""WITH {_PAIRS}, q AS (SELECT a, b, (1 - damerau_levenshtein(x, y) / greatest(length(x), length(y))) * 100 AS pct FROM p), s AS (SELECT a AS id, b AS o, pct FROM q UNION ALL SELECT b, a, pct FROM q)
SELECT id, 'Amdt similaires : ' || string_agg(o || ' (' || round_even(pct, 0)::BIGINT || '%)', ', ' ORDER BY o) AS comment FROM s GROUP BY id""")
def similar_list_comment(spark, d):
    return enrich.similar_in_clusters(_named_parts(spark, d).withColumn("num", F.col("id")))


# A small dictionary of phrases: (keyword, owner).
PHRASES = [("of the", "Alice"), ("the", "Bob"), ("in the", "Alice"), ("de la", "Chloé"), ("und", "Bob"), ("que", "Alice"), ("of", "Chloé"), ("la la", "Bob")]
_WORDLIST = r"""k AS (SELECT keyword, owner, string_split(keyword, ' ') AS kw FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in PHRASES) + r""") v(keyword, owner)),
x AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[\s\f''.,;:!?"(){}<>-\[\]]+'), lambda w: w <> '') AS w FROM documents),
h AS (SELECT id, keyword, owner FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM x) y JOIN k ON y.w[i] = kw[1] AND y.w[i : i + len(kw) - 1] = kw)"""


def _phrases(spark):
    return spark.createDataFrame(PHRASES, "keyword string, owner string")


def _hits(spark, d):
    return at.keyword_matches(_t(spark, d, "documents"), _phrases(spark), "doc_id", "text")


@query(f"WITH {_WORDLIST} SELECT id, owner, keyword FROM h")
def keyword_matches(spark, d):
    return _hits(spark, d).select("id", "owner", "keyword")


_COUNTS = "n AS (SELECT id, owner, string_agg(keyword || ' (x' || c || ')', ', ' ORDER BY keyword) AS counts FROM (SELECT id, owner, keyword, count(*) AS c FROM h GROUP BY ALL) GROUP BY id, owner)"
_VOTE = "v AS (SELECT id, owner FROM (SELECT id, owner, count(*) AS c FROM h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, owner) = 1)"


@query(f"WITH {_WORDLIST}, {_COUNTS} SELECT id, owner, counts FROM n")
def keyword_counts(spark, d):
    return at.keyword_counts(_hits(spark, d)).select("id", "owner", "counts")


@query(f"WITH {_WORDLIST}, {_VOTE} SELECT id, owner FROM v")
def vote_majority(spark, d):
    return at.vote(_hits(spark, d))


@query(f"""WITH {_WORDLIST}, {_COUNTS}, {_VOTE},
l AS (SELECT n.id, v.owner AS chosen, v.owner = n.owner AS own, string_agg(n.owner || ' : [' || counts || ']', chr(10) ORDER BY n.owner) AS t FROM n JOIN v USING (id) GROUP BY ALL)
SELECT id, 'Affectation sélectionnée: ' || chosen || max(CASE WHEN own THEN chr(10) || 'Affectations par mots clés dans ''text'' :' || chr(10) || t END) || coalesce(max(CASE WHEN NOT own THEN chr(10) || chr(10) || 'Autres affectations possibles:' || chr(10) || 'Affectations par mots clés dans ''text'' :' || chr(10) || t || chr(10) END), '') AS comment FROM l GROUP BY id, chosen""")
def explain_comment(spark, d):
    hits = _hits(spark, d)
    return at.explain(hits, at.vote(hits))


_CITED = "x AS (SELECT p_partkey AS id, p_brand, p_size, 'a l''article ' || p_size || ' du code de ' || lower(p_brand) || ' et articles ' || (p_size + 1) || ' et ' || (p_size + 2) AS text FROM part)"


def _cited(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.concat(F.lit("a l'article "), F.col("p_size").cast("string"), F.lit(" du code de "), F.lower("p_brand"), F.lit(" et articles "), (F.col("p_size") + 1).cast("string"), F.lit(" et "), (F.col("p_size") + 2).cast("string")).alias("text"))


def _codes(spark, d):
    return _t(spark, d, "part").select(F.lower("p_brand").alias("document"), F.col("p_size").cast("string").alias("article")).distinct().withColumn("owner", F.concat("document", F.lit("/"), "article"))


@query(f"""WITH {_CITED}, d AS (SELECT DISTINCT lower(p_brand) AS document, p_size::VARCHAR AS article FROM part)
SELECT id, document, article, document || '/' || article AS owner FROM x JOIN d ON d.document = lower(x.p_brand) AND d.article IN (x.p_size::VARCHAR, (x.p_size + 2)::VARCHAR)""")
def legal_matches(spark, d):
    return at.legal_matches(_cited(spark, d), _codes(spark, d), None, "p_partkey", "text").select("id", "document", "article", "owner")


_CREDIT = "g AS (SELECT l_orderkey AS id, l_returnflag AS program, CASE WHEN l_returnflag = 'N' THEN floor(l_quantity)::BIGINT ELSE 0 END AS plus, CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity)::BIGINT ELSE 0 END AS minus FROM lineitem), f AS (SELECT id, max(plus) AS gain, max(minus) AS loss FROM g GROUP BY id)"


@query(f"WITH {_CREDIT} SELECT DISTINCT g.id, program, 'owner ' || program AS owner FROM g JOIN f USING (id) WHERE loss > 0 AND ((gain = 0 AND minus > 0) OR plus > 0)")
def credit_rules(spark, d):
    q = F.floor("l_quantity").cast("long")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("program"), F.when(F.col("l_returnflag") == "N", q).otherwise(0).alias("plus"), F.when(F.col("l_returnflag") != "N", q).otherwise(0).alias("minus"))
    owners = rows.select("program").distinct().withColumn("owner", F.concat(F.lit("owner "), "program"))
    return at.credit_matches(rows, owners).select("id", "program", "owner")


@query("SELECT s_suppkey AS id, s_name AS program, abs(s_nationkey * 1000) AS plus, 0::BIGINT AS minus FROM supplier")
def credit_table_parse(spark, d):
    cell = lambda c: F.concat(F.lit("<td><p>"), c, F.lit("</p><p>x</p></td>"))
    html = F.concat(F.lit("<p>a</p><table><tr><td>Programmes</td><td>Autorisations d’engagement</td></tr><tr><td></td><td>+</td><td>-</td></tr><tr>"), cell(F.col("s_name")), cell(F.concat(F.col("s_nationkey").cast("string"), F.lit(" 000"))), cell(F.lit("")), F.lit("</tr></table>"))
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(at.credit_rows("Autorisations d’engagement")(html)).alias("r"))
    return rows.select("id", "r.program", at.amount(F.col("r.plus")).alias("plus"), at.amount(F.col("r.minus")).alias("minus"))


@query("SELECT o_orderkey AS id, n_name AS owner FROM orders JOIN nation ON n_nationkey = o_orderkey % 40 WHERE o_orderstatus = 'F'")
def redactional_lookup(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("flag"), F.concat(F.lit(" Article "), (F.col("o_orderkey") % 40).cast("string")).alias("article"))
    articles = _t(spark, d, "nation").select(F.concat(F.lit("article "), F.col("n_nationkey").cast("string")).alias("article"), F.col("n_name").alias("owner"))
    return at.editorial_matches(rows, articles, "o_orderkey", "flag", "article").select("id", "owner")


@query("SELECT id, owner, matcher FROM (SELECT o_orderkey AS id, o_orderpriority AS owner, CASE WHEN o_orderstatus = 'F' THEN 'CREDIT_TABLE' ELSE 'KEYWORD' END AS matcher FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus, 'KEYWORD' FROM orders) QUALIFY matcher = min(matcher) OVER (PARTITION BY id)")
def early_exit(spark, d):
    orders = _t(spark, d, "orders")
    one = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.lit("CREDIT_TABLE").alias("matcher"))
    two = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("owner"), F.lit("KEYWORD").alias("matcher"))
    return at.early_exit(one.unionByName(two), ["CREDIT_TABLE", "KEYWORD"]).select("id", "owner", "matcher")


@query("SELECT o_orderkey AS id, c_name AS owner, coalesce(s_name, '') AS mail, coalesce(s_nationkey::VARCHAR, '') AS entity FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = c_custkey")
def assign_owner(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[F.lit("").alias(c) for c in ("owner", "mail", "entity")])
    customer = _t(spark, d, "customer")
    chosen = _t(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("owner"))
    agents = customer.join(_t(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_name").alias("owner"), F.col("s_name").alias("mail"), F.col("s_nationkey").cast("string").alias("entity"))
    return at.assign(rows, chosen, agents, "id")


_OPIN = "o AS (SELECT c_custkey AS id, n_name AS grp, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS opinion, r_name AS def FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 1)"


@query(f"WITH {_OPIN} SELECT id, grp, coalesce(opinion, def) AS opinion FROM o")
def default_opinion(spark, d):
    nation = _t(spark, d, "nation")
    rows = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("grp"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("opinion"))
    opinions = nation.join(_t(spark, d, "region").where("r_regionkey > 1"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("grp"), F.col("r_name").alias("default"))
    return enrich.default_opinion(rows, opinions)


@query("SELECT id, lot, CASE WHEN lot IS NOT NULL AND max((opinion = 'Défavorable')::INT) OVER (PARTITION BY lot) = 1 THEN 'Défavorable' ELSE opinion END AS opinion FROM (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 > 0 THEN o_custkey END AS lot, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Défavorable' ELSE o_orderpriority END AS opinion FROM orders)")
def opinion_group_override(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("lot"), F.when(F.col("o_orderpriority") == "1-URGENT", "Défavorable").otherwise(F.col("o_orderpriority")).alias("opinion"))
    return enrich.opinion_override(rows, "lot")


@query("SELECT o_orderkey AS id, concat_ws(chr(10), CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, c_name) AS \"Commentaires\", c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def merge_features(spark, d):
    orders = _t(spark, d, "orders")
    base = orders.select(F.col("o_orderkey").alias("id"), F.lit("").alias("Commentaires"))
    one = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("Commentaires"))
    two = orders.join(_t(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("Commentaires"), F.col("c_mktsegment").alias("segment"))
    return enrich.merge_results(base, [(one, ["Commentaires"]), (two, ["Commentaires", "segment"])], "id")


_WORDS30 = r"array_to_string(list_slice(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''), 1, 30), ' ')"


@query(f"""SELECT id, expose, corps, CASE WHEN starts_with(e, 'amendement redactionnel.') OR regexp_matches(e, 'correction d''erreur materielle|{'|'.join(tx.EDITORIAL[2:])}') THEN 'Amendement rédactionnel.' WHEN len(string_split(said, ' ')) > 25 THEN {_WORDS30.format("'court : ' || said")} ELSE said END AS objet
FROM (SELECT conv_id || '/' || turn AS id, text AS expose, role AS corps, {_SAID.format('text')} AS e, {_WORDS30.format("text || ' ' || role")} AS said FROM {_CONV})""")
def llm_fake(spark, d):
    """Summaries by a client that repeats the prompt's first thirty words; long ones are asked for once more."""
    rows = _talk(spark, d).select(F.concat("conv_id", F.lit("/"), "turn").alias("id"), F.col("text").alias("expose"), F.col("role").alias("corps"), F.lit("").alias("objet"))
    return enrich.summarise(rows, lambda: lambda p: " ".join(p.split()[:30]), "{{expose_amdt}} {{corps_amdt}}", "court : {{summary}}")


@query("SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS bal FROM supplier UNION ALL SELECT c_custkey + (SELECT max(s_suppkey) + 1 FROM supplier), c_name, c_acctbal FROM customer")
def union_align(spark, d):
    one = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    two = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return enrich.align_union([one, two], "id")


@query("SELECT sha256(text) AS hash FROM documents WHERE lang = 'en' INTERSECT SELECT sha256(text) FROM documents WHERE source < 'src2'")
def hash_intersect(spark, d):
    docs = _t(spark, d, "documents").withColumn("hash", F.sha2("text", 256))
    return docs.where("lang = 'en'").select("hash").intersect(docs.where("source < 'src2'").select("hash"))


@query("SELECT sha256(text) AS hash FROM documents WHERE lang = 'en' EXCEPT SELECT sha256(text) FROM documents WHERE source < 'src2'")
def hash_except(spark, d):
    docs = _t(spark, d, "documents").withColumn("hash", F.sha2("text", 256))
    return docs.where("lang = 'en'").select("hash").subtract(docs.where("source < 'src2'").select("hash"))


@query("SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1")
def latest_name_per_hash(spark, d):
    return enrich.latest_per_key(_t(spark, d, "events"), "user_id", "event_type", "ts")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 42 ELSE floor(epoch(ts))::BIGINT END AS seconds FROM events")
def epoch_default(spark, d):
    written = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return _t(spark, d, "events").select("event_id", epoch(written, 42).alias("seconds"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%er#%7%' AND c_name <> 'Customer#000000007' ORDER BY c_name LIMIT 10")
def ilike_page(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", "c_name").where(F.col("c_name").ilike("%er#%7%"))
    return catalogue.people_like(rows, "ER#", "Customer#000000007", "c_name")


@query("SELECT c_custkey, CASE WHEN coalesce(s_name, '') <> '' THEN s_name ELSE c_name END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def merge_keep_nonempty(spark, d):
    left = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    return enrich.keep_nonempty(left, _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), ["c_custkey"], ["name"])

# Search in the store, end to end: odd part numbers look for even ones.
_SOUGHT = "base AS (SELECT p_partkey AS id, p_brand, p_name AS text, p_size, p_type FROM part)"


@query(f"""WITH {_SOUGHT}, {_TFIDF.format(block='p_brand')}, {_COS.format(block='p_brand', cond='a.id % 2 = 1 AND b.id % 2 = 0')},
m AS (SELECT a AS new_id, b AS old_id, (length(o.text) - damerau_levenshtein(o.text, n.text)) / length(o.text) AS r, CASE WHEN o.p_size > 20 THEN length(o.p_type) ELSE 0 END AS size, o.p_size AS t, n.text FROM c JOIN base n ON n.id = a JOIN base o ON o.id = b WHERE cos >= 0.4),
k AS (SELECT new_id, list_reduce(list(struct_pack(id := old_id, r := r, size := size, t := t) ORDER BY old_id), lambda x, y: CASE WHEN (x.size = 0 AND y.size > 0) OR y.t > x.t THEN y ELSE x END) AS best FROM m WHERE r >= CASE WHEN starts_with(text, 'b') THEN 0.6 WHEN starts_with(text, 'bl') THEN 2 ELSE 0.3 END GROUP BY new_id)
SELECT new_id, best.id AS old_id, round(best.r, 6) AS ratio FROM k""")
def search_matches(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("amdt_idx"), "p_brand", F.col("p_name").alias("expose"), F.col("p_size").cast("long").alias("timestamp"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("Réponse"))
    out = search.matches(part.where("amdt_idx % 2 = 0"), part.where("amdt_idx % 2 = 1"), "expose", ["p_brand"], 0.4, 0.3, {"b": 0.6, "bl": 2.0}, "amdt_idx")
    return out.select("new_id", "old_id", F.round("ratio", 6).alias("ratio"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = (SELECT min_by(p_brand, p_partkey) FROM part WHERE p_size > 40) AND p_size <= 40")
def first_project_filter(spark, d):
    part = _t(spark, d, "part")
    return search.of_first_project(part.where("p_size <= 40"), part.where("p_size > 40"), "p_partkey", "p_brand").select("p_partkey", "p_brand")


def _tables(spark, d):
    """(id, html): a credit table of each order's lines, in the first format for odd orders, in the second for even ones."""
    line = _t(spark, d, "lineitem")
    q = F.floor("l_quantity").cast("string")
    gain, loss = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("1 "), q)).otherwise("0"), F.when(F.col("l_returnflag") != "N", q).otherwise("")
    name = F.concat(F.lit("Programme "), "l_returnflag", "l_linestatus")
    nested = F.concat(F.lit("<tr><td><p>"), name, F.lit("</p></td><td><p>"), gain, F.lit("</p></td><td><p>"), loss, F.lit("</p></td></tr>"))
    plain = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>"), gain, F.lit("</td><td>"), loss, F.lit("</td></tr>"))
    rows = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list(F.when(F.col("l_orderkey") % 2 == 1, nested).otherwise(plain)), "").alias("rows"))
    first = "<table><tr><td><p>Programmes</p></td><td><p>Autorisations d’engagement</p></td></tr><tr><td></td><td>+</td><td>-</td></tr>"
    second = "<table><tr><th>Programmes</th><th>+</th><th>-</th></tr>"
    opened = F.when(F.col("id") % 2 == 1, first).otherwise(second)
    return rows.select("id", F.concat(F.lit("<p>Modifier ainsi :</p>"), opened, "rows", F.lit("<tr><td>Solde</td><td>999</td><td>999</td></tr></table>")).alias("html"))


@query("""WITH g AS (SELECT l_orderkey AS id, 'programme ' || lower(l_returnflag || l_linestatus) AS program, CASE WHEN l_returnflag = 'N' THEN ('1' || floor(l_quantity)::BIGINT)::BIGINT ELSE 0 END AS plus, CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity)::BIGINT ELSE 0 END AS minus FROM lineitem),
f AS (SELECT id, max(plus) AS gain, max(minus) AS loss FROM g GROUP BY id)
SELECT DISTINCT id, program, 'owner of ' || program AS owner FROM g JOIN f USING (id) WHERE loss > 0 AND ((gain = 0 AND minus > 0) OR plus > 0)""")
def credit_owners(spark, d):
    """From the HTML of credit tables, in both formats, to owners."""
    line = _t(spark, d, "lineitem").select(F.concat(F.lit("programme "), F.lower(F.concat("l_returnflag", "l_linestatus"))).alias("program")).distinct()
    matcher = at.credit_matcher(line.withColumn("owner", F.concat(F.lit("owner of "), "program")), "Autorisations d’engagement", ("html",))
    return matcher.match(_tables(spark, d), "html").select("id", "program", "owner")


_AUTO = """h AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'alice' ELSE 'bob' END AS owner FROM orders WHERE o_orderpriority LIKE '1%'),
r AS (SELECT o_orderkey AS id, coalesce(h.owner, CASE o_orderkey % 2 WHEN 0 THEN 'zoe' ELSE 'yann' END) AS owner, h.owner IS NULL AS spare, o_orderstatus FROM orders LEFT JOIN h ON h.id = o_orderkey)"""


@query(f"""WITH {_AUTO} SELECT id, owner, CASE owner WHEN 'alice' THEN 'a@x' WHEN 'zoe' THEN 'z@x' ELSE '' END AS mail, CASE owner WHEN 'alice' THEN 'E1' ELSE '' END AS entity,
CASE WHEN spare THEN 'Attribution par défaut' ELSE 'Affectation sélectionnée: ' || owner || chr(10) || 'Affectations par mots clés dans ''t'' :' || chr(10) || owner || ' : [' || CASE owner WHEN 'alice' THEN 'urgent f' ELSE 'urgent' END || ' (x1)]' || CASE owner WHEN 'alice' THEN chr(10) || chr(10) || 'Autres affectations possibles:' || chr(10) || 'Affectations par mots clés dans ''t'' :' || chr(10) || 'bob : [urgent (x1)]' || chr(10) ELSE '' END END AS comment FROM r""")
def attribution_default(spark, d):
    """Keywords, vote, default owners, agents' mails and reasons; of two votes the smaller name wins."""
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.regexp_replace("o_orderpriority", "-", " "), F.lit(" "), "o_orderstatus").alias("t"))
    words = spark.createDataFrame([("urgent", "bob"), ("urgent f", "alice")], "keyword string, owner string")
    agents = spark.createDataFrame([("alice", "a@x", "E1"), ("zoe", "z@x", "")], "owner string, mail string, entity string")
    return at.attribute(rows, [at.keyword_matcher(words, ("t", "nowhere"))], "id", ["zoe", "yann"], agents)


# Small relational helpers and the catalogue.
@query("SELECT p_brand || '__' || substr(sha256(p_name), 1, 8) AS key, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'database') || '__' || substr(sha256(p_name), 1, 8) AS slug FROM part")
def slug_with_id(spark, d):
    mark = F.sha2("p_name", 256)
    return _t(spark, d, "part").select(F.concat("p_brand", F.lit("__"), F.substring(mark, 1, 8)).alias("key"), tx.slug_with_id(F.col("p_name"), mark).alias("slug"))


@query(r"SELECT p_partkey, trim(regexp_replace(CASE p_size % 4 WHEN 0 THEN 'APPEL : *' WHEN 1 THEN '[Sous-amendement] irr - ' WHEN 2 THEN 'Appel -rédactionnel Redactionnel IRR : ' ELSE 'IRR - x ' END || p_name, '(?i)\[sous-amendement\]|\*|REDACTIONNEL|Irr - |APPEL : |Appel -|IRR : ', '', 'g')) AS out FROM part")
def clean_summary(spark, d):
    size = F.col("p_size") % 4
    start = F.when(size == 0, "APPEL : *").when(size == 1, "[Sous-amendement] irr - ").when(size == 2, "Appel -rédactionnel Redactionnel IRR : ").otherwise("IRR - x ")
    return _t(spark, d, "part").select("p_partkey", tx.clean_expert_summary(F.concat(start, "p_name")).alias("out"))


@query("SELECT o_orderkey, epoch(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 0, 0, 0))::BIGINT AS seconds, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders")
def day_epoch(spark, d):
    day = F.col("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", tx.day_epoch(F.year(day), F.month(day), F.dayofmonth(day)).alias("seconds"), F.date_format(day, "yyyyMMdd").alias("stamp"))


@query("SELECT user_id, list_extract(list(epoch(ts)::BIGINT ORDER BY event_id) FILTER (event_id % 3 <> 0), 1) AS seconds FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")
def first_date(spark, d):
    """The first readable date of each user's events, in order; every third date can't be read."""
    written = F.when(F.col("event_id") % 6 == 0, "soon").when(F.col("event_id") % 3 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = _t(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", written.alias("at")))), lambda x: x["at"]).alias("dates"))
    return rows.select("user_id", batches.first_date(F.col("dates")).alias("seconds"))


@query("SELECT count(*) AS groups, sum(n)::BIGINT AS rows, max(n) AS largest, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def group_sizes(spark, d):
    return enrich.group_sizes(_t(spark, d, "orders"), ["o_custkey"]).withColumn("mean", F.round("mean", 6))


@query("SELECT sha256(p_type) AS hash, p_type AS description, string_agg(p_brand, ' & ' ORDER BY p_partkey) AS experts FROM part GROUP BY p_type")
def experts_by_description(spark, d):
    return enrich.experts_by_description(_t(spark, d, "part"), "p_type", "p_brand", "p_partkey")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names FROM events GROUP BY user_id")
def known_names(spark, d):
    return enrich.known_names(_t(spark, d, "events"), "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("names"))


@query("SELECT sha256(p_brand) AS hash, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS names FROM part GROUP BY p_brand")
def referrers(spark, d):
    manifests = _t(spark, d, "part").groupBy("p_type").agg(F.collect_list(F.sha2("p_brand", 256)).alias("hashes"))
    return enrich.referrers(manifests, "p_type", "hashes").select("hash", F.array_join("names", ",").alias("names"))


@query("SELECT DISTINCT trim(p_type) AS p_type FROM part WHERE trim(p_type) <> ''")
def missions_sorted(spark, d):
    return enrich.distinct_sorted(_t(spark, d, "part").withColumn("p_type", F.concat(F.lit(" "), "p_type")), "p_type")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_projects(spark, d):
    return _t(spark, d, "documents").select("source").where("source IS NOT NULL").distinct()


@query("SELECT o_orderkey, place, list_extract(['a', 'b', 'c'], 1 + place % 3) AS assigned FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS place FROM orders)")
def round_robin(spark, d):
    """A seeded permutation dealt to three names in turn."""
    return enrich.round_robin(_t(spark, d, "orders"), ["a", "b", "c"], [], 7, "o_orderkey").select("o_orderkey", "place", "assigned")


# Suppliers stand for manifests, nations for users, customers' nations for permissions.
_MANIFESTS = "m AS (SELECT s_suppkey AS key, s_name AS name, s_acctbal AS created, s_nationkey % 5 > 0 AS is_active FROM supplier), g AS (SELECT c_custkey % (SELECT count(*) FROM supplier) + 1 AS key, c_nationkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'reader' ELSE 'admin' END AS role FROM customer)"


def _catalogue(spark, d):
    supplier, customer = _t(spark, d, "supplier"), _t(spark, d, "customer")
    manifests = supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("created"), (F.col("s_nationkey") % 5 > 0).alias("is_active"))
    n = supplier.agg(F.count(F.lit(1)).alias("n"))
    role = F.when(F.col("c_custkey") % 3 == 0, "owner").when(F.col("c_custkey") % 3 == 1, "reader").otherwise("admin")
    return manifests, customer.join(n, F.lit(True)).select((F.col("c_custkey") % F.col("n") + 1).alias("key"), F.col("c_nationkey").alias("user_id"), role.alias("role"))


@query(f"WITH {_MANIFESTS} SELECT key, name, created, role FROM m JOIN g USING (key) WHERE is_active AND user_id = 3 AND role IN ('owner', 'admin')")
def granted_manifests(spark, d):
    return catalogue.granted(*_catalogue(spark, d), 3, ["owner", "admin"], "key", "created").select("key", "name", "created", "role")


@query(f"WITH {_MANIFESTS} SELECT key, role, user_id, n_name AS name FROM g LEFT JOIN nation ON n_nationkey = user_id AND n_nationkey < 12")
def permission_holders(spark, d):
    users = _t(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    return catalogue.holders(_catalogue(spark, d)[1], users).select("key", "role", "user_id", "name")


@query(f"WITH {_MANIFESTS} SELECT key, user_id, role FROM g WHERE role IN ('owner', 'reader')")
def role_filter(spark, d):
    return catalogue.with_roles(_catalogue(spark, d)[1], ["owner", "reader"])


@query(f"WITH {_MANIFESTS} SELECT key, name FROM m WHERE is_active")
def active_manifests(spark, d):
    return catalogue.active(_catalogue(spark, d)[0]).select("key", "name")


@query(f"WITH {_MANIFESTS} SELECT key, name FROM m WHERE key IN (SELECT key FROM g WHERE user_id = 7)")
def visible_manifests(spark, d):
    return catalogue.visible(*_catalogue(spark, d), 7, "key").select("key", "name")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def page_with_total(spark, d):
    return catalogue.page(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 25)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed b')")
def contains_search(spark, d):
    """Over lists of grams, of which only the part's own are read."""
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    path = f"{storing.shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    catalogue.write_grams(part, "p_partkey", "p_name", path)
    return catalogue.containing(part, spark.read.parquet(path), "eD B", "p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_rows(spark, d):
    return catalogue.newest_first(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query("SELECT s_name AS name, 'h' || n AS hash, s_name || '.json' AS filename, NULL::VARCHAR AS uploaded FROM supplier, (SELECT unnest([1, 2]) AS n)")
def manifest_files(spark, d):
    text = F.concat(F.lit('{"files": [{"hash": "h1", "filename": "'), "s_name", F.lit('.json"}, {"hash": "h2", "x": 1, "filename": "'), "s_name", F.lit('.json"}], "version": 2}'))
    return catalogue.manifest_files(_t(spark, d, "supplier").withColumn("j", text), "s_name", "j")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_nationkey::VARCHAR WHEN 1 THEN s_nationkey || '.5' ELSE s_name END AS number FROM supplier")
def whole_numbers(spark, d):
    nation = F.col("s_nationkey").cast("string")
    written = F.when(F.col("s_suppkey") % 3 == 0, F.concat(nation, F.lit(".0"))).when(F.col("s_suppkey") % 3 == 1, F.concat(nation, F.lit(".5"))).otherwise(F.col("s_name"))
    return _t(spark, d, "supplier").select("s_suppkey", at.whole_number(written).alias("number"))


@query("SELECT p_partkey, length(t) BETWEEN 2 AND 100 AND NOT regexp_matches(t, '[\\x00-\\x1F\\x7F<>&]') AS ok FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || '<b>' WHEN 1 THEN 'x' WHEN 2 THEN p_name || chr(9) ELSE p_name END AS t FROM part)")
def free_text_valid(spark, d):
    size = F.col("p_size") % 4
    t = F.when(size == 0, F.concat("p_name", F.lit("<b>"))).when(size == 1, "x").when(size == 2, F.concat("p_name", F.lit("\t"))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", tx.valid_free_text(t).alias("ok"))


@query("SELECT s_suppkey, 'pool/' || sha256(s_name) || '.json' AS key FROM supplier")
def content_keys(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", batches.content_key(F.col("s_name"), F.lit(".json")).alias("key"))


@query("SELECT c_custkey, CASE WHEN trim(t) = '' THEN 'vide ' || c_custkey ELSE t END AS text FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE c_name END AS t FROM customer)")
def placeholders(spark, d):
    t = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "  ").otherwise(F.col("c_name"))
    rows = _t(spark, d, "customer").select("c_custkey", t.alias("text"))
    return tx.fill_placeholder(rows, "text", generator=lambda: F.concat(F.lit("vide "), F.col("c_custkey").cast("string")))


_NEWEST = "row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey)"


def _answered(spark, d):
    """Parts as answered rows, whose statements are equal inside a block and differ between blocks; three files."""
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("amdt_idx"), F.col("p_size").cast("long").alias("timestamp"), F.col("p_brand").alias("Lecture"), F.lit("p").alias("origin_project"), F.col("p_type").alias("Num article"),
        F.col("p_type").alias("Corps amdt"), F.concat(F.lit("La marque "), "p_brand", F.lit(" et le type "), "p_type").alias("Exposé amdt"), F.lit("réponse").alias("Réponse"), F.concat(F.lit("h"), (F.col("p_partkey") % 3).cast("string")).alias("file_hash"),
    )


@query(f"SELECT p_brand AS lecture, p_type AS article, p_size::BIGINT AS seconds FROM part WHERE p_partkey % 3 <> 1 QUALIFY {_NEWEST} = 1")
def store_append(spark, d):
    """A kept store of two files, to which the third is added and from which the second is taken."""
    rows = _answered(spark, d)
    kept = store.KeptStore(spark, f"{storing.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept.create(rows.where("file_hash <> 'h2'"))
    kept.append(rows.where("file_hash = 'h2'"))
    kept.remove(["h1"])
    return kept.rows().select(F.col("Lecture").alias("lecture"), F.col("Num article").alias("article"), F.col("timestamp").alias("seconds"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size, p_type, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'défaut' ELSE p_brand END AS owner FROM part),
n AS (SELECT p_size, p_type, owner, count(*) AS n, min(id) AS seen FROM r WHERE owner IS NOT NULL AND owner <> 'défaut' GROUP BY 1, 2, 3),
v AS (SELECT p_size, p_type, owner FROM n QUALIFY row_number() OVER (PARTITION BY p_size, p_type ORDER BY n DESC, seen) = 1)
SELECT id FROM r LEFT JOIN v USING (p_size, p_type) QUALIFY row_number() OVER (PARTITION BY p_size, p_type ORDER BY coalesce(r.owner = v.owner, false) DESC, id) = 1""")
def allot_by_owner(spark, d):
    """Equal statements of an article count as one, the one of the owner whom most of them have."""
    owner = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, "défaut").otherwise(F.col("p_brand"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("amdt_idx"), F.col("p_size").cast("string").alias("Num article"), F.col("p_type").alias("Corps amdt"), F.col("p_type").alias("Exposé amdt"), owner.alias("Affectation (nom)"))
    kept, _ = features.allot(rows, ["Num article"], "Exposé amdt", 0.0001, 0.9999, features.keep_by_owner(["défaut"]))
    return kept.select(F.col("amdt_idx").alias("id"))


@query()
def enrichment_full(spark, d):
    """Prepare, allot, attribute, search the store, summarise, give opinions and similar rows of the batch, and give back, on part names as statements."""
    part = _t(spark, d, "part")
    batch = part.select(
        F.col("p_partkey").alias("amdt_idx"), F.col("p_partkey").alias("Num amdt"), F.col("p_size").cast("string").alias("Num article"), F.col("p_brand").alias("Lecture"), F.col("p_type").alias("Groupe"),
        F.concat(F.lit("Supprimer les mots "), "p_name").alias("Corps amdt"), F.concat("p_name", F.lit(" est un article de la marque "), "p_brand", F.lit(" et du type "), "p_type").alias("Exposé amdt"),
        F.lit("P").alias("origin_project"), *[F.lit("").alias(c) for c in ("Commentaires", "Affectation (nom)", "Objet amdt", "Avis du Gouvernement", "Allotissement", "Réponse")],
    )
    old = batch.where("amdt_idx % 7 = 0").withColumns({c: tx.normalize_text(F.col(c)) for c in ("Corps amdt", "Exposé amdt")})
    old = old.withColumns({"Réponse": F.concat(F.lit("Réponse à "), F.col("Num amdt").cast("string")), "Organe": F.lit("AN"), "timestamp": F.col("amdt_idx")})
    old = storing.stored(old)
    words = spark.createDataFrame([("article de la marque", "Alice"), ("copper", "Bob"), ("red", "Chloé")], "`Mots clés` string, `Prénom Nom` string")
    opinions = part.select(F.col("p_type").alias("grp")).distinct().withColumn("default", F.concat(F.lit("Avis "), "grp"))
    articles = part.select(F.col("p_size").cast("string").alias("article")).distinct().withColumn("owner", F.concat(F.lit("Article "), "article"))
    done, _ = features.enrich_batch(batch, ["Lecture", "Num article"], [features.attribution(words, legal=(_codes(spark, d), None), articles=articles), features.search(old, [search.Copy("Réponse")]), features.summary(lambda: lambda p: p[:40]), features.opinion(opinions), features.within_batch(("Lecture", "Num article"))])
    return done
