"""Queries of a run's own steps, with their SQL: preparing, sheets of the configuration, clusters by levels, the store, giving back.

Importing this registers them beside those of plans.queries.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from gregale.functions import text as tx
from gregale.operators import cluster
from gregale.plans import features, store
from gregale.plans.queries import _CUT, _DASHES, _GAGED, _ROMAN, _normal, _quoted, _singular, _t, query


def _folded(c: str) -> str:
    """ASCII transliteration: signs that don't decompose by the fixed table, others by their decomposition."""
    for k, v in tx._SEVERAL.items():
        c = f"replace({c}, '{k}', '{v}')"
    signs = {k: v for k, v in tx._ONE.items() if not unicodedata.normalize("NFD", k)[0].isascii()}
    into = "".join(signs.values()).replace("'", "''")
    return rf"regexp_replace(strip_accents(translate({c}, '{''.join(signs)}', '{into}')), '[^\x00-\x7F]', '', 'g')"


def _attribution(c: str) -> str:
    given = f"coalesce({c}, '')"
    c = _DASHES.format(f"lower({_folded(_ROMAN.format(given))})")
    split = tx.TOKEN_SPLIT[1:-2].replace("'", "''")
    pieces = f"list_transform(regexp_extract_all({c}, '[{split}]+|[^{split}]+'), lambda w: {_singular('w')})"
    return rf"trim(regexp_replace(array_to_string({pieces}, ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, coalesce({_normal(tighten=False)}, '') AS out FROM documents")
def normalize_standard(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.NORMALIZERS["similarity_search"](F.col("text")).alias("out"))


@query(f"SELECT doc_id, {_attribution('text')} AS out FROM documents")
def normalize_attribution(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.NORMALIZERS["attribution"](F.col("text")).alias("out"))


_SHORT_FORMS = [("CSG", "contribution sociale généralisée"), ("SNCF", "société nationale"), ("société", "grande société")]
_BATCH = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'Après l’article ' || p_size ELSE 'À la gare de la SNCF, ' || p_name END AS body,
CASE p_partkey % 5 WHEN 0 THEN 'Amendement rédactionnel.' WHEN 1 THEN p_name || '. La perte de recettes est compensée. La CSG augmente' WHEN 2 THEN NULL ELSE p_name || ' est un texte assez long pour rester comme il est, à la CSG près' END AS expose FROM part"""


def _spelt(c: str) -> str:
    for short, meaning in _SHORT_FORMS:
        c = f"replace({c}, '{short}', '{meaning}')"
    return _folded(c)


def _ungaged(c: str) -> str:
    """Without sentences about compensation; c has been folded."""
    return f"(SELECT array_to_string(list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN {_GAGED.format('i')} OR (i > 1 AND {_GAGED.format('i - 1')}) THEN NULL ELSE p[i] END), lambda x: x IS NOT NULL), '') FROM (SELECT {_CUT.replace('(t,', f'({c},')} AS p))"


_FLAG = f"regexp_matches(lower(expose), '{'|'.join(tx.EDITORIAL)}')".replace("d'erreur", "d''erreur")


@query(f"""WITH batch AS ({_BATCH}), plain AS (SELECT id, {_spelt('body')} AS body, {_spelt('expose')} AS expose FROM batch),
ready AS (SELECT id, {_ungaged('body')} AS body, {_ungaged('expose')} AS expose FROM plain WHERE expose IS NOT NULL)
SELECT id, body, {_FLAG} AS flag, CASE WHEN {_FLAG} OR length(expose) < {tx.SHORT} THEN expose || ' ' || body ELSE expose END AS expose FROM ready WHERE trim(body) <> '' AND trim(expose) <> ''""")
def prepared_batch(spark, d):
    """Acronyms spelt out one after the other, ASCII, no sentences about compensation, no blank rows; flags; short statements extended."""
    n, name = F.col("p_partkey"), F.col("p_name")
    body = F.when(n % 4 == 0, "  ").when(n % 4 == 1, F.concat(F.lit("Après l’article "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("À la gare de la SNCF, "), name))
    expose = F.when(n % 5 == 0, "Amendement rédactionnel.").when(n % 5 == 1, F.concat(name, F.lit(". La perte de recettes est compensée. La CSG augmente"))).when(n % 5 > 2, F.concat(name, F.lit(" est un texte assez long pour rester comme il est, à la CSG près")))
    batch = _t(spark, d, "part").select(n.alias("id"), body.alias("Corps amdt"), expose.alias("Exposé amdt"))
    return features.prepare_batch(batch, _SHORT_FORMS).select("id", F.col("Corps amdt").alias("body"), F.col("is_redactional").alias("flag"), F.col("Exposé amdt").alias("expose"))


@query("SELECT c_custkey, m AS mission FROM (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN 'Batiment et ' || c_mktsegment WHEN 1 THEN '' ELSE c_mktsegment END) AS m FROM customer) WHERE contains(m, 'batiment') OR contains(m, 'machin')")
def missions_kept(spark, d):
    mission = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Bâtiment et "), F.col("c_mktsegment"))).when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment"))
    return features.keep_missions(_t(spark, d, "customer").select("c_custkey", mission.alias("mission")), ["BÂTIMENT", "machin"], "mission")


@query("SELECT c_custkey, 'none' AS comments, 'none' AS summary, c_mktsegment AS opinion FROM customer")
def cleared_columns(spark, d):
    """Comments and what a summary overwrites become null; opinions stay, as theirs fills gaps alone."""
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("Commentaires"), F.col("c_name").alias("Objet amdt"), F.col("c_mktsegment").alias("Avis du Gouvernement"), F.col("c_mktsegment").alias("Groupe"))
    out = features.clear_columns(rows, [features.summary(None), features.opinion(rows, overwrite=False)])
    return out.select("c_custkey", F.coalesce("Commentaires", F.lit("none")).alias("comments"), F.coalesce("Objet amdt", F.lit("none")).alias("summary"), F.col("Avis du Gouvernement").alias("opinion"))


_AGENTS = "s AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'AGENT ' ELSE ' Agent ' END || c_custkey % 200 AS name, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS mail, c_mktsegment AS entity FROM customer)"


def _agents(spark, d):
    n = F.col("c_custkey")
    return _t(spark, d, "customer").select(
        n.alias("pos"), F.concat(F.when(n % 3 == 0, "AGENT ").otherwise(" Agent "), (n % 200).cast("string")).alias("Prénom Nom"), F.when(n % 7 > 0, F.col("c_name")).alias("Mail"), F.col("c_mktsegment").alias("Entité Pilote")
    )


@query(f"WITH {_AGENTS}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos) = 1) SELECT lower(trim(name)) AS owner, coalesce(mail, '') AS mail, entity FROM f QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY pos DESC) = 1")
def sheet_agents(spark, d):
    """The first of equal names; of names that are equal once folded, the last."""
    return features.agents(_agents(spark, d))


@query(f"WITH {_AGENTS} SELECT name, count(*) AS n FROM s GROUP BY name HAVING count(*) > 1")
def sheet_agents_repeated(spark, d):
    return features.repeated_agents(_agents(spark, d)).withColumnRenamed("Prénom Nom", "name")


_PROGRAMS = "s AS (SELECT CASE WHEN p_partkey % 10 > 0 THEN lower(p_brand) END AS owner, CASE WHEN p_partkey % 4 > 0 THEN 'Programmes d’aide aux ' || p_name END AS name, p_size::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.5' END AS number FROM part)"


@query(f"WITH {_PROGRAMS}, b AS (SELECT owner, name FROM s UNION ALL SELECT owner, number FROM s) SELECT DISTINCT {_attribution('name')} AS program, owner FROM b WHERE owner IS NOT NULL AND name IS NOT NULL")
def sheet_programs(spark, d):
    """Programmes by name and by number, each with all its owners."""
    n = F.col("p_partkey")
    return features.programs(_t(spark, d, "part").select(
        F.when(n % 10 > 0, F.col("p_brand")).alias("Prénom Nom"), F.when(n % 4 > 0, F.concat(F.lit("Programmes d’aide aux "), "p_name")).alias("Programme budgétaire"),
        (F.col("p_size") + F.when(n % 2 == 0, 0.0).otherwise(0.5)).alias("N° programme"),
    ))


_WORDS = "SELECT CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Les CSG des ' || p_name || 's' ELSE 'À l’usage : ' || p_name END AS words, p_brand AS owner FROM part"


@query(f"WITH w AS ({_WORDS}), k AS (SELECT {_attribution('replace(replace(words, $$CSG$$, $$contribution sociale généralisée$$), $$usage$$, $$emploi$$)')} AS keyword, lower(owner) AS owner FROM w) SELECT DISTINCT keyword, owner FROM k WHERE keyword <> ''")
def sheet_keywords(spark, d):
    """Key words with acronyms spelt out, normalised as the texts that they are looked for in; equal rows once."""
    n, name = F.col("p_partkey"), F.col("p_name")
    words = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("Les CSG des "), name, F.lit("s"))).otherwise(F.concat(F.lit("À l’usage : "), name))
    return features.keywords(_t(spark, d, "part").select(words.alias("Mots clés"), F.col("p_brand").alias("Prénom Nom")), [("CSG", "contribution sociale généralisée"), ("usage", "emploi")])


@query("SELECT c_mktsegment AS grp, 'Avis ' || max(c_custkey) AS \"default\" FROM customer GROUP BY c_mktsegment")
def sheet_opinions(spark, d):
    """Of equal groups the last row counts."""
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("Groupe"), F.concat(F.lit("Avis "), F.col("c_custkey").cast("string")).alias("Avis par défaut"), F.col("c_custkey").alias("pos"))
    return features.default_opinions(rows)


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'article ' || p_size ELSE 'article liminaire' END AS article, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS owner FROM part")
def sheet_articles(spark, d):
    n = F.col("p_partkey")
    number = F.when(n % 3 == 1, F.col("p_size").cast("string")).when(n % 3 == 2, "ARTICLE liminaire")
    return features.subsidiary(_t(spark, d, "part").select(number.alias("Numéro article"), F.when(n % 4 > 0, F.col("p_brand")).alias("Affectation (nom)")))


_TEXTS = ["Code de commerce", "Loi de finances", "Ordonnance du jour", "Projet de loi"]


@query(f"WITH s AS (SELECT list_extract([{_quoted(_TEXTS)}], 1 + p_partkey % 4) AS kind, 'Textes sur ' || p_name AS name, p_size::VARCHAR AS article, lower(p_brand) AS owner FROM part) SELECT DISTINCT {_attribution('name')} AS document, article, owner FROM s WHERE contains(lower(kind), 'loi')")
def sheet_laws(spark, d):
    """Laws of the sheet of legal texts, whose kind is told by a word of its column Type."""
    kind = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return features.legal_documents(_t(spark, d, "part").select(kind.alias("Type"), F.concat(F.lit("Textes sur "), "p_name").alias("Valeur"), F.col("p_size").alias("Articles"), F.col("p_brand").alias("Prénom Nom")), "LAW")


def _fit(i: int, block: str, least: float) -> str:
    """cl{i}: components of base{i} (block, id, text) by TF-IDF cosine inside blocks, fitted in each."""
    return rf"""t{i} AS MATERIALIZED (SELECT {block}, id, term, count(*) AS tf FROM (SELECT {block}, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')) AS term FROM base{i}) GROUP BY ALL),
f{i} AS (SELECT {block}, term, count(*) AS df FROM t{i} GROUP BY ALL), n{i} AS (SELECT {block}, count(DISTINCT id) AS n FROM base{i} GROUP BY ALL),
r{i} AS (SELECT t{i}.*, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS raw FROM t{i} JOIN f{i} USING ({block}, term) JOIN n{i} USING ({block})),
w{i} AS MATERIALIZED (SELECT {block}, id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {block}, id)) AS w FROM r{i}),
e{i} AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM w{i} a JOIN w{i} b USING ({block}, term) WHERE a.id <> b.id GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 9) >= {least}),
{_connected(i, 'cl')}"""


def _connected(i: int, name: str) -> str:
    return f"reach{i} AS (SELECT a AS id, b AS o FROM e{i} UNION SELECT reach{i}.id, e{i}.b FROM reach{i} JOIN e{i} ON e{i}.a = reach{i}.o), {name}{i} AS MATERIALIZED (SELECT id, least(id, min(o)) AS cluster FROM reach{i} GROUP BY id)"


def _levels(steps: list[float]) -> str:
    """Rows of clusters (id, cluster) after oversized ones are split with each of the steps in turn."""
    parts, kept = [], []
    for i, step in enumerate(steps):
        parts.append(f"""over{i} AS MATERIALIZED (SELECT cluster FROM cl{i} GROUP BY cluster HAVING count(*) > {cluster.LARGE}), large{i} AS MATERIALIZED (SELECT id, cluster FROM cl{i} WHERE cluster IN (SELECT cluster FROM over{i})),
base{i + 1} AS (SELECT cluster, id, text FROM large{i} JOIN base USING (id)), {_fit(i + 1, 'cluster', round(1 - step, 9))},
whole{i} AS (SELECT l.cluster FROM large{i} l LEFT JOIN cl{i + 1} s USING (id) GROUP BY l.cluster HAVING count(s.id) = 0)""")
        kept += [f"SELECT id, cluster FROM cl{i} WHERE cluster NOT IN (SELECT cluster FROM over{i})", f"SELECT id, cluster FROM large{i} WHERE cluster IN (SELECT cluster FROM whole{i})"]
    return ", ".join(parts) + " " + " UNION ALL ".join([*kept, f"SELECT id, cluster FROM cl{len(steps)}"])


@query(f"WITH RECURSIVE base AS (SELECT p_partkey AS id, p_brand, p_name AS text FROM part), base0 AS (SELECT * FROM base), {_fit(0, 'p_brand', 0.5)}, {_levels([0.25, 0.2, 0.15, 0.1])}")
def clusters_subdivided(spark, d):
    part = _t(spark, d, "part")
    found = cluster.tfidf_clusters(part, ["p_brand"], "p_partkey", "p_name", 0.5)
    return cluster.subdivide(found, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), 0.5)


_DISTANCE = "damerau_levenshtein(x.text, y.text) / greatest(length(x.text), length(y.text))"


@query(f"""WITH RECURSIVE answered AS (SELECT p_partkey AS amdt_idx, p_size::BIGINT AS "timestamp", p_brand AS "Lecture", 'p' AS origin_project, p_type AS "Num article", {_normal("(p_type || ' ' || p_type)")} AS "Corps amdt", {_normal("(p_name || ' ' || p_type || ' ' || p_type)")} AS "Exposé amdt", p_type AS "Réponse" FROM part WHERE p_size > 5),
base AS (SELECT "Lecture" AS lecture, "Num article" AS article, amdt_idx AS id, "Exposé amdt" AS text FROM answered), base0 AS (SELECT * FROM base), {_fit(0, 'lecture, article', 0.9)},
e1 AS (SELECT a.id AS a, b.id AS b FROM cl0 a JOIN cl0 b USING (cluster) JOIN base x ON x.id = a.id JOIN base y ON y.id = b.id WHERE a.id <> b.id AND {_DISTANCE} <= 0.01), {_connected(1, 'near')}
SELECT answered.* FROM answered LEFT JOIN near1 ON id = amdt_idx QUALIFY cluster IS NULL OR row_number() OVER (PARTITION BY cluster ORDER BY "timestamp" DESC, length("Réponse") DESC, amdt_idx) = 1""")
def store_build(spark, d):
    """Answered parts of a brand and type, one of each group of equal statements; groups of more than thirty would be split with the same threshold."""
    part = _t(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("amdt_idx"), F.col("p_size").cast("long").alias("timestamp"), F.col("p_brand").alias("Lecture"), F.lit("p").alias("origin_project"), F.col("p_type").alias("Num article"), F.col("p_type").alias("Corps amdt"), F.col("p_name").alias("Exposé amdt"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("Réponse"))
    return store.build(rows)


_GROUPS = "g AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS cluster, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)"


@query(f"""WITH {_GROUPS}, l AS (SELECT cluster, string_agg(id::VARCHAR, ',' ORDER BY id) AS label FROM g WHERE n > 1 GROUP BY cluster)
SELECT id, CASE WHEN n > 1 THEN CASE WHEN cluster % 11 > 0 AND cluster % 5 > 0 THEN 'objet ' || cluster END WHEN id % 11 = 0 THEN 'ancien ' || id WHEN id % 5 > 0 THEN 'objet ' || id END AS summary, label FROM g LEFT JOIN l USING (cluster)""")
def given_back(spark, d):
    """Kept rows' summaries for all rows of their groups, with the groups' numbers; single rows that no feature saw keep theirs."""
    part = _t(spark, d, "part")
    groups = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("cluster"), F.count(F.lit(1)).alias("n"))
    members = part.join(groups.where("n > 1").hint("merge"), ["p_brand", "p_size"]).select(F.col("p_partkey").alias("id"), "cluster")
    n = F.col("p_partkey")
    named = lambda word: F.concat(F.lit(word), n.cast("string"))
    original = part.select(n.alias("amdt_idx"), n.alias("Num amdt"), named("ancien ").alias("Objet amdt"))
    kept = part.join(members.where("id <> cluster").hint("merge"), n == F.col("id"), "left_anti").where(n % 11 > 0)
    enriched = kept.select(n.alias("amdt_idx"), F.when(n % 5 > 0, named("objet ")).alias("Objet amdt"))
    out = features.give_back(original, enriched, members, ["Objet amdt"])
    return out.select(F.col("amdt_idx").alias("id"), F.col("Objet amdt").alias("summary"), F.col("Allotissement").alias("label"))
