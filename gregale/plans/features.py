"""Features over a batch and their orchestration; loaders of the configuration's sheets.

A feature is a function of DataFrames that returns the row id and the columns that it owns. Features run on the rows that allotment
keeps; results are joined in declared order, and kept rows' values go back to all rows of their group.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gregale.functions import text as tx
from gregale.operators import attribution as at
from gregale.operators import cluster, dedup, enrich
from gregale.operators import search as find
from gregale.operators.storing import stored

log = logging.getLogger(__name__)
ID, COMMENTS, OWNER = "amdt_idx", "Commentaires", "Affectation (nom)"


#: (rows, groups (id, cluster)) -> the rows that stay.
Keep = Callable[[DataFrame, DataFrame], DataFrame]


class MissingColumns(ValueError):
    pass


@dataclass
class Feature:
    """transform: rows -> (amdt_idx, owned columns). prepare runs before any transform; its failure ends the run."""

    name: str
    requires: list[str]
    owns: list[str]
    transform: Callable[[DataFrame], DataFrame]
    prepare: Callable[[], None] | None = None
    overwrite: bool = True
    #: Which rows of near-identical ones stay while this feature runs; None: the first of each group.
    keep: Keep | None = None
    metrics: dict = field(default_factory=dict)


def require(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(", ".join(missing))


def clear_columns(df: DataFrame, features: list[Feature]) -> DataFrame:
    """Comments, and what enabled features overwrite, become null; columns that df lacks stay out."""
    cleared = {COMMENTS, *(c for f in features if f.overwrite for c in f.owns)}
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in df.columns if c in cleared})


def keep_missions(df: DataFrame, missions: list[str], column: str = "Mission") -> DataFrame:
    """Rows whose folded mission contains one of the given; the column is folded, null becomes empty. No missions: all rows as they are."""
    if not missions:
        return df
    folded = F.lower(tx.fold(F.coalesce(column, F.lit(""))))
    wanted: Column = F.lit(False)
    for m in missions:
        wanted = wanted | F.contains(folded, F.lower(tx.fold(F.lit(m))))
    return df.withColumn(column, folded).where(wanted)


def prepare_batch(df: DataFrame, acronyms: list[tuple[str, str]] = (), columns: tuple[str, ...] = ("Corps amdt", "Exposé amdt")) -> DataFrame:
    """Acronyms expanded, ASCII, sentences about compensation dropped; blank rows go; editorial rows are flagged, short statements extended."""
    df = df.withColumns({c: tx.drop_gage(tx.fold(tx.expand_acronyms(F.col(c), list(acronyms)))) for c in columns})
    for c in columns:
        df = df.where(~tx.is_blank(F.col(c)))
    body, expose = F.col("Corps amdt"), F.col("Exposé amdt")
    return df.withColumn("is_redactional", tx.is_editorial(expose)).withColumn("Exposé amdt", tx.extend_expose(expose, body))


def run_features(df: DataFrame, features: list[Feature]) -> tuple[DataFrame, dict[str, Exception]]:
    """df with all features' columns, and the failures: a feature that fails is left out, others go on.

    Each feature's result is computed and stored by itself, so that a fault of its tasks is its own, too. df should be a stored table.
    """
    for f in features:
        if f.prepare:
            f.prepare()
    results, failed = [], {}
    for f in features:
        try:
            require(df, f.requires)
            out = f.transform(df)
            require(out, [ID, *f.owns])
            results.append((stored(out.select(ID, *f.owns)), f.owns))
        except Exception as e:  # noqa: BLE001  a feature's fault is its own
            log.warning("feature %s failed: %s", f.name, e)
            failed[f.name] = e
    return enrich.merge_results(df, results, ID, COMMENTS), failed


def keep_first(df: DataFrame, groups: DataFrame) -> DataFrame:
    return dedup.keep_first(df, groups, ID, ID)


def keep_by_owner(defaults: list[str] = ()) -> Keep:
    """Of each group, the first row of the owner whom most of its rows have, default owners aside; else the first row."""

    def keep(df: DataFrame, groups: DataFrame) -> DataFrame:
        return dedup.keep_majority_owner(df, groups, ID, ID, OWNER, list(defaults)) if OWNER in df.columns else keep_first(df, groups)

    return keep


def allot(df: DataFrame, block: list[str], column: str, eps: float, threshold: float, keep: Keep = keep_first) -> tuple[DataFrame, DataFrame]:
    """(kept rows, groups (id, cluster)): near-identical rows of a block, of which one stays, as keep says."""
    body = tx.disambiguate_body(F.col("Corps amdt"), F.col("Num article"))
    ready = df.withColumn("Corps amdt", body).where(~tx.is_blank(F.col(column))).withColumn("__text", tx.normalize_text(F.col(column)))
    _, groups = cluster.get_clusters(stored(ready), block, ID, "__text", eps, threshold)
    return keep(df, groups), groups


def give_back(original: DataFrame, enriched: DataFrame, groups: DataFrame, columns: list[str], num_col: str = "Num amdt") -> DataFrame:
    """All original rows with the enriched columns: their own, or those of their group's fullest row; groups get their label.

    Rows that no feature saw, as blank ones are, keep what they had. All tables grow with the batch, and are merged, never broadcast.
    """
    given = enriched.select(F.col(ID).alias("__given"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = original.join(given.hint("merge"), original[ID] == F.col("__given"), "left").join(groups.select(F.col("id").alias("__member")).hint("merge"), original[ID] == F.col("__member"), "left")
    had = lambda c: F.when(F.col("__member").isNull(), F.col(c)) if c in original.columns else F.lit(None)
    values = {c: F.when(F.col("__given").isNotNull(), F.col(f"__{c}")).otherwise(had(c)) for c in columns}
    full = rows.withColumns(values).select(*dict.fromkeys([*original.columns, *columns]))
    out = dedup.populate(full, groups, ID, ID, columns)
    # a label is as long as its group: it comes last, by the group, and travels once
    out = out.drop("Allotissement").join(groups.select(F.col("id").alias("__id"), F.col("cluster").alias("__cluster")).hint("merge"), out[ID] == F.col("__id"), "left")
    named = dedup.group_labels(original, groups, ID, num_col).select(F.col("cluster").alias("__named"), F.col("label").alias("Allotissement"))
    return out.join(named.hint("merge"), F.col("__cluster") == F.col("__named"), "left").drop("__id", "__cluster", "__named")


# Sheets of the configuration workbook.
def acronyms(sheet: DataFrame) -> list[tuple[str, str]]:
    """In the sheet's order (pos); the last of equal acronyms counts. A dictionary of words, kept by hand; above 10,000 is an error."""
    last = sheet.groupBy("Acronyme").agg(F.max_by("Développement", "pos").alias("meaning"), F.min("pos").alias("pos"))
    rows = last.orderBy("pos").select("Acronyme", "meaning").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 acronyms")
    return [(r[0], r[1]) for r in rows]


def keywords(sheet: DataFrame, acronyms: list[tuple[str, str]] = ()) -> DataFrame:
    """(keyword, owner): acronyms spelt out as they stand, then normalised; names in lower case; equal rows once."""
    text = F.col("Mots clés")
    for short, meaning in acronyms:
        text = F.replace(text, F.lit(short), F.lit(meaning))
    rows = sheet.select(tx.normalize_attribution(text).alias("keyword"), F.lower("Prénom Nom").alias("owner"))
    return rows.where(F.col("keyword") != "").dropDuplicates(["keyword", "owner"])


# The kinds of legal texts, as the sheet's column Type contains them.
LEGAL_KINDS = {"CODE": "code", "LAW": "loi", "ORDONNANCE": "ordonnance"}


def legal_documents(sheet: DataFrame, kind: str) -> DataFrame:
    """(document, article, owner) of one kind of text (CODE, LAW, ORDONNANCE)."""
    rows = sheet.where(F.contains(F.lower("Type"), F.lit(LEGAL_KINDS[kind])))
    return rows.select(tx.normalize_attribution(F.col("Valeur")).alias("document"), tx.normalize_attribution(F.col("Articles").cast("string")).alias("article"), F.lower("Prénom Nom").alias("owner")).distinct()


def programs(sheet: DataFrame) -> DataFrame:
    """(program, owner): a programme is known by its name and by its number."""
    rows = sheet.where(F.col("Prénom Nom").isNotNull()).select(F.lower("Prénom Nom").alias("owner"), F.col("Programme budgétaire").alias("name"), at.whole_number(F.col("N° programme").cast("string")).alias("number"))
    both = rows.select("owner", "name").unionByName(rows.select("owner", F.col("number").alias("name"))).where(F.col("name").isNotNull())
    return both.select(tx.normalize_attribution(F.col("name")).alias("program"), "owner").distinct()


def agents(sheet: DataFrame) -> DataFrame:
    """(owner, mail, entity); of equal names the first (pos) counts, before case is folded; of names equal then, the last."""
    first = sheet.groupBy("Prénom Nom").agg(F.min_by(F.struct("Mail", "Entité Pilote"), "pos").alias("a"), F.min("pos").alias("pos"))
    last = first.groupBy(F.lower(F.trim("Prénom Nom")).alias("owner")).agg(F.max_by("a", "pos").alias("a"))
    return last.select("owner", F.coalesce("a.Mail", F.lit("")).alias("mail"), F.coalesce("a.Entité Pilote", F.lit("")).alias("entity"))


def repeated_agents(sheet: DataFrame) -> DataFrame:
    """(Prénom Nom, n) of names that the sheet holds more than once."""
    return sheet.groupBy("Prénom Nom").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def default_owners(sheet: DataFrame, most: int = 1000) -> list[str]:
    """Names in the sheet's order (pos), in lower case; above `most` is an error."""
    rows = sheet.orderBy("pos").select(F.lower("Prénom Nom")).where(F.col("Prénom Nom").isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} default owners")
    return [r[0] for r in rows]


def default_opinions(sheet: DataFrame) -> DataFrame:
    """(grp, default); of equal groups the last (pos) counts."""
    return sheet.groupBy(F.col("Groupe").alias("grp")).agg(F.max_by("Avis par défaut", "pos").alias("default"))


def subsidiary(sheet: DataFrame) -> DataFrame:
    """(article, owner): articles in lower case, beginning with "article " unless empty."""
    name = F.coalesce(F.lower(F.col("Numéro article").cast("string")), F.lit(""))
    return sheet.select(F.when((F.trim(name) != "") & ~name.startswith("article "), F.concat(F.lit("article "), name)).otherwise(name).alias("article"), F.coalesce("Affectation (nom)", F.lit("")).alias("owner"))


OWNED_BY_ATTRIBUTION = [OWNER, "Affectation (email)", "Entité Pilote", COMMENTS]


def attributed(matchers: list[at.Matcher], defaults: list[str] = (), infos: DataFrame | None = None, early: bool = False, overwrite: bool = True) -> Feature:
    """Owner, mail, entity and reasons, by the vote of matchers, or a default owner; early: the first matcher that matches decides alone."""

    def transform(df: DataFrame) -> DataFrame:
        out = at.attribute(df, matchers, ID, list(defaults), infos, early, overwrite)
        return out.select(F.col("id").alias(ID), F.col("owner").alias("Affectation (nom)"), F.col("mail").alias("Affectation (email)"), F.col("entity").alias("Entité Pilote"), F.col("comment").alias(COMMENTS))

    needs = ["is_redactional", "Num article"] if any(m.name == "REDACTIONAL" for m in matchers) else []
    return Feature("attribution", [ID, *needs], OWNED_BY_ATTRIBUTION, transform, overwrite=overwrite, keep=keep_by_owner(defaults))


def attribution(
    keyword_sheet: DataFrame, columns: tuple[str, ...] = ("Exposé amdt",), order: tuple[str, ...] = (), legal: tuple[DataFrame, list[str] | None] | None = None,
    credit: tuple[DataFrame, str] | None = None, articles: DataFrame | None = None, raw_body: str = "Corps amdt original", defaults: list[str] = (), infos: DataFrame | None = None,
) -> Feature:
    """Owner by keywords and law references of the columns, by the credit table of raw_body, and by the article of editorial rows.

    legal: documents (document, article, owner) and patterns of their names, or None for codes; credit: (program, owner), programs normalised, and the type of credits;
    articles: (article, owner). What isn't given doesn't match. With an order of matchers (KEYWORD, LEGAL, CREDIT_TABLE, REDACTIONAL),
    the first that matches decides alone.
    """
    words = keyword_sheet.select(tx.normalize_attribution(F.col("Mots clés")).alias("keyword"), F.col("Prénom Nom").alias("owner")).where(F.col("keyword") != "").dropDuplicates()
    given = {"KEYWORD": at.keyword_matcher(words, columns)}
    if legal is not None:
        given["LEGAL"] = at.Matcher("LEGAL", columns, lambda df, c: at.legal_matches(df, *legal, "id", c))
    if credit is not None:
        given["CREDIT_TABLE"] = at.credit_matcher(*credit, (raw_body,))
    if articles is not None:
        given["REDACTIONAL"] = at.editorial_matcher(articles)
    if order and (missing := [k for k in given if k not in order]):
        raise ValueError(f"the order lacks {', '.join(missing)}")
    return attributed([given[k] for k in (order or given) if k in given], defaults, infos, early=bool(order))


def budget_attribution(sheets: dict[str, DataFrame], overwrite: bool = True) -> Feature:
    """The preset of budget bills: credit tables, then keywords of the statement; the first that matches decides."""
    matchers = [
        at.credit_matcher(programs(sheets["Responsables de programme"]), "Autorisations d’engagement"),
        at.keyword_matcher(keywords(sheets["Mots clés"], acronyms(sheets["Acronymes"])), ("Exposé amdt",)),
    ]
    return attributed(matchers, default_owners(sheets["Attribution par défaut"]), agents(sheets["Infos Agents"]), early=True, overwrite=overwrite)


def social_attribution(sheets: dict[str, DataFrame], overwrite: bool = True) -> Feature:
    """The preset of social security bills: keywords of statement and body, and codes, laws and ordinances of the body; all matches vote."""
    matchers = [at.keyword_matcher(keywords(sheets["Mots clés"], acronyms(sheets["Acronymes"])), ("Exposé amdt", "Corps amdt"))]
    matchers += [at.legal_matcher(kind, legal_documents(sheets["Code et Article"], kind), ("Corps amdt",)) for kind in LEGAL_KINDS]
    return attributed(matchers, default_owners(sheets["Attribution par défaut"]), agents(sheets["Infos Agents"]), overwrite=overwrite)


#: By name of the project.
PRESETS = {"PLF": budget_attribution, "PLFSS": social_attribution}


def search(
    store: DataFrame, copies: list[find.Copy], thresholds: dict[str, float] | None = None, ratios: dict[str, float] | None = None,
    overrides: dict[str, dict[str, float]] | None = None, blocks: dict[str, list[str]] | None = None, same_project: tuple[str, ...] = ("Corps amdt",), overwrite: bool = True,
    filters: dict[str, find.ColumnFilter] | None = None,
) -> Feature:
    """Answers of the most similar row of the historical store, copied, and a comment that says where from.

    store: rows as plans.store.build makes them. For each column: candidates by TF-IDF cosine (thresholds), inside blocks, then by
    edit distance over the old text's length (ratios; overrides by the new text's beginning); columns of same_project look only at
    rows of the first new row's project, and those of filters at the old rows that their filter gives. The match of the highest ratio
    over columns gives its answers.
    """
    if not copies:
        raise ValueError("no columns to copy")
    thresholds = thresholds or {"Exposé amdt": 0.4, "Corps amdt": 0.4}
    ratios = {"Exposé amdt": 0.4, "Corps amdt": 0.9} | (ratios or {})
    overrides = overrides if overrides is not None else {"Exposé amdt": {"amendement redactionnel": 0.95}}
    blocks = blocks if blocks is not None else {"Corps amdt": ["Num article"]}
    chosen = {c: find.of_first_project for c in same_project} | (filters or {})
    owns = [*dict.fromkeys(c.column for c in copies if c.enabled and c.column in store.columns), COMMENTS]

    def transform(df: DataFrame) -> DataFrame:
        rows = df.where(~tx.is_blank(F.col("Exposé amdt")) & ~tx.is_blank(F.col("Corps amdt")))
        rows = rows.withColumns({c: tx.normalize_standard(F.col(c)) for c in ("Exposé amdt", "Corps amdt")})
        rows = stored(rows.withColumn("Corps amdt", tx.disambiguate_body(F.col("Corps amdt"), F.col("Num article"))))  # read by each column's joins
        by_column = []
        for c, least in thresholds.items():
            old = chosen[c](store, rows, ID) if c in chosen else store
            by_column.append((c, find.matches(old, rows, c, blocks.get(c, []), least, ratios.get(c, 0.9), overrides.get(c, {}), ID)))
        old = store.select(F.col(ID).alias("id"), F.col("Num amdt").alias("num"), F.col("Lecture").alias("lecture"), F.col("Organe").alias("organe"), F.col("origin_project").alias("project"), *[c for c in owns if c != COMMENTS])
        target = df.select(F.col(ID).alias("id"), F.lit(None).cast("string").alias(COMMENTS), *[c for c in owns if c != COMMENTS and c in df.columns])
        return find.copy_columns(target, old, find.merge_matches(by_column), copies, overwrite).withColumnRenamed("id", ID)

    return Feature("similarity_search", [ID, "Exposé amdt", "Corps amdt", "Num article", "origin_project"], owns, transform, overwrite=overwrite)


def within_batch(block: tuple[str, ...] = ("Num article",), column: str = "Exposé amdt", eps: float = 0.4, threshold: float = 0.8) -> Feature:
    """Rows of the same cluster, with their similarity in percent, as the comment of rows that have none."""

    def transform(df: DataFrame) -> DataFrame:
        ready = stored(df.where(~tx.is_blank(F.col(column))).withColumn("__text", tx.normalize_text(F.col(column))))
        clusters, _ = cluster.get_clusters(ready, list(block), ID, "__text", eps, threshold)
        texts = ready.select(F.col(ID).alias("id"), F.col("__text").alias("text"))
        rows = clusters.join(texts, "id").join(df.select(F.col(ID).alias("id"), F.col("Num amdt").alias("num")), "id")
        similar = enrich.similar_in_clusters(rows)
        free = df.where(F.coalesce(F.col(COMMENTS) == "", F.lit(True))).select(ID)
        return similar.withColumnRenamed("id", ID).join(free, ID, "left_semi").select(ID, F.col("comment").alias(COMMENTS))

    return Feature("within_batch", [ID, "Num amdt", COMMENTS, column, *block], [COMMENTS], transform)


def summary(client, prompt: str = "{{expose_amdt}} {{corps_amdt}}", again: str = "{{summary}}", overwrite: bool = True, callers: list[enrich.Caller] = ()) -> Feature:
    """Summaries of statement and body, by client or a pool of callers; without overwrite, rows that have one keep it."""

    def transform(df: DataFrame) -> DataFrame:
        had = F.col("Objet amdt") if "Objet amdt" in df.columns else F.lit(None).cast("string")
        rows = df.select(F.col(ID).alias("id"), F.col("Exposé amdt").alias("expose"), F.col("Corps amdt").alias("corps"), had.alias("objet"))
        return enrich.summarise(rows, client, prompt, again, overwrite, callers=callers).select(F.col("id").alias(ID), F.col("objet").alias("Objet amdt"))

    return Feature("summary", [ID, "Exposé amdt", "Corps amdt"], ["Objet amdt"], transform, overwrite=overwrite)


def opinion(sheet: DataFrame, overwrite: bool = True, lot: str | None = None) -> Feature:
    """The group's default opinion; without overwrite only where none is given; with a lot, one unfavourable opinion makes all of the lot so."""

    def transform(df: DataFrame) -> DataFrame:
        had = F.col("Avis du Gouvernement") if "Avis du Gouvernement" in df.columns else F.lit(None).cast("string")
        rows = df.select(ID, F.col("Groupe").alias("grp"), had.alias("opinion"), *([F.col(lot).alias("__lot")] if lot else []))
        out = enrich.default_opinion(rows, sheet, overwrite)
        out = enrich.opinion_override(out, "__lot") if lot else out
        return out.select(ID, F.col("opinion").alias("Avis du Gouvernement"))

    return Feature("opinion", [ID, "Groupe", *([lot] if lot else [])], ["Avis du Gouvernement"], transform, overwrite=overwrite)


def enrich_batch(batch: DataFrame, block: list[str], features: list[Feature], column: str = "Exposé amdt", eps: float = 0.4, threshold: float = 0.9) -> tuple[DataFrame, dict[str, Exception]]:
    """The whole run: prepare, clear, allot, features, and kept rows' values given back to their groups.

    What a failed feature owns stays as the batch has it, as do the rows that preparing left out. Near-identical rows are thinned as
    the first feature that has a say in it wants.
    """
    ready = stored(clear_columns(prepare_batch(batch), features))
    kept, groups = allot(ready, block, column, eps, threshold, next((f.keep for f in features if f.keep), keep_first))
    done, failed = run_features(stored(kept), features)
    owned = [c for c in dict.fromkeys(c for f in features if f.name not in failed for c in f.owns) if c in done.columns]
    return give_back(batch, done, stored(groups), owned), failed
