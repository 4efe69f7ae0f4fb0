"""Who should handle a row: dictionary, legal reference, credit table and editorial matchers, vote and explanation.

A matcher gives (id, owner, matcher, column, keyword, document, article, program), one row per hit; details that it has none of are
null. Dictionaries are small: Spark broadcasts them where their size allows it, and joins them by shuffle beyond.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gregale.functions.text import TOKEN_SPLIT, normalize_attribution
from gregale.operators.storing import stored

#: First words of phrases that a plan may hold.
HEADS = 10_000
DETAILS = ("keyword", "document", "article", "program")
# Where a credit table opens a line of its own, keywords decide instead.
NEW_LINE = "ligne nouvelle|nouveau programme|creer le programme"


def _matches(df: DataFrame, matcher: str, column: str) -> DataFrame:
    return df.select("id", "owner", F.lit(matcher).alias("matcher"), F.lit(column).alias("column"), *[F.col(d) if d in df.columns else F.lit(None).cast("string").alias(d) for d in DETAILS])


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), TOKEN_SPLIT), lambda w: F.trim(w) != "")


def keyword_matches(df: DataFrame, keywords: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per occurrence of a phrase of keywords (keyword, owner), overlapping ones included, and owner.

    Texts meet phrases on the phrase's first word; as many words after it as the phrase has are compared then.
    """
    phrases = keywords.dropDuplicates(["keyword", "owner"]).withColumn("words", tokens(F.col("keyword"))).where(F.size("words") > 0).withColumn("head", F.col("words")[0])
    words = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("text"))
    # a dictionary is kept by hand: its first words fit into the plan, and only they are looked at; a longer one meets all words in the join
    facts = phrases.groupBy("head").agg(F.max(F.size("words")).alias("n")).limit(HEADS + 1).collect()
    longest = max((r.n for r in facts), default=1) if len(facts) <= HEADS else phrases.agg(F.max(F.size("words"))).first()[0]
    begins = F.transform("text", lambda w, i: F.struct(w.alias("head"), i.alias("at")))
    begins = F.filter(begins, lambda x: x["head"].isin([r.head for r in facts])) if len(facts) <= HEADS else begins
    windows = F.transform(begins, lambda x: F.struct(x["head"].alias("head"), F.slice("text", x["at"] + 1, F.lit(longest)).alias("window")))
    hits = words.select("id", F.explode(windows).alias("w")).select("id", "w.*").join(phrases, "head").where(F.slice("window", F.lit(1), F.size("words")) == F.col("words"))
    return _matches(hits, "KEYWORD", text_col)


# How texts cite codes, laws and ordinances, after folding.
LAW = [r"\sloi\s(?:n.?(?:deg)?\s?)((?:(?:\d+-\d+)\s+)?du\s+(?:\d+\s\w+\s\d{4}))", r"\sloi\s(du\s+(?:\d+\s\w+\s\d{4}))"]
ORDINANCE = [r"ordonnance\s(?:n.?(?:deg)?\s?)((?:(?:\d+-\d+)\s+)?du\s+(?:\d+\s\w+\s\d{4}))"]


CODE = r"code\s"
BEFORE_NAME = [r"general\sdes", r"general\sde", "des", "de", "du", r"de\sla", "d'"]


def cited_codes(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, document), once each: the codes (document) that a text (id, text) cites by name.

    Names stand after "code", with or without one of BEFORE_NAME between, and as they are. The first of these words after which a name
    begins counts, and of several names that begin there the longest. What follows each "code" meets the names on as many letters as the shortest name has, so that the
    dictionary may be of any length; a name within a longer one that was cited isn't looked at.
    """
    names = documents.select("document").where("document <> ''").distinct().withColumn("size", F.length("document"))
    bounds = names.agg(F.min("size").alias("least"), F.max("size").alias("most")).first()
    if bounds.least is None:
        return rows.select("id", F.lit(None).cast("string").alias("document")).limit(0)
    # what stands after each "code", up to the longest name; by the text's places, as names may hold that word, too
    parts = F.split("text", rf"(?={CODE})")
    at = rows.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.lit(bounds.most // 5 + 2)), ""))).alias("place", "rest"))
    at = at.where(F.col("rest").rlike(f"^{CODE}")).withColumn("rest", F.substring("rest", 1, bounds.most + 40))
    tails = [F.regexp_extract("rest", f"(?s)^{CODE}{word}{space}(.*)", 1) for word in (*BEFORE_NAME, "") for space in (r"\s", "")]
    starts = F.filter(F.transform(F.array(*tails), lambda t, i: F.struct((-i).alias("turn"), t.alias("tail"), F.substring(t, 1, bounds.least).alias("head"))), lambda s: F.length(s["head"]) == bounds.least)
    named = at.select("id", "place", F.explode(starts).alias("s")).select("id", "place", "s.*")
    met = named.join(names.withColumn("head", F.substring("document", 1, bounds.least)), "head").where(F.col("tail").startswith(F.col("document")))
    return met.groupBy("id", "place").agg(F.max_by("document", F.struct("turn", "size")).alias("document")).select("id", "document").distinct()


# How texts cite articles, after folding.
def article_pattern(ordinals: list[str]) -> str:
    """Of several articles in a row the last is captured."""
    rest = rf"(?:\s?(?:{'|'.join(sorted(ordinals, reverse=True))}))?" if ordinals else ""
    return rf"(?:l\.|articles?|art\.?)(?:\set\s|\s?(\d+(?:-\d+)*{rest}))+"


def legal_matches(df: DataFrame, documents: DataFrame, patterns: list[str] | None, id_col: str, text_col: str, ordinals: list[str] = (), matcher: str = "LEGAL") -> DataFrame:
    """Rows of documents (document, article, owner) of which a text cites both, wherever in it.

    patterns: how texts cite documents, whose first group is the document; None: by the documents' names, as codes are.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    articles = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(article_pattern(list(ordinals))), F.lit(1)), lambda a: F.trim(a)))
    given = rows.select("id", F.explode(articles).alias("article"))
    if patterns is None:
        cited = cited_codes(rows, documents)
    else:
        cited = rows.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])))).alias("document"))
    return _matches(cited.join(given, "id").join(documents, ["document", "article"]), matcher, text_col)


class _Table(HTMLParser):
    """Cells of the tables of a text: rows of (is header, text, text of the first paragraph)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.cell: list | None = None
        self.in_p = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and self.tables[-1] and tag in ("td", "th"):
            self.cell, self.in_p = [tag == "th", "", None], 0  # an open paragraph ends
            self.tables[-1][-1].append(self.cell)
        elif tag == "p" and self.cell is not None and self.cell[2] is None:
            self.cell[2], self.in_p = "", 1

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell, self.in_p = None, 0
        elif tag == "p":
            self.in_p = 0

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1] += data
            if self.in_p:
                self.cell[2] += data


#: Markup of which a table's tags, without attributes, and texts without references are all: the parser would say the same of it.
_PLAIN_MARKUP = re.compile(r"(?:[^<&]++|</?(?:table|tr|td|th|p)>)*+")
_PLAIN_TAG = re.compile(r"<(/?(?:table|tr|td|th|p))>")


def _tables(markup: str) -> list[list[list[list]]]:
    """The tables of _Table; plain markup is cut at its tags, without the parser."""
    parser = _Table()
    if not _PLAIN_MARKUP.fullmatch(markup):
        parser.feed(markup)
        parser.close()
        return parser.tables
    pieces = _PLAIN_TAG.split(markup)
    for tag, text in zip(pieces[1::2], pieces[2::2]):  # what stands before the first tag is in no cell
        if tag[0] == "/":
            parser.handle_endtag(tag[1:])
        else:
            parser.handle_starttag(tag, ())
        if text:
            parser.handle_data(text)
    return parser.tables


CREDIT_ROWS = "array<struct<program:string,plus:string,minus:string,error:string>>"


def credit_rows(credit_type: str):
    """A function column: the raw (program, +, -) rows of a text's credit table.

    A table that names credit_type has a header of two lines, of which that type's pair of columns counts; it goes before a table
    with header cells Programmes, + and -. Texts without such a table give null; a table that lacks one of these gives one row with an
    error and no program, so that the row fails, not the job.
    """

    def parse(markup: str | None) -> list[dict] | None:
        if not markup:
            return None
        tables = _tables(markup)
        cell = lambda c: (c[1] if c[2] is None else c[2]).strip()
        for table in tables:
            if any(credit_type in c[1] for row in table for c in row) and len(table) >= 3:
                at = next((i for i, c in enumerate(table[0]) if credit_type in cell(c)), None)
                if at is None:
                    return None
                pick = lambda row, i: cell(row[i]) if 0 <= i < len(row) else "0"
                return [{"program": cell(r[0]), "plus": pick(r, 2 * at - 1), "minus": pick(r, 2 * at)} for r in table[2:] if len(r) > 1]
        for table in tables:
            heads = [c[1].strip() for row in table for c in row if c[0]]
            if heads:
                if not {"Programmes", "+", "-"} <= set(heads):
                    return [{"program": None, "plus": None, "minus": None, "error": "a credit table lacks Programmes, + or -"}]
                p, plus, minus = (heads.index(h) for h in ("Programmes", "+", "-"))
                return [{"program": r[p][1].strip(), "plus": r[plus][1].strip(), "minus": r[minus][1].strip()} for r in table[1:] if len(r) > max(p, plus, minus)]
        return None

    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("program", "plus", "minus", "error")]))

    @F.arrow_udf(CREDIT_ROWS)
    def rows(markup: pa.Array) -> pa.Array:
        return pa.array([parse(m) for m in markup.to_pylist()], kind)

    return rows


def amount(c: Column) -> Column:
    """Digits alone: signs and decimal points vanish; without digits 0."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("long"), F.lit(0))


def whole_number(c: Column) -> Column:
    """5.0 as 5; other texts as they are."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(c)


def credit_matches(tables: DataFrame, owners: DataFrame, column: str = "Corps amdt original") -> DataFrame:
    """Matches of tables (id, program, plus, minus), programs normalised, with owners (program, owner).

    Nothing where a new line is opened. Where nothing is added and something taken, programs that lose count; where something is
    taken, programs that gain.
    """
    rows = tables.where(F.col("id").isNotNull() & ~F.lower("program").isin("total", "solde"))  # nor rows without a program
    # tables are read once: an id's facts go beside its rows, where a join would make the rows for either side
    own = Window.partitionBy("id")
    known = rows.withColumns({"new": F.max(F.col("program").rlike(NEW_LINE)).over(own), "gain": F.max("plus").over(own), "loss": F.max("minus").over(own)}).where(~F.col("new") & (F.col("loss") > 0))
    picked = known.where(((F.col("gain") == 0) & (F.col("minus") > 0)) | (F.col("plus") > 0)).select("id", "program").distinct()
    return _matches(picked.join(owners.select("program", "owner").distinct(), "program"), "CREDIT_TABLE", column)


def program_owners(programs: DataFrame) -> DataFrame:
    """(program, owner) from (name, number, owner): a programme is known by its name and by its number."""
    by_number = programs.select(whole_number(F.col("number").cast("string")).alias("program"), "owner")
    return programs.select(F.lower(F.trim("name")).alias("program"), "owner").unionByName(by_number).where(F.col("program").isNotNull()).distinct()


def editorial_matches(df: DataFrame, articles: DataFrame, id_col: str, flag_col: str, article_col: str) -> DataFrame:
    """Flagged rows whose article is in articles (article, owner)."""
    rows = df.where(F.col(flag_col)).select(F.col(id_col).alias("id"), F.lower(F.trim(article_col)).alias("article"))
    return _matches(rows.join(articles.withColumn("article", F.lower(F.trim("article"))), "article"), "REDACTIONAL", article_col)


def early_exit(matches: DataFrame, order: list[str]) -> DataFrame:
    """Of each row only the matches of the first matcher, in the given order, that has any."""
    ranked = matches.withColumn("rank", F.array_position(F.array(*map(F.lit, order)), F.col("matcher")))
    return ranked.withColumn("first", F.min("rank").over(Window.partitionBy("id"))).where("rank = first").drop("rank", "first")


def vote(matches: DataFrame) -> DataFrame:
    """(id, owner) with the most matches; of equals the smallest name."""
    n = matches.groupBy("id", "owner").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "owner"))).where("r = 1").select("id", "owner")


def default_owner(df: DataFrame, owners: list[str], id_col: str) -> DataFrame:
    """(id, owner): a default owner for each row, by its id."""
    return df.select(F.col(id_col).alias("id"), F.element_at(F.array(*map(F.lit, owners)), (F.pmod(F.col(id_col), F.lit(len(owners))) + 1).cast("int")).alias("owner"))


def keyword_counts(matches: DataFrame) -> DataFrame:
    """(id, column, owner, counts): "keyword (xN)" of each owner, by keyword."""
    n = matches.groupBy("id", "column", "owner", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("id", "column", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("keyword", "n"))), lambda x: F.concat(x["keyword"], F.lit(" (x"), x["n"].cast("string"), F.lit(")"))), ", ").alias("counts"))


def _lines(matches: DataFrame) -> DataFrame:
    """(id, matcher, column, owner, line): what each matcher says of an owner's matches in a column; credit tables have no column."""
    words = keyword_counts(matches.where("matcher = 'KEYWORD'")).select("id", F.lit("KEYWORD").alias("matcher"), "column", "owner", F.concat("owner", F.lit(" : ["), "counts", F.lit("]")).alias("line"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    key = ["id", "matcher", "column", "owner"]
    rest = matches.where("matcher <> 'KEYWORD'").withColumn("column", F.when(F.col("matcher") != "CREDIT_TABLE", F.col("column")))
    # a document's line names all articles of the owner
    found = rest.groupBy(*key).agg(F.array_sort(F.collect_set("document")).alias("documents"), listed("article").alias("articles"), listed("program").alias("programs"))
    documents = F.array_join(F.transform("documents", lambda d: F.concat(d, F.lit(" (articles "), F.col("articles"), F.lit(")"))), ", ")
    line = F.when(F.col("matcher") == "CREDIT_TABLE", F.concat("owner", F.lit(" : ["), "programs", F.lit("]"))).when(F.col("matcher") == "REDACTIONAL", F.concat("owner", F.lit(" : article "), "articles")).otherwise(F.concat(F.col("owner"), F.lit(" : "), documents))
    return words.unionByName(found.select(*key, line.alias("line")))


def explain(matches: DataFrame, chosen: DataFrame, order: list[str] = ("KEYWORD",)) -> DataFrame:
    """(id, comment): why the chosen owner, matcher by matcher in the given order, then what speaks for others."""
    lines = _lines(matches).join(chosen.withColumnRenamed("owner", "chosen"), "id").withColumn("own", F.col("owner") == F.col("chosen"))
    blocks = lines.groupBy("id", "chosen", "own", "matcher", "column").agg(F.array_sort(F.collect_list(F.struct("owner", "line"))).alias("lines"))
    kind = F.regexp_extract("matcher", "^LEGAL_DOCUMENT_(.*)$", 1)
    what = F.when(F.col("matcher") == "KEYWORD", F.lit("mots clés")).when(F.col("matcher") == "REDACTIONAL", F.lit("amendement rédactionnel"))
    what = what.otherwise(F.concat(F.when(kind == "LAW", "loi").when(kind == "ORDONNANCE", "ordonnance").when(kind == "CODE", "code").otherwise("texte"), F.lit("s")))
    head = F.when(F.col("matcher") == "CREDIT_TABLE", F.lit("Affectations par tableau de crédits :")).otherwise(F.concat(F.lit("Affectations par "), what, F.lit(" dans '"), F.col("column"), F.lit("' :")))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("matcher"))
    sides = blocks.groupBy("id", "chosen", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "matcher", F.coalesce("column", F.lit("")).alias("column"), text.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    both = sides.groupBy("id", "chosen").agg(F.max(F.when(F.col("own"), F.col("t"))).alias("mine"), F.max(F.when(~F.col("own"), F.col("t"))).alias("others"))
    # fixed values: the comment's wording
    start = F.concat(F.lit("Affectation sélectionnée: "), "chosen", F.coalesce(F.concat(F.lit("\n"), "mine"), F.lit("")))
    return both.select("id", F.concat(start, F.coalesce(F.concat(F.lit("\n\nAutres affectations possibles:\n"), "others", F.lit("\n")), F.lit(""))).alias("comment"))


def assign(df: DataFrame, chosen: DataFrame, agents: DataFrame, id_col: str, overwrite: bool = True) -> DataFrame:
    """df (owner, mail, entity, ...) with the chosen owner and the agent's mail and entity, empty if unknown."""
    infos = agents.select(F.col("owner").alias("_owner"), F.col("mail").alias("_mail"), F.col("entity").alias("_entity"))
    found = chosen.select(F.col("id").alias("_id"), F.col("owner").alias("_owner")).join(infos, "_owner", "left")
    rows = df.join(found, df[id_col] == F.col("_id"), "left")
    return rows.select(*[
        F.when(F.col("_id").isNotNull() & (F.lit(overwrite) | F.coalesce(F.col(c) == "", F.lit(True))), F.coalesce(f"_{c}", F.lit(""))).otherwise(F.col(c)).alias(c) if c in ("owner", "mail", "entity") else F.col(c)
        for c in df.columns
    ])


@dataclass(frozen=True)
class Matcher:
    """match gives the matches of one of its columns; rows hold the id, and the columns normalised, but raw ones as they are."""

    name: str
    columns: tuple[str, ...]
    match: Callable[[DataFrame, str], DataFrame]
    raw: bool = False


def keyword_matcher(keywords: DataFrame, columns: tuple[str, ...]) -> Matcher:
    return Matcher("KEYWORD", columns, lambda df, c: keyword_matches(df, keywords, "id", c))


def legal_matcher(kind: str, documents: DataFrame, columns: tuple[str, ...], ordinals: list[str] = ()) -> Matcher:
    """kind: CODE (by the documents' names), LAW or ORDONNANCE."""
    patterns = {"CODE": None, "LAW": LAW, "ORDONNANCE": ORDINANCE}[kind]
    name = f"LEGAL_DOCUMENT_{kind}"
    return Matcher(name, columns, lambda df, c: legal_matches(df, documents, patterns, "id", c, ordinals, name))


def credit_matcher(owners: DataFrame, credit_type: str, columns: tuple[str, ...] = ("Corps amdt original",)) -> Matcher:
    """owners: (program, owner), programs normalised."""

    def match(df: DataFrame, column: str) -> DataFrame:
        rows = df.select("id", F.explode(credit_rows(credit_type)(F.col(column))).alias("r")).where("r.error IS NULL")
        # generated, so that a filter on the program doesn't normalise it once more
        rows = rows.select("id", F.inline(F.array(F.struct(normalize_attribution(F.col("r.program")).alias("program"), amount(F.col("r.plus")).alias("plus"), amount(F.col("r.minus")).alias("minus")))))
        return credit_matches(rows, owners, column)

    return Matcher("CREDIT_TABLE", columns, match, raw=True)


def editorial_matcher(articles: DataFrame) -> Matcher:
    """articles: (article, owner). Rows need is_redactional."""
    return Matcher("REDACTIONAL", ("Num article",), lambda df, c: editorial_matches(df, articles, "id", "is_redactional", c), raw=True)


def matched(df: DataFrame, matchers: list[Matcher], id_col: str, early: bool) -> DataFrame:
    """All matches of df's rows, of each matcher in those of its columns that df has; early: only those of a row's first matcher that has any."""
    columns = dict.fromkeys(c for m in matchers for c in m.columns if c in df.columns)
    flag = [c for c in ("is_redactional",) if c in df.columns]
    raw = df.select(F.col(id_col).alias("id"), *flag, *columns)
    normal = df.select(F.col(id_col).alias("id"), *flag, *[normalize_attribution(F.coalesce(F.col(c).cast("string"), F.lit("none"))).alias(c) for c in columns])
    out = None
    for m in matchers:
        for c in m.columns:
            if c in columns:
                found = m.match(raw if m.raw else normal, c)
                out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no matcher has a column of the batch")
    return early_exit(out, [m.name for m in matchers]) if early else out


def attribute(df: DataFrame, matchers: list[Matcher], id_col: str, defaults: list[str] = (), agents: DataFrame | None = None, early: bool = False, overwrite: bool = True) -> DataFrame:
    """(id, owner, mail, entity, comment) of all rows: the vote of matches, or a default owner, or what df has if overwrite is off.

    df: `Affectation (nom)`, `Affectation (email)` and `Entité Pilote` count where they are and aren't blank. agents: (owner, mail,
    entity) of the final owner; unknown ones get empty texts. A row without match and default has no comment, and keeps its owner.
    """
    hits = stored(matched(df, matchers, id_col, early))
    chosen = vote(hits)
    reasons = explain(hits, chosen, [m.name for m in matchers])
    now = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), *[now(c).alias(n) for c, n in (("Affectation (nom)", "had_owner"), ("Affectation (email)", "had_mail"), ("Entité Pilote", "had_entity"))])
    rows = rows.join(chosen, "id", "left").join(reasons, "id", "left")
    spare = F.element_at(F.array(*map(F.lit, defaults)), (F.pmod(F.col("id"), F.lit(len(defaults))) + 1).cast("int")) if defaults else F.lit(None).cast("string")
    found = F.coalesce("owner", spare)
    owner = F.coalesce(found, "had_owner") if overwrite else F.coalesce("had_owner", found)
    rows = rows.select("id", owner.alias("owner"), "had_mail", "had_entity", F.coalesce("comment", F.when(spare.isNotNull(), "Attribution par défaut")).alias("comment"))
    if agents is not None:
        rows = rows.join(agents.select("owner", "mail", "entity"), "owner", "left")
    else:
        rows = rows.withColumns({"mail": F.lit(None).cast("string"), "entity": F.lit(None).cast("string")})
    infos = {c: F.coalesce(c, F.lit("")) if overwrite else F.coalesce(f"had_{c}", c, F.lit("")) for c in ("mail", "entity")}
    return rows.select("id", "owner", *[v.alias(c) for c, v in infos.items()], "comment")
