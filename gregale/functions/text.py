"""The text kernel: column expressions for cleaning and normalising French legislative text.

All but html_to_text are built from Spark's own functions. Regular expressions use explicit ASCII classes after folding, so that
they mean the same in other engines.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Irregular plurals and exceptions.
IRREGULAR = {
    "aux": "aux", "travaux": "travail", "vitraux": "vitrail", "yeux": "œil", "chacals": "chacal",
    "messieurs": "monsieur", "mesdames": "madame", "mesdemoiselles": "mademoiselle",
}
# Number words, without accents and dashes.
NUMBERS = {
    "zero": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7", "huit": "8", "neuf": "9",
    "dix": "10", "onze": "11", "douze": "12", "treize": "13", "quatorze": "14", "quinze": "15", "seize": "16",
    "dix sept": "17", "dix huit": "18", "dix neuf": "19", "vingt": "20", "vingts": "20", "trente": "30", "quarante": "40",
    "cinquante": "50", "soixante": "60", "soixante dix": "70", "soixante seize": "76", "soixante dix sept": "77",
    "soixante dix huit": "78", "soixante dix neuf": "79", "quatre vingt": "80", "quatre vingts": "80", "quatre vingt dix": "90",
    "quatre vingt seize": "96", "quatre vingt dix sept": "97", "quatre vingt dix huit": "98", "quatre vingt dix neuf": "99",
}
# The public list of French stop words.
STOP_WORDS = """
au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par
pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante
étants étantes suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était
étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante
ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais
avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent
""".split()
# Beginnings of sentences about compensation, and phrases of purely editorial statements.
GAGE = ["la perte de recettes", "la charge pour l'etat"]
EDITORIAL = [
    "correction d'erreur materielle", "amendement redactionnel", "amendement de precision", "amendement de correction",
    "amendement de clarification", "amendement de coordination", "amendement de suppression",
]
# Bodies that many rows share.
COMMON_BODIES = [r"Supprimer cet article\.?", r"Supprimer l(?:'|’)alinéa [0-9]{1,5}\.?", r"Supprimer les alinéas [0-9]{1,5} (?:à|et) [0-9]{1,5}\.?"]
SHORT = 50
# Fixed value: punctuation that ends a token in attribution; upper-case ASCII letters count as such.
TOKEN_SPLIT = r"""[\s\f'.,;:!?"(){}<>-\[\]]+"""

# Characters that fold to several, and to one. Letters with marks fold to their base letter by decomposition.
_SEVERAL = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "«": "<<", "»": ">>", "…": "...", "°": "deg", "€": "EUR", "—": "--", "½": "1/2"}
_ONE = {"’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"', "–": "-", "‑": "-", "‐": "-", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ı": "i"}
_ONE |= dict.fromkeys("               　", " ")
for _c in map(chr, range(0xC0, 0x250)):
    _base = unicodedata.normalize("NFKD", _c)[0]
    if _base.isascii() and _c not in _SEVERAL:
        _ONE.setdefault(_c, _base)


def fold(c: Column) -> Column:
    """ASCII transliteration; characters without one vanish."""
    for k, v in _SEVERAL.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(c, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7F]", "")


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or white space."""
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def strip_roman(c: Column) -> Column:
    """Small roman numerals in upper case, as whole words."""
    return F.regexp_replace(c, r"(?U)\b[IVX]{1,5}\b", "")


def digitize(c: Column) -> Column:
    """Number words to digits, longest first; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for words in sorted(NUMBERS, key=len, reverse=True):
        c = F.regexp_replace(c, rf"(?i)\b{words}\b", NUMBERS[words])
    return c


def drop_stop_words(c: Column) -> Column:
    """Words that aren't stop words, joined by spaces; % is a word of its own; null becomes empty."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "%", " % "), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS)), " ")


def singular(w: Column) -> Column:
    """Naive singular of one word."""
    out = F.when(w.endswith("s") & ~w.rlike("(is|us|os|as)$"), F.substring(w, F.lit(1), F.length(w) - 1))
    out = out.when(w.endswith("aux") & ~w.endswith("eaux"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("al")))
    out = out.when(w.endswith("x"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    for k, v in IRREGULAR.items():
        out = F.when(w == k, v).otherwise(out)
    return out


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _holds(c: Column, words: list[str]) -> Column:
    """Whether a text contains one of words, anywhere: most texts are spared the rules about them by this."""
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def singularize(c: Column) -> Column:
    """Naive singulars of all words, by rules over the whole text: each word ends in one letter, so that at most one rule changes it."""
    return _once(F.trim(F.regexp_replace(c, r"\s+", " ")), _singularize)


def _singularize(c: Column) -> Column:
    word = lambda w: rf"(?<![^ ])(?:{w})(?= |\z)"
    unlike = {k: v for k, v in IRREGULAR.items() if k != v}
    changed = c
    for k, v in unlike.items():
        changed = F.regexp_replace(changed, word(k), v)
    c = F.when(_holds(c, list(unlike)), changed).otherwise(c)
    ends = r"(?:(?<![iuoa])s|x)(?= |\z)"
    (k,) = IRREGULAR.keys() - unlike.keys()  # stays as it is: its last letter is put back after the rules
    with_k = F.regexp_replace(F.regexp_replace(c, word(k), f"{k[:-1]}\ue000"), r"(?<!e)aux(?= |\z)", "al")
    with_k = F.replace(F.regexp_replace(with_k, ends, ""), F.lit("\ue000"), F.lit(k[-1]))
    return F.when(F.contains(c, F.lit("aux")), with_k).otherwise(F.regexp_replace(c, ends, ""))


_LONE = [w for w in NUMBERS if " " not in w]
_LINKED = sorted((w for w in NUMBERS if " " in w), key=len, reverse=True)


def _digitize_words(c: Column) -> Column:
    """As digitize, for words of lower-case ASCII letters, digits and dashes between single spaces: single number words are looked up."""
    return _once(c, _digitize_single_spaced)


def _digitize_single_spaced(c: Column) -> Column:
    several = c
    for words in _LINKED:
        several = F.regexp_replace(several, rf"\b{words}\b", NUMBERS[words])
    c = F.when(_holds(c, sorted({w.split(" ")[0] + " " for w in _LINKED})), several).otherwise(c)
    known = F.create_map(*[F.lit(x) for w in _LONE for x in (w, NUMBERS[w])])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.isin(_LONE), F.element_at(known, w)).when(F.contains(w, F.lit("-")), digitize(w)).otherwise(w)), " ")


def _similarity_steps(c: Column, tighten: bool) -> Column:
    c = F.lower(F.btrim(fold(strip_roman(c)), F.lit(" \t\n\x0b\f\r")))
    c = F.regexp_replace(c, "['`_]", " ")
    if tighten:
        c = F.regexp_replace(c, r"([0-9])\s*-\s*([0-9])", "$1-$2")
    c = F.regexp_replace(c, r"(?<![0-9])-(?![0-9])", " ")
    c = F.regexp_replace(c, r"[^a-zA-Z0-9\s\-%]", "")
    return squeeze(singularize(_digitize_words(drop_stop_words(c))))


def normalize_text(c: Column) -> Column:
    return _similarity_steps(c, tighten=True)


def normalize_standard(c: Column) -> Column:
    """As normalize_text, but digits around dashes stay apart; null becomes empty."""
    return F.coalesce(_similarity_steps(c, tighten=False), F.lit(""))


def normalize_attribution(c: Column) -> Column:
    """Keeps punctuation; words between it lose their plurals."""
    c = F.lower(strip_spaces(fold(strip_roman(F.coalesce(c, F.lit(""))))))
    c = F.regexp_replace(c, r"(?<![0-9])-(?![0-9])", " ")
    pieces = F.regexp_extract_all(c, F.lit(f"({TOKEN_SPLIT}|(?:(?!{TOKEN_SPLIT[:-1]})[\\s\\S])+)"), F.lit(1))
    return squeeze(F.array_join(F.transform(pieces, singular), ""))


def normalize_summary(c: Column) -> Column:
    c = F.regexp_replace(F.lower(strip_spaces(fold(c))), r"[\n\r]", " ")
    return squeeze(F.regexp_replace(c, r"[^a-z0-9'.,!? \-\"]", ""))


NORMALIZERS = {
    "allotment": normalize_standard,
    "similarity_search": normalize_standard,
    "similarities_within_lecture": normalize_standard,
    "attribution": normalize_attribution,
    "summary_generation": normalize_summary,
}


def _folds_to(phrase: str) -> str:
    """A regular expression for what folds to a phrase in lower case, among characters that vanish; its end may be the half of several."""
    vanish = "[^\\x00-\\x7F" + "".join(_ONE) + "".join(_SEVERAL) + "]*+"

    def letter(x: str, last: bool) -> str:
        given = {x, x.upper()} | {k for k, v in _ONE.items() if v.lower() == x} | {k for k, v in _SEVERAL.items() if last and v.lower().startswith(x)}
        return "[" + "".join(sorted(given)) + "]"

    return vanish + vanish.join(letter(x, i == len(phrase) - 1) for i, x in enumerate(phrase))


def drop_gage(c: Column) -> Column:
    """Sentences that begin as GAGE says go, with the delimiter after each. Dashes end sentences, too."""
    ends = r".!?\n\t–\-"
    # what vanishes and white space needn't be looked at, but after a delimiter; sentences in a row are one match
    sentence = rf"(?U:[\s&&[^{ends}]]*+)(?:" + "|".join(map(_folds_to, GAGE)) + rf")[^{ends}]*+[{ends}]*+"
    return F.regexp_replace(c, rf"(^|[{ends}])(?:{sentence})+", "$1")


def slug(c: Column, default: str = "database") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def slug_with_id(c: Column, row_id: Column) -> Column:
    """The slug and the first eight characters of an id."""
    return F.concat(slug(c), F.lit("__"), F.substring(row_id, 1, 8))


def clean_expert_summary(c: Column) -> Column:
    """Without the marks that experts put into their summaries."""
    # fixed values: the marks, as experts write them
    return strip_spaces(F.regexp_replace(c, r"(?i)\[sous-amendement\]|\*|REDACTIONNEL|Irr - |APPEL : |Appel -|IRR : ", ""))


def day_epoch(year: Column, month: Column, day: Column) -> Column:
    """Seconds of a day's beginning, in the session's time zone (UTC)."""
    return F.unix_timestamp(F.make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def fill_prompt(template: Column, expose: Column, body: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{{expose_amdt}}"), expose), F.lit("{{corps_amdt}}"), body)


def valid_free_text(c: Column) -> Column:
    """2 to 100 characters, none of them control characters or of HTML."""
    # fixed values: the bounds and the signs that aren't taken
    return F.length(c).between(2, 100) & ~c.rlike(r"[\x00-\x1F\x7F<>&]")


def fill_blank(c: Column, row_id: Column, prefix: str) -> Column:
    """A placeholder of its own for each blank."""
    return F.when(is_blank(c), F.concat(F.lit(prefix), row_id.cast("string"))).otherwise(c)


def fill_placeholder(df: DataFrame, column: str, value: str | None = None, generator: Callable[[], Column] | None = None) -> DataFrame:
    """df with blanks of a column filled by a fixed value or by a generated column; a missing column, neither or both are errors."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if (value is None) == (generator is None):
        raise ValueError("give a value or a generator")
    return df.withColumn(column, F.when(is_blank(F.col(column)), F.lit(value) if generator is None else generator()).otherwise(F.col(column)))


def expand_acronyms(c: Column, acronyms: list[tuple[str, str]]) -> Column:
    """In the given order; an expansion may be expanded again."""
    for acronym, meaning in acronyms:
        c = F.regexp_replace(c, acronym, meaning)
    return c


def disambiguate_body(body: Column, article: Column) -> Column:
    """Short and very common bodies get their article appended; without one they become null."""
    body = F.regexp_replace(body, r"(?i)supprimer l'article liminaire\.?", "Supprimer cet article.")
    return F.when(F.coalesce(body.rlike("|".join(COMMON_BODIES)), F.lit(False)) | (F.length(body) < SHORT), F.concat(body, F.lit(" "), article)).otherwise(body)


def is_editorial(expose: Column) -> Column:
    return F.coalesce(fold(F.lower(expose)).rlike("|".join(EDITORIAL)), F.lit(False))


def extend_expose(expose: Column, body: Column) -> Column:
    """Editorial and short statements get the body appended."""
    return F.when(is_editorial(expose) | (F.length(expose) < SHORT), F.concat(expose, F.lit(" "), body)).otherwise(expose)


def predefined_summary(expose: Column, body: Column) -> Column:
    """A fixed summary of editorial and suppressing rows, else empty."""
    e, b = normalize_summary(expose), normalize_summary(body)
    editorial = e.startswith("amendement redactionnel.") | e.rlike("|".join(EDITORIAL[2:])) | e.contains(EDITORIAL[0])
    return F.when(editorial, "Amendement rédactionnel.").when(b.startswith("supprimer cet article"), "Supprimer cet article.").otherwise("")


def appeal_prefix(summary: Column, expose: Column) -> Column:
    appeal = F.coalesce(expose.rlike("(?i)amendements? d.?appel"), F.lit(False)) & (F.coalesce(summary, F.lit("")) != "Supprimer cet article.")
    return F.when(appeal, F.concat(F.lit("APPEL : "), summary)).otherwise(summary)


def similar_comment(similar: Column) -> Column:
    """similar: array<struct<num, pct>>; percents are rounded half to even."""
    one = lambda s: F.concat(s["num"].cast("string"), F.lit(" ("), F.bround(s["pct"], 0).cast("long").cast("string"), F.lit("%)"))
    return F.concat(F.lit("Amdt similaires : "), F.array_join(F.transform(similar, one), ", "))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _plain(markup: str | None) -> str | None:
    if markup is None:
        return None
    parser = _Text()
    parser.feed(html.unescape(markup.replace("\\/", "/")))
    parser.close()
    text = re.sub(r"<[^>]+>", " ", "".join(parser.parts))
    for escape in ("\\n", "\\t", "\\r"):
        text = text.replace(escape, " ")
    return unicodedata.normalize("NFC", re.sub(r"\s+", " ", text).strip())


@F.pandas_udf(StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    """Plain text of HTML, whose entities are decoded first, so that escaped tags go as well."""
    return markup.map(_plain)
