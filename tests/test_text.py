import random
import re

import pytest
from pyspark.sql import functions as F

from gregale.functions import text as tx
from gregale.functions.text import html_to_text


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("out")).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Éxámplè", "example"),
        ("J'ai quatre-vingt-dix-sept chameaux", "97 chameau"),
        ("l'article 130- 1 et 130 -1", "article 130-1 130-1"),
        ("les travaux des vitraux", "travail vitrail"),
        ("Article IV : 5 % de hausse", "article 5 % hausse"),
        ("", ""),
    ],
)
def test_normalize(spark, given, want):
    assert one(spark, tx.normalize_text, given) == want


def test_singular_and_numbers(spark):
    assert one(spark, tx.singularize, "aux chevaux bateaux yeux bus les") == "aux cheval bateau œil bus le"
    assert one(spark, tx.digitize, "vingt et soixante dix huit") == "20 et 78"
    assert one(spark, tx.digitize, None) == ""


def test_gage(spark):
    text = "Avant. La perte de recettes est compensée. La charge pour l'État aussi ! Fin."
    assert one(spark, tx.drop_gage, text).strip().startswith("Avant.")
    assert "compens" not in one(spark, tx.drop_gage, text)
    assert "Fin" in one(spark, tx.drop_gage, text)


def test_html(spark):
    assert one(spark, html_to_text, "<p>a &lt;b&gt;c<\\/p>\\nd") == "a c d"
    assert one(spark, html_to_text, None) is None


def test_body_and_editorial(spark):
    assert one(spark, tx.disambiguate_body, "Supprimer l'article liminaire.", "2") == "Supprimer cet article. 2"
    assert one(spark, tx.disambiguate_body, "x" * 60, "2") == "x" * 60
    assert one(spark, tx.disambiguate_body, "court", None) is None
    assert one(spark, tx.is_editorial, "Amendement rédactionnel.") is True
    assert one(spark, tx.is_editorial, None) is False


def test_summary_and_appeal(spark):
    assert one(spark, tx.predefined_summary, "Amendement de précision", "x") == "Amendement rédactionnel."
    assert one(spark, tx.predefined_summary, "autre", "Supprimer cet article 3") == "Supprimer cet article."
    assert one(spark, tx.predefined_summary, "autre", "x") == ""
    assert one(spark, tx.appeal_prefix, "s", "un Amendement d’appel") == "APPEL : s"
    assert one(spark, tx.appeal_prefix, "Supprimer cet article.", "amendement d'appel") == "Supprimer cet article."


def test_comment_rounds_half_to_even(spark):
    df = spark.sql("select array(named_struct('num', 7, 'pct', 86.5D), named_struct('num', 8, 'pct', 85.5D)) as s")
    assert df.select(tx.similar_comment(F.col("s"))).first()[0] == "Amdt similaires : 7 (86%), 8 (86%)"


def test_small_helpers(spark):
    assert one(spark, tx.slug, " Œuvre & Été ") == "oeuvre-ete"
    assert one(spark, tx.slug, "--") == "database"
    assert one(spark, tx.word_count, " a  b ") == 2
    assert one(spark, tx.strip_roman, "Titre IV et ÈVI") == "Titre  et ÈVI"
    assert one(spark, tx.is_blank, "  \t") is True
    assert one(spark, lambda c: tx.expand_acronyms(c, [("PLF", "projet de loi"), ("loi", "texte")]), "le PLF") == "le projet de texte"


def plain_drop_gage(text):
    """Piece by piece, each folded."""
    pieces = re.findall("[.!?\n\t–-]+|[^.!?\n\t–-]+", text)

    def begins(p):
        p = "".join(tx._SEVERAL.get(c, tx._ONE.get(c, c)) for c in p.strip())
        return re.match("|".join(tx.GAGE), "".join(c for c in p if c.isascii()).lower()) is not None

    return "".join(p for i, p in enumerate(pieces) if not begins(p) and not (i and begins(pieces[i - 1])))


def test_drop_gage_in_one_pass(spark):
    """The same as piece by piece, without a pass of its own for each sentence."""
    parts = ["La perte de recettes", "la PERTÉ de recettes", "lа perte", "la charge pour l’Étatß", "la perte de recetteß", "laあ perteあ de recettes", "  la perte de recettes", "あ la perte de recettes", "あla perte de recettes", " est compensée", ".", "! ", "\n", "–", "-", "x", " ", "?!", "la perte  de recettes"]
    rng = random.Random(3)
    texts = ["", *parts, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.drop_gage(F.col("t")).alias("got"))
    assert {r.t: r.got for r in df.collect()} == {t: plain_drop_gage(t) for t in texts}
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_number_and_plural_rules_only_where_their_words_are(spark):
    """Texts are looked through for the words, and not matched with all rules; what holds one of them still goes by the rules."""
    texts = {"dix sept travaux aux eaux bateaux yeux": "17 travail aux eau bateau œil", "dix soixante dix-sept": "10 70-7", "chevaux journaux aux": "cheval journal aux", "prix os bas bras": "pri os bas bras"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.singularize(tx._digitize_words(F.col("t"))).alias("got"))
    assert {r.t: r.got for r in df.collect()} == texts
    assert r"\b(?:" not in df._jdf.queryExecution().optimizedPlan().toString()
