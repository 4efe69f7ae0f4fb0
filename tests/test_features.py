import json

import pytest
from pyspark.sql import functions as F

from gregale.plans import features, store
from gregale.sources import batches


def frame(spark):
    rows = [(i, 100 + i, "1", "L", "G1" if i % 2 else "G2", "Supprimer cet article.", t, "", "", "", "", "") for i, t in enumerate(["un texte commun avec beaucoup de mots identiques ici encore", "un texte commun avec beaucoup de mots identiques ici encore", "autre chose totalement différente de ce qui précède dans la liste"])]
    cols = "amdt_idx long, `Num amdt` long, `Num article` string, Lecture string, Groupe string, `Corps amdt` string, `Exposé amdt` string, Commentaires string, `Affectation (nom)` string, `Objet amdt` string, `Avis du Gouvernement` string, Allotissement string"
    return spark.createDataFrame(rows, cols)


def test_whole_run_and_failure_isolation(spark):
    words = spark.createDataFrame([("mots identiques", "Alice"), ("liste", "Bob")], "`Mots clés` string, `Prénom Nom` string")

    def broken(df):
        raise RuntimeError("down")

    parts = [features.attribution(words), features.summary(lambda: lambda p: "résumé"), features.Feature("bad", [], ["x"], broken), features.Feature("needs", ["nowhere"], ["y"], lambda df: df)]
    out, failed = features.enrich_batch(frame(spark), ["Lecture"], parts)
    rows = {r.amdt_idx: r for r in out.collect()}
    assert set(failed) == {"bad", "needs"} and len(rows) == 3
    assert rows[0]["Affectation (nom)"] == rows[1]["Affectation (nom)"] == "Alice" and rows[2]["Affectation (nom)"] == "Bob"
    assert rows[0]["Allotissement"] == rows[1]["Allotissement"] == "100,101" and rows[2]["Allotissement"] is None
    assert rows[1]["Objet amdt"] == "Supprimer cet article." and "x" not in out.columns


def test_missions_and_clearing(spark):
    df = spark.createDataFrame([(1, "Écologie", "c"), (2, None, "c")], "amdt_idx long, Mission string, Commentaires string")
    assert [tuple(r) for r in features.keep_missions(df, ["ecolog"]).collect()] == [(1, "ecologie", "c")]
    assert features.keep_missions(df, []).count() == 2
    assert {r.Commentaires for r in features.clear_columns(df, []).collect()} == {None}


def test_json_exports(spark, tmp_path):
    item = {"num": 1, "article": "2", "chambre": "A", "legislature": 1, "corps": "<p>x</p>", "computed_batch": [18, 29], "auteur": "z", "date_derniere_modif": "2023-01-01 00:00:01.000"}
    for name in "ab":
        (tmp_path / f"{name}.json").write_text("﻿" + json.dumps({"amendements": [item, item | {"date_derniere_modif": ""}]}), encoding="utf-8")
    rows = batches.read_exports(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], default_time=1234567890).orderBy("amdt_idx").collect()
    assert [r.amdt_idx for r in rows] == [0, 1, 2, 3]
    r = rows[0]
    assert (r["timestamp"], rows[1]["timestamp"], r["Lecture"], r["Allotissement"], r["Corps amdt"], r["Corps amdt original"]) == (1672531201, 1234567890, "A 1", "18,29", "x", "<p>x</p>")
    assert "auteur" not in r.asDict()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 'a;"b"\nc')], "id long, l array<long>, t string")
    batches.write_csv(df, str(tmp_path / "o.csv"))
    back = spark.read.csv(str(tmp_path / "o.csv"), sep=";", header=True, multiLine=True, escape='"').first()
    assert (back.id, back.l, back.t) == ("1", "[1,2]", 'a;"b"\nc')


def test_store(spark):
    rows = [(1, 10, "L", "p", "1", "corps long " * 9, "même exposé pour tous les gens de la ville", "court", "h1"), (2, 20, "L", "p", "1", "corps long " * 9, "même exposé pour tous les gens de la ville", "long", "h2"), (3, 30, "L", "p", "1", "c", "rien à voir ici", " ", "h2")]
    raw = spark.createDataFrame(rows, "amdt_idx long, timestamp long, Lecture string, origin_project string, `Num article` string, `Corps amdt` string, `Exposé amdt` string, `Réponse` string, file_hash string")
    assert [r.amdt_idx for r in store.build(raw).collect()] == [2]
    assert [r.amdt_idx for r in store.build(store.remove(raw, ["h2"])).collect()] == [1]
    for bad in (lambda: store.append(spark, raw, raw), lambda: store.remove(raw, ["h9"]), lambda: store.remove(raw, ["h1", "h2"])):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
    assert store.append(spark, raw.where(F.col("file_hash") == "h1"), raw.where(F.col("file_hash") == "h2")).count() == 3


def test_env(monkeypatch):
    monkeypatch.setenv("WHERE", "here")
    assert batches.expand_env({"a": ["${WHERE}/x", 3]}) == {"a": ["here/x", 3]}


def test_all_matchers_and_similar_rows(spark):
    html = "<table><tr><th>Programmes</th><th>+</th><th>-</th></tr><tr><td>Eau</td><td>5</td><td>0</td></tr><tr><td>Bois</td><td>0</td><td>5</td></tr></table>"
    rows = [(1, 11, "1", "voir l'article 3 du code de la route", "", "", False), (2, 12, "7", "rien", "", "", True), (3, 13, "1", "rien", html, "", False), (4, 14, "1", "voir l'article 3 du code de la routes", "", "", False), (5, 15, "1", "les mots", "", "", False)]
    df = spark.createDataFrame(rows, "amdt_idx long, `Num amdt` long, `Num article` string, `Exposé amdt` string, `Corps amdt original` string, Commentaires string, is_redactional boolean")
    words = spark.createDataFrame([("mots", "Alice")], "`Mots clés` string, `Prénom Nom` string")
    legal = spark.createDataFrame([("route", "3", "Loi")], "document string, article string, owner string")
    program = spark.createDataFrame([("eau", "Crédit")], "program string, owner string")
    article = spark.createDataFrame([("7", "Article")], "article string, owner string")
    feature = features.attribution(words, legal=(legal, [r"code de la (route)"]), credit=(program, "Autorisations"), articles=article, order=("REDACTIONAL", "CREDIT_TABLE", "LEGAL", "KEYWORD"))
    out, failed = features.run_features(df, [feature, features.within_batch()])
    got = {r.amdt_idx: r for r in out.collect()}
    assert not failed and [got[i]["Affectation (nom)"] for i in range(1, 6)] == ["Loi", "Article", "Crédit", "Loi", "Alice"]
    assert got[1].Commentaires == "Affectation sélectionnée: Loi\nAffectations par textes dans 'Exposé amdt' :\nLoi : route (articles 3)\nAmdt similaires : 14 (100%)" and got[4].Commentaires.endswith("\nAmdt similaires : 11 (100%)")
    assert "similaires" not in (got[3].Commentaires or "") + got[5].Commentaires


def test_long_dictionaries_are_errors(spark, tmp_path):
    sheet = spark.range(10_001).select(F.col("id").alias("pos"), F.concat(F.lit("A"), "id").alias("Acronyme"), F.lit("x").alias("Développement"))
    with pytest.raises(ValueError):
        features.acronyms(sheet)
    assert len(features.acronyms(sheet.where("pos < 10000"))) == 10_000


def test_no_value_is_lost_in_the_run(spark):
    """Blank rows keep what they had, and so do the columns of a feature that fails."""
    cols = "amdt_idx long, `Num amdt` long, `Num article` string, Lecture string, Groupe string, `Corps amdt` string, `Exposé amdt` string, Commentaires string, `Affectation (nom)` string, `Avis du Gouvernement` string, Allotissement string"
    rows = [(1, 1, "1", "L", "G", "corps un", "un texte sur les routes", "", "Zoé", "old1", ""), (2, 2, "1", "L", "G", " ", "rien", "gardé", "Zoé", "old2", "")]
    defaults = spark.createDataFrame([("G", "Sagesse")], "grp string, default string")

    def late(df):
        return df.select("amdt_idx", F.udf(lambda i: 1 // 0, "string")("amdt_idx").alias("Affectation (nom)"))

    out, failed = features.enrich_batch(spark.createDataFrame(rows, cols), ["Lecture"], [features.opinion(defaults), features.Feature("late", [], ["Affectation (nom)"], late)])
    got = {r.amdt_idx: r for r in out.collect()}
    assert set(failed) == {"late"} and [got[i]["Avis du Gouvernement"] for i in (1, 2)] == ["Sagesse", "old2"]
    assert [got[i]["Affectation (nom)"] for i in (1, 2)] == ["Zoé", "Zoé"] and got[2].Commentaires == "gardé"


def test_the_owner_of_most_rows_stays(spark):
    same = "un texte commun avec beaucoup de mots identiques ici encore"
    rows = [(i, i, "1", "L", "Supprimer cet article.", same, owner) for i, owner in enumerate(["Défaut", "Ann", "Zoé", "Zoé", None])]
    df = spark.createDataFrame(rows, "amdt_idx long, `Num amdt` long, `Num article` string, Lecture string, `Corps amdt` string, `Exposé amdt` string, `Affectation (nom)` string")
    kept = lambda keep: [r.amdt_idx for r in features.allot(df, ["Lecture"], "Exposé amdt", 0.4, 0.9, keep)[0].collect()]
    assert kept(features.keep_by_owner(["Défaut"])) == [2] and kept(features.keep_first) == [0]
    assert kept(lambda rows, groups: rows.where("amdt_idx = 4")) == [4]


def test_a_store_kept_by_blocks_equals_a_whole_build(spark, tmp_path):
    texts = ["un exposé sur les routes et les ponts", "un autre exposé, sur les lacs", "un exposé sur les routes et les ponts"]
    rows = [(i, 100 - i, f"L{i % 4}", "p" if i % 7 else None, str(i % 5), "corps long " * 9, texts[i % 3], "réponse" if i % 6 else "", f"h{i % 3}") for i in range(90)]
    rows += [(90, 1, "seul", "p", "1", "c", texts[0], "oui", "h2")]
    raw = spark.createDataFrame(rows, "amdt_idx long, timestamp long, Lecture string, origin_project string, `Num article` string, `Corps amdt` string, `Exposé amdt` string, `Réponse` string, file_hash string")
    kept = store.KeptStore(spark, str(tmp_path / "store"))
    kept.create(raw.where("file_hash <> 'h2'"))
    more = raw.where("file_hash = 'h2'").withColumn("amdt_idx", F.col("amdt_idx") - 2)
    found = lambda df: sorted(str(tuple(r[c] for c in raw.columns)) for r in df.collect())
    assert found(kept.rows()) == found(store.build(kept.raw()))
    kept.append(more)
    assert kept.raw().count() == 91 and found(kept.rows()) == found(store.build(kept.raw()))
    with pytest.raises(ValueError):
        kept.append(more)
    kept.remove(["h2"])
    assert found(kept.rows()) == found(store.build(kept.raw())) and {r.file_hash for r in kept.raw().select("file_hash").distinct().collect()} == {"h0", "h1"}
    assert "seul" not in {r.Lecture for r in kept.rows().collect()}
    with pytest.raises(ValueError):
        kept.remove(["h9"])
