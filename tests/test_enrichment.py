"""Search in the store, attribution end to end, and the smaller operators, on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from gregale.functions import text as tx
from gregale.operators import attribution as at
from gregale.operators import enrich, search, similarity
from gregale.plans import catalogue, features
from gregale.streaming.matching import match_stream

LONG = "cet amendement vise a renforcer le financement des hopitaux publics dans les zones rurales du pays"


def old_rows(spark):
    rows = [
        (0, 10, "P1", "L1", "O1", "1", LONG, LONG + " corps ancien", "Réponse vieille", "Favorable", 100),
        (1, 11, "P1", "L1", "O1", "1", LONG + " encore", LONG + " corps ancien", "", "Défavorable", 200),
        (2, 12, "P2", "L2", "O2", "1", "rien de commun avec les autres textes de la liste", LONG + " corps nouveau", "Autre", "Sagesse", 300),
    ]
    return spark.createDataFrame(rows, "amdt_idx long, `Num amdt` long, origin_project string, Lecture string, Organe string, `Num article` string, `Exposé amdt` string, `Corps amdt` string, `Réponse` string, Avis string, timestamp long").withColumns({c: tx.normalize_text(F.col(c)) for c in ("Exposé amdt", "Corps amdt")})


def new_rows(spark):
    rows = [(0, "P1", "1", LONG + ".", LONG + " corps nouveau", "", "gardé", ""), (1, "P1", "1", "une tout autre question sur la fiscalite locale des communes", "des mots sans rapport avec quoi que ce soit dans cette base", "note", "", "")]
    return spark.createDataFrame(rows, "amdt_idx long, origin_project string, `Num article` string, `Exposé amdt` string, `Corps amdt` string, Commentaires string, Avis string, `Réponse` string")


def test_search_feature(spark):
    copies = [search.Copy("Réponse"), search.Copy("Avis", condition="favorable"), search.Copy("Lecture", enabled=False)]
    out, failed = features.run_features(new_rows(spark), [features.search(old_rows(spark), copies)])
    got = {r.amdt_idx: r for r in out.collect()}
    # by statement both rows of P1 match; the later one leads, as it is newer, though its answer is empty
    assert not failed and got[0]["Réponse"] == "" and got[0].Avis == "Défavorable"
    assert got[0].Commentaires.startswith("Copie de Réponse, Avis depuis : P1\nNuméro d'amendement : 11\n") and "Colonne similaire : " in got[0].Commentaires
    assert (got[1].Commentaires, got[1].Avis, got[1]["Réponse"]) == ("note", "", "")
    kept, _ = features.run_features(new_rows(spark), [features.search(old_rows(spark), copies, overwrite=False)])
    assert kept.where("amdt_idx = 0").first().Avis == "gardé"
    with pytest.raises(ValueError):
        features.search(old_rows(spark), [])


def test_threshold_and_ratio(spark):
    row = spark.createDataFrame([("abcd", "abxd", "bcx")], "old string, new string, key string").select(
        search.ratio(F.col("old"), F.col("new")).alias("r"), search.threshold_for(F.col("key"), {"bc": 0.3, "b": 0.9}, 0.5).alias("t"), search.threshold_for(F.col("old"), {"bc": 0.3}, 0.5).alias("d")
    ).first()
    assert (row.r, row.t, row.d) == (0.75, 0.3, 0.5)


def sheets(spark):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    return {
        "Acronymes": make([(0, "APL", "aide personnalisée au logement")], "pos long, Acronyme string, `Développement` string"),
        "Mots clés": make([("APL", "Alice A"), ("aide personnalisée au logement", "Alice A"), ("hôpital", "Bob B")], "`Mots clés` string, `Prénom Nom` string"),
        "Code et Article": make([("Code", "route", "3", "Carl C"), ("Loi", "2005-102 du 11 février 2005", "2", "Dora D"), ("Ordonnance", "2020-1 du 2 mars 2020", "9", "Carl C")], "Type string, Valeur string, Articles string, `Prénom Nom` string"),
        "Responsables de programme": make([("Eau", "113", "Elsa E"), (None, "204.0", "Bob B"), ("Bois", None, None)], "`Programme budgétaire` string, `N° programme` string, `Prénom Nom` string"),
        "Attribution par défaut": make([(0, "Zoé Z"), (1, "Yann Y")], "pos long, `Prénom Nom` string"),
        "Infos Agents": make([(0, "Alice A", "a@x", "E1"), (1, "Alice A", "b@x", "E2"), (2, " Zoé Z", "z@x", None)], "pos long, `Prénom Nom` string, Mail string, `Entité Pilote` string"),
    }


def test_social_preset(spark):
    rows = [
        (0, "une aide personnalisée au logement", "voir l'article 3 du code de la route", "", ""),
        (1, "rien", "selon l'article 2 de la loi n° 2005-102 du 11 février 2005", "déjà", ""),
        (2, "rien", "rien", "", "dit"),
        (3, "rien", "l'article 9 de l'ordonnance n° 2020-1 du 2 mars 2020 et l'article 3 du code de la route", "", ""),
    ]
    df = spark.createDataFrame(rows, "amdt_idx long, `Exposé amdt` string, `Corps amdt` string, `Affectation (nom)` string, Commentaires string")
    out, failed = features.run_features(df, [features.PRESETS["PLFSS"](sheets(spark))])
    got = {r.amdt_idx: r for r in out.collect()}
    assert not failed and [got[i]["Affectation (nom)"] for i in range(4)] == ["alice a", "dora d", "zoé z", "carl c"]
    assert (got[0]["Affectation (email)"], got[0]["Entité Pilote"], got[2]["Affectation (email)"], got[3]["Affectation (email)"]) == ("a@x", "E1", "z@x", "")
    assert got[0].Commentaires == (
        "Affectation sélectionnée: alice a\nAffectations par mots clés dans 'Exposé amdt' :\nalice a : [aide personnalisee au logement (x1)]"
        "\n\nAutres affectations possibles:\nAffectations par codes dans 'Corps amdt' :\ncarl c : route (articles 3)\n"
    )
    assert got[1].Commentaires == "Affectation sélectionnée: dora d\nAffectations par lois dans 'Corps amdt' :\ndora d : 2005-102 du 11 fevrier 2005 (articles 2)"
    assert got[2].Commentaires == "dit\nAttribution par défaut"
    assert "Affectations par codes dans 'Corps amdt' :\ncarl c : route (articles 3, 9)\nAffectations par ordonnances" in got[3].Commentaires.replace("(articles 3)", "(articles 3, 9)")
    kept, _ = features.run_features(df, [features.PRESETS["PLFSS"](sheets(spark), overwrite=False)])
    assert kept.where("amdt_idx = 1").first()["Affectation (nom)"] == "déjà"


def test_budget_preset(spark):
    table = lambda program, plus, minus: f"<table><tr><th>Programmes</th><th>+</th><th>-</th></tr><tr><td>{program}</td><td>{plus}</td><td>{minus}</td></tr><tr><td>Bois</td><td>0</td><td>7</td></tr></table>"
    bad = "<table><tr><th>Programmes</th><th>x</th></tr></table>"
    rows = [(0, "hôpital", table("Eau", 5, 0)), (1, "hôpital", table("204", 5, 0)), (2, "un hôpital", "<p>rien</p>"), (3, "rien", bad), (4, "rien", table("Nouveau programme", 5, 0))]
    df = spark.createDataFrame(rows, "amdt_idx long, `Exposé amdt` string, `Corps amdt original` string")
    out, failed = features.run_features(df, [features.PRESETS["PLF"](sheets(spark))])
    got = {r.amdt_idx: r for r in out.collect()}
    assert not failed and [got[i]["Affectation (nom)"] for i in range(5)] == ["elsa e", "bob b", "bob b", "yann y", "zoé z"]
    assert got[0].Commentaires == "Affectation sélectionnée: elsa e\nAffectations par tableau de crédits :\nelsa e : [eau]"


def test_loaders(spark):
    s = sheets(spark)
    assert {tuple(r) for r in features.keywords(s["Mots clés"], features.acronyms(s["Acronymes"])).collect()} == {("aide personnalisee au logement", "alice a"), ("hopital", "bob b")}
    assert [tuple(r) for r in features.repeated_agents(s["Infos Agents"]).collect()] == [("Alice A", 2)]
    assert {tuple(r) for r in features.programs(s["Responsables de programme"]).collect()} == {("eau", "elsa e"), ("113", "elsa e"), ("204", "bob b")}
    opinions = spark.createDataFrame([(0, "G", "a"), (1, "G", "b"), (2, "H", "c")], "pos long, Groupe string, `Avis par défaut` string")
    assert {tuple(r) for r in features.default_opinions(opinions).collect()} == {("G", "b"), ("H", "c")}
    table = spark.createDataFrame([("Article 3", "x"), ("4", None), ("", "y")], "`Numéro article` string, `Affectation (nom)` string")
    assert {tuple(r) for r in features.subsidiary(table).collect()} == {("article 3", "x"), ("article 4", ""), ("", "y")}


def test_comments_without_owner_stay(spark):
    df = new_rows(spark).withColumns({"Groupe": F.lit("G"), "Num amdt": F.col("amdt_idx"), "Allotissement": F.lit("")})
    sheet = spark.createDataFrame([("G", "avis")], "grp string, default string")
    done, failed = features.enrich_batch(df, ["Num article"], [features.opinion(sheet)])
    assert not failed and [(r.Commentaires, r["Avis du Gouvernement"]) for r in done.orderBy("amdt_idx").collect()] == [("", "avis"), ("note", "avis")]


def test_opinion_by_lot(spark):
    df = spark.createDataFrame([(0, "G", "a", None), (1, "H", "a", "Défavorable"), (2, "G", None, None)], "amdt_idx long, Groupe string, lot string, `Avis du Gouvernement` string")
    sheet = spark.createDataFrame([("G", "avis")], "grp string, default string")
    out, _ = features.run_features(df, [features.opinion(sheet, overwrite=False, lot="lot")])
    assert [r["Avis du Gouvernement"] for r in out.orderBy("amdt_idx").collect()] == ["Défavorable", "Défavorable", "avis"]


def test_calls_are_tried_again():
    calls = []

    def client():
        def ask(prompt):
            calls.append(prompt)
            if prompt == "never" or len(calls) < 3:
                raise RuntimeError("busy")
            return "ok"

        return ask

    assert enrich.retrying(client, attempts=3)()("x") == "ok" and len(calls) == 3
    assert enrich.retrying(client, attempts=2, per_second=1000)()("never") == ""


def test_summaries_are_kept(spark):
    df = spark.createDataFrame([(0, "e " * 30, "c", "mine"), (1, "e " * 30, "c", " ")], "amdt_idx long, `Exposé amdt` string, `Corps amdt` string, `Objet amdt` string")
    out, _ = features.run_features(df, [features.summary(lambda: lambda p: "said", overwrite=False)])
    assert [r["Objet amdt"] for r in out.orderBy("amdt_idx").collect()] == ["mine", "said"]


def test_placeholders(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, " ")], "id long, t string")
    assert [r.t for r in tx.fill_placeholder(df, "t", value="-").orderBy("id").collect()] == ["-", "x", "-"]
    for bad in ({}, {"value": "a", "generator": lambda: F.lit("b")}):
        with pytest.raises(ValueError):
            tx.fill_placeholder(df, "t", **bad)
    with pytest.raises(ValueError):
        tx.fill_placeholder(df, "nowhere", value="-")


def test_owners_helpers(spark):
    programs = spark.createDataFrame([(" Eau ", "5.0", "a"), (None, "7", "b")], "name string, number string, owner string")
    assert {tuple(r) for r in at.program_owners(programs).collect()} == {("eau", "a"), ("5", "a"), ("7", "b")}
    assert [r.owner for r in at.default_owner(spark.range(3), ["x", "y"], "id").orderBy("id").collect()] == ["x", "y", "x"]


def test_standard_normaliser_keeps_digits_apart(spark):
    row = spark.createDataFrame([("Les  articles 3 - 4, 20 travaux et des eaux", None)], "t string, n string").select(tx.normalize_standard(F.col("t")).alias("s"), tx.normalize_text(F.col("t")).alias("n"), tx.normalize_standard(F.col("n")).alias("e")).first()
    assert row.n == "article 3-4 20 travail eau" and row.s == "article 3 4 20 travail eau" and row.e == ""


def test_number_words_and_plurals(spark):
    texts = {"quatre-vingt-dix-sept euros et tables": "97 euros table", "dix sept sept": "17 7", "3-dix oiseaux aux animaux": "3-10 oiseau animal", "bus tris yeux chacals gaz": "bus tris œil chacal gaz"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, want string")
    assert {r.t: r.got for r in df.select("t", tx.normalize_text(F.col("t")).alias("got")).collect()} == texts


def test_permutation_is_seeded(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one = {r.k: (r.place, r.assigned) for r in enrich.round_robin(df, ["a", "b"], [], 3, "k").collect()}
    two = {r.k: (r.place, r.assigned) for r in enrich.round_robin(df.repartition(7), ["a", "b"], [], 3, "k").collect()}
    assert one == two and sorted(p for p, _ in one.values()) == list(range(500)) and [one[k][0] for k in range(20)] != list(range(20))


def test_pages_of_the_catalogue(spark):
    users = spark.createDataFrame([(i, f"u{i}@x_y.fr") for i in range(15)], "id long, email string")
    assert [r.email for r in catalogue.people_like(users, "X_Y", "u0@x_y.fr").limit(2).collect()] == ["u10@x_y.fr", "u11@x_y.fr"]
    assert catalogue.people_like(users, "x%y", "").count() == 0 and catalogue.people_like(users, "u", "").count() == 10
    assert [(r.id, r.total) for r in catalogue.page(users, "id", 13, 5).collect()] == [(13, 15), (14, 15)]
    assert catalogue.visible(users, users.limit(0).withColumn("user_id", F.lit(1)), 1, "id", is_admin=True).count() == 15


def test_cosine_bounds_lose_nothing(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "b" if i % 2 else "c", " ".join(rng.choice([f"w{k}" for k in range(30)]) for _ in range(rng.randint(1, 14)))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, block string, t string")
    weights = similarity.tfidf(df, ["block"], "id", "t").collect()
    vectors = {}
    for r in weights:
        vectors.setdefault((r.block, r.id), {})[r.term] = r.w
    for least in (0.2, 0.5, 0.9):
        want = {(a[1], b[1]) for a, x in vectors.items() for b, y in vectors.items() if a[0] == b[0] and a[1] < b[1] and round(sum(w * y.get(t, 0) for t, w in x.items()), 9) >= least}
        assert {(r.a, r.b) for r in similarity.cosine_pairs(df, ["block"], "id", "t", least).collect()} == want


def test_stream_meets_the_store(spark, tmp_path):
    old = old_rows(spark).select("amdt_idx", "Num article", F.col("Exposé amdt").alias("t"))
    (new_rows(spark).select((F.col("amdt_idx") + 100).alias("amdt_idx"), "Num article", tx.normalize_text(F.col("Exposé amdt")).alias("t"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(old.schema).parquet(str(tmp_path / "in"))
    met = []
    match_stream(stream, old, ["Num article"], "amdt_idx", "t", 0.5, lambda df, n: met.extend((r.a, r.b) for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(met) == [(100, 0), (100, 1)]


def test_of_equal_prices_the_first_order_matches(spark, tmp_path):
    from gregale.plans.queries import QUERIES

    orders = [(1, 7, "F", 5.0), (2, 7, "F", 9.0), (3, 7, "F", 9.0), (4, 8, "O", 1.0), (5, 8, "O", 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.new_id, r.old_id) for r in QUERIES["best_match_merge_columns"](spark, str(tmp_path)).collect()} == {(7, 2), (8, 4)}


def test_orders_without_a_status_or_key_are_matched_as_in_sql(spark, tmp_path):
    import duckdb

    from gregale.plans.queries import QUERIES, SQL

    orders = [(1, 7, None, 9.0), (2, 7, "O", 5.0), (3, 8, "O", 1.0), (None, 8, "O", 2.0), (4, 9, "F", None), (None, 9, "O", 3.0), (5, None, None, 4.0), (6, None, "O", 4.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(SQL["best_match_merge_columns"]).fetchall()
    got = [tuple(r) for r in QUERIES["best_match_merge_columns"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (7, 1, 9.0, "corps") in got and (8, 3, 2.0, "expose") in got


def test_giving_back_broadcasts_nothing_that_grows_with_the_rows(spark):
    import __spark_entry__

    out = __spark_entry__.queries()["given_back"](spark, __spark_entry__.SMALL)
    assert len(out.collect()) == spark.read.parquet(f"{__spark_entry__.SMALL}/part.parquet").count()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
