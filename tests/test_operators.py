import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gregale.operators import attribution as at
from gregale.operators import cluster, dedup, enrich, search
from gregale.operators import similarity
from gregale.operators.similarity import cosine_candidates, cosine_pairs, edit_pairs, edit_within


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], []).append(r["id"])
    return sorted(sorted(v) for v in out.values())


@pytest.fixture
def blocks(spark):
    rows = [("A", 0, "some text foo in lecture"), ("A", 1, "other words bar there"), ("B", 2, "alpha beta gamma delta"), ("B", 3, "alpha beta gamma delta"), ("B", 4, "alpha beta gamma omega"), (None, 5, "alpha beta gamma delta"), ("B", 6, "")]
    return spark.createDataFrame(rows, "block string, id long, text string")


def test_cosine_blocks_and_empties(blocks):
    pairs = {(r.a, r.b): r.cos for r in cosine_pairs(blocks, ["block"], "id", "text", 0.3).collect()}
    assert set(pairs) == {(2, 3), (2, 4), (3, 4)}
    assert pairs[2, 3] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        cosine_pairs(blocks, ["block"], "id", "text", 0.0)


def test_clusters(blocks):
    assert groups(cluster.tfidf_clusters(blocks, ["block"], "id", "text", 0.6)) == [[2, 3, 4]]
    assert groups(cluster.tfidf_clusters(blocks, ["block"], "id", "text", 0.01)) == [[2, 3]]
    assert groups(cluster.tfidf_clusters(blocks, ["block"], "id", "text", 1)) == [[0, 1], [2, 3, 4, 6]]
    with pytest.raises(ValueError):
        cluster.get_clusters(blocks, ["block"], "id", "text", 2, 0.5)


def test_candidates(blocks, spark):
    new = spark.createDataFrame([("B", 10, "alpha beta gamma delta")], "block string, id long, text string")
    found = {r.b for r in cosine_candidates(blocks, new, ["block"], "id", "text", 0.9).collect()}
    assert found == {2, 3}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert groups(cluster.components(links)) == [list(range(41)), [100, 101]]


@pytest.mark.parametrize("links_of_a_task", [1_000_000, 90])
def test_components_of_a_long_shuffled_chain(spark, monkeypatch, links_of_a_task):
    monkeypatch.setattr(cluster, "TASK_LINKS", links_of_a_task)
    for ids in (random.Random(1).sample(range(500), 500), [0, *range(99, 0, -1)]):
        links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
        assert groups(cluster.components(links)) == [list(range(len(ids)))]


def test_subdivide_splits_large(spark):
    rows = [(i, f"verbe{i % 5} texte commun avec numero{i // 5}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("block", F.lit("x"))
    found = cluster.tfidf_clusters(df, ["block"], "id", "text", 0.9)
    assert max(map(len, groups(found))) == 50
    assert max(map(len, groups(cluster.subdivide(found, df.select("id", "text"), 0.9)))) <= 50


def test_edit_pairs_and_bounds(spark):
    df = spark.createDataFrame([("abcd", "abdc"), ("same", "same"), ("", "")], "x string, y string")
    assert [r.pct for r in edit_pairs(df, "x", "y").collect()] == [75.0, 100.0, 100.0]
    assert [r[0] for r in df.select(edit_within(F.col("x"), F.col("y"), F.lit(1))).collect()] == [True, True, True]


def test_dedup(spark):
    df = spark.createDataFrame([(1, 100, "aaaaa", None), (2, 200, "b" * 15, "Zoé"), (3, 150, "c", "Zoé"), (4, 200, "d" * 16, "Ann"), (5, 1, "e", None)], "id long, time long, answer string, owner string")
    lots = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "id long, cluster long")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(dedup.keep_first(df, lots, "id", "id")) == [1, 5]
    assert ids(dedup.keep_newest_longest(df, lots, "id", "id", "time", "answer")) == [4, 5]
    assert ids(dedup.keep_majority_owner(df, lots, "id", "id", "owner", ["Ann"])) == [2, 5]
    assert {r.id: r.label for r in dedup.labels(df, lots, "id", "id").collect()}[3] == "1,2,3,4"
    assert {r.id: r.owner for r in dedup.populate(df, lots, "id", "id", ["owner"]).collect()} == {1: "Zoé", 2: "Zoé", 3: "Zoé", 4: "Zoé", 5: None}


def test_fold_is_order_dependent(spark):
    rows = [(9, 1, 1, 0.9, 0.5, "", 50), (9, 2, 2, 0.8, 0.5, "oui", 10), (9, 3, 3, 0.8, 0.5, "", 60), (9, 4, 4, 0.1, 0.5, "non", 99)]
    df = spark.createDataFrame(rows, "new_id long, old_id long, old_pos long, ratio double, least double, answer string, time long")
    assert search.best_match(df).first().old_id == 3
    assert search.best_match(df.where("old_id < 3")).first().old_id == 2
    assert search.best_match(df.where("old_id = 4")).count() == 0


def test_keywords(spark):
    df = spark.createDataFrame([(1, "a a a mot clé, fin"), (2, None), (3, "")], "id long, text string")
    words = spark.createDataFrame([("a a", "X"), ("mot clé", "Y"), ("mot clé", "Y"), ("fin", "Y")], "keyword string, owner string")
    hits = at.keyword_matches(df, words, "id", "text")
    assert sorted((r.keyword, r.owner) for r in hits.collect()) == [("a a", "X"), ("a a", "X"), ("fin", "Y"), ("mot clé", "Y")]
    assert at.vote(hits).first().owner == "X"
    comment = at.explain(hits, at.vote(hits)).first().comment
    assert comment == "Affectation sélectionnée: X\nAffectations par mots clés dans 'text' :\nX : [a a (x2)]\n\nAutres affectations possibles:\nAffectations par mots clés dans 'text' :\nY : [fin (x1), mot clé (x1)]\n"


def test_legal(spark):
    df = spark.createDataFrame([(1, "l'article 2 du code du travail"), (2, "article 9 du code du travail"), (3, "vu la loi du 1 janvier 2024, articles 1 et 2")], "id long, text string")
    codes = spark.createDataFrame([("travail", "2", "T")], "document string, article string, owner string")
    laws = spark.createDataFrame([("du 1 janvier 2024", "2", "L")], "document string, article string, owner string")
    assert [r.id for r in at.legal_matches(df, codes, None, "id", "text").collect()] == [1]
    assert [r.id for r in at.legal_matches(df, laws, at.LAW, "id", "text").collect()] == [3]


def test_codes_are_cited_as_one_pattern_would_find_them(spark):
    names = ["travail", "travail maritime", "de la route", "la route", "route", "securite sociale", "general des impots", "impots", "civil"]
    before = ["", "general des ", "general de ", "des ", "de ", "du ", "de la ", "d'", "de la", "du  "]
    rng = random.Random(5)
    texts = {i: " puis ".join(f"code {rng.choice(before)}{rng.choice(names)}{rng.choice(['', 's', ' maritime', ' code'])}" for _ in range(rng.randint(0, 3))) for i in range(300)} | {999: "code\ncivil", 1000: "code "}
    quoted = "|".join(sorted(map(re.escape, names), key=lambda n: (-len(n), n)))
    pattern = re.compile(rf"code\s(?:general\sdes?|des?|du|de\sla|d')?\s?((?:{quoted}))")
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {tuple(r) for r in at.cited_codes(df, spark.createDataFrame([(n,) for n in names], "document string")).collect()}
    assert got == {(i, m) for i, t in texts.items() for m in pattern.findall(t)}


def test_a_dictionary_of_100_000_codes(spark):
    documents = spark.range(100_000).select(F.concat(F.lit("nom "), F.col("id").cast("string"), F.lit(" fin")).alias("document"), F.lit("2").alias("article"), F.col("id").cast("string").alias("owner"))
    df = spark.createDataFrame([(1, "article 2 du code du nom 77 fin"), (2, "article 2 du code de la nom 99999 fin et du code nom 5 fin"), (3, "article 2, code nom 100000 fin")], "id long, text string")
    assert sorted((r.id, r.owner) for r in at.legal_matches(df, documents, None, "id", "text").collect()) == [(1, "77"), (2, "5"), (2, "99999")]
    assert at.legal_matches(df, documents.limit(0), None, "id", "text").collect() == []


def test_fold_of_very_many_candidates(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("new_id"), F.col("id").alias("old_id"), (-F.col("id")).alias("old_pos"), F.lit(0.9).alias("ratio"), F.lit(0.5).alias("least"), F.when(F.col("id") == 7, "x").otherwise("").alias("answer"), F.lit(5).alias("time"))
    plan = search.best_match(rows)
    assert [tuple(r) for r in plan.collect()] == [(1, 7, 0.9)] and "collect_list" not in plan._jdf.queryExecution().toString()


def test_only_the_first_rows_project_is_read(spark, tmp_path):
    spark.range(40).select("id", F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("origin_project")).write.partitionBy("origin_project").parquet(str(tmp_path / "s"))
    new = spark.createDataFrame([(2, "p3"), (1, "p2")], "id long, origin_project string")
    out = search.of_first_project(spark.read.parquet(str(tmp_path / "s")), new, "id")
    assert {r.origin_project for r in out.collect()} == {"p2"} and "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()


def test_credit(spark):
    html = "<table><tr><th>Programmes</th><th>+</th><th>-</th></tr><tr><td>un</td><td>170 000 000</td><td>0</td></tr><tr><td>deux</td><td>0</td><td>5</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<p>rien</p>"), (3, None)], "id long, html string")
    rows = df.select("id", F.explode(at.credit_rows("Autorisations d’engagement")("html")).alias("r")).select("id", "r.program", at.amount(F.col("r.plus")).alias("plus"), at.amount(F.col("r.minus")).alias("minus"))
    assert sorted(map(tuple, rows.collect())) == [(1, "deux", 0, 5), (1, "un", 170000000, 0)]
    owners = spark.createDataFrame([("un", "Alice"), ("deux", "Bob")], "program string, owner string")
    assert [(r.program, r.owner) for r in at.credit_matches(rows, owners).collect()] == [("un", "Alice")]


def test_opinion_and_merge(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "Sagesse"), (3, None, "Défavorable")], "id long, grp string, opinion string")
    defaults = spark.createDataFrame([("a", "Favorable"), ("b", "Défavorable")], "grp string, default string")
    assert {r.id: r.opinion for r in enrich.default_opinion(df, defaults).collect()} == {1: "Favorable", 2: "Sagesse", 3: "Défavorable"}
    base = spark.createDataFrame([(1, ""), (2, "x")], "id long, Commentaires string")
    one = spark.createDataFrame([(1, "u"), (2, "")], "id long, Commentaires string")
    assert {r.id: r.Commentaires for r in enrich.merge_results(base, [(one, ["Commentaires"]), (base, ["Commentaires"])], "id").collect()} == {1: "u", 2: "x\nx"}


def test_summary_client(spark):
    df = spark.createDataFrame([(1, "Amendement rédactionnel.", "c", ""), (2, "long", "c", ""), (3, None, "c", "reste")], "id long, expose string, corps string, objet string")
    out = enrich.summarise(df, lambda: lambda p: "mot " * 30 if not p.startswith("court") else "bref", "{{expose_amdt}}", "court {{summary}}")
    assert {r.id: r.objet for r in out.collect()} == {1: "Amendement rédactionnel.", 2: "bref", 3: "reste"}


def plain_clusters(texts, eps):
    """{smallest id: ids} of components at a TF-IDF cosine distance of eps or less, of two or more."""
    words = {i: Counter(re.findall(r"\w\w+", t.lower())) for i, t in texts.items()}
    df = Counter(w for c in words.values() for w in c)
    vectors = {}
    for i, c in words.items():
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / size for w, x in v.items()}
    label = {i: i for i in texts}
    near = [(a, b) for a in texts for b in texts if a < b and round(sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()), 9) >= round(1 - eps, 9)]
    for _ in texts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    out = {}
    for i, c in label.items():
        out.setdefault(c, []).append(i)
    return {c: v for c, v in out.items() if len(v) > 1}


def plain_subdivision(texts, eps):
    done, work = [], [sorted(v) for v in plain_clusters(texts, eps).values()]
    start = max(0.6 * eps, 0.1)
    for depth in range(5):
        done += [c for c in work if len(c) <= 30]
        large = [c for c in work if len(c) > 30]
        if not large:
            return sorted(done)
        now, work = max(start - 0.05 * (depth + 1), 0.1), []
        for c in large:
            parts = plain_clusters({i: texts[i] for i in c}, now)
            if parts:
                work += [sorted(v) for v in parts.values()]
            else:
                done.append(c)
        if now <= 0.1:
            break
    return sorted(done + work)


def test_subdivision_against_step_by_step(spark):
    rng = random.Random(12)
    base = [[f"mot{rng.randrange(60)}" for _ in range(14)] for _ in range(3)]
    texts = {i: " ".join(w if rng.random() > 0.12 else f"mot{rng.randrange(60)}" for w in base[i % 3]) for i in range(110)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("block", F.lit("x"))
    found = cluster.tfidf_clusters(df, ["block"], "id", "text", 0.45)
    got = groups(cluster.subdivide(found, df.select("id", "text"), 0.45))
    want = plain_subdivision(texts, 0.45)
    assert max(map(len, plain_clusters(texts, 0.45).values())) > 30 and sorted(sorted(g) for g in got) == want


def test_copies_are_compared_once_and_lose_no_pair(spark):
    """Equal texts are one class: measured once, and all pairs of rows come back; nulls and rows without a cluster too."""
    rows = spark.createDataFrame([(i, "c" if i < 40 else None, ["red bolt", "hot ring", None][i % 3]) for i in range(42)], "id long, cluster string, text string")
    seen = []

    def measure(pairs):
        seen.append(pairs.count())
        return pairs.withColumn("k", F.levenshtein("text_a", "text_b"))

    got = {(r.a, r.b): r.k for r in similarity.every_pair(rows, measure).collect()}
    apart = lambda a, b: None if 2 in (a % 3, b % 3) else 0 if a % 3 == b % 3 else 7
    assert seen == [6] and got == {(a, b): apart(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_similar_comments_leave_a_row_and_its_number_out(spark):
    rows = spark.createDataFrame([(1, "c", "7", "abcd"), (2, "c", "7", "abcd"), (3, "c", "8.", "abcd"), (4, "c", "9", "abcx"), (5, "d", "7", "abcd")], "id long, cluster string, num string, text string")
    got = {r.id: r.comment for r in enrich.similar_in_clusters(rows).collect()}
    assert got == {1: "Amdt similaires : 8. (100%), 9 (75%)", 2: "Amdt similaires : 8. (100%), 9 (75%)", 3: "Amdt similaires : 7 (100%), 7 (100%), 9 (75%)", 4: "Amdt similaires : 7 (75%), 7 (75%), 8. (75%)"}


def test_equal_texts_meet_once(spark):
    """Copies don't add rows to the join, whose clusters and pairs have them all; rows without terms stay alone."""
    rows = [(i, "b", ["rouge vif clair", "rouge vif sombre", "vert"][i % 3]) for i in range(60)] + [(60, "b", ""), (61, "b", None)]
    df = spark.createDataFrame(rows, "id long, block string, text string")
    pairs, classes = similarity.cosine_classes(df, ["block"], "id", "text", 0.3)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)] and classes.count() == 60
    assert {r.id: r.cluster for r in cluster.tfidf_clusters(df, ["block"], "id", "text", 0.7).collect()} == {i: 2 if i % 3 == 2 else 0 for i in range(60)}
    assert cosine_pairs(df, ["block"], "id", "text", 0.3).count() == 40 * 39 // 2 + 20 * 19 // 2


def test_plain_credit_tables_are_read_as_the_parser_does(monkeypatch):
    """Plain markup, which the parser isn't asked about, and markup that it is."""
    rng = random.Random(4)
    tags = [f"<{s}{t}>" for s in ("", "/") for t in ("table", "tr", "td", "th", "p")] * 2 + ["a > b", "+", "-", " é\n", "12"]
    plain = ["".join(rng.choice(tags) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    odd = [m + x for m, x in zip(plain, ["<td class='x'>1</td>", "&amp;", "<br>", "<TD>", "< td>", "<!-- <td> -->", "<"] * 10)]

    def by_parser(markup):
        parser = at._Table()
        parser.feed(markup)
        parser.close()
        return parser.tables

    assert all(at._tables(m) == by_parser(m) for m in plain + odd)
    monkeypatch.setattr(at._Table, "feed", None)
    assert all(at._tables(m) is not None for m in plain)


def test_credit_tables_are_read_once(spark):
    df = spark.createDataFrame([(1, "<table></table>")], "id long, html string")
    owners = spark.createDataFrame([("un", "Alice")], "program string, owner string")
    plan = at.credit_matcher(owners, "x", ("html",)).match(df, "html")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("ArrowEvalPython|ArrowAggregatePython|EvalPython", plan)) == 1
