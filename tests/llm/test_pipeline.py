"""The stages on the smallest tables: each against brute force on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
import pytest

from gregale.llm.common import Scratch
from tests.llm.test_operators import BASE, LONG, TEXTS, brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    scratch, docs, out = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, stage in cp.STAGES:
        docs = scratch.keep(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def test_columns(results):
    assert [n for n, _ in cp.STAGES] == list(results)[1:]
    for name in list(results)[1:-1]:
        assert tuple(results[name].columns) == cp.COLUMNS


def test_quality_keeps_good(spark, results):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in results["quality_classifier"].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_lines(results):
    before = [(r.doc_id, r.text) for r in results["quality_classifier"].collect()]
    want = {i: kept for i, (n, gone, _, kept) in brute_lines(before).items() if gone < n or not gone}
    assert {r.doc_id: r.text for r in results["line_dedup"].collect()} == want


def test_groups(results):
    before = [(r.doc_id, r.text) for r in results["line_dedup"].collect()]
    want = {i for i, (_, c) in brute_components(before).items() if c == i}
    assert {r.doc_id for r in results["ngram_jaccard_join"].collect()} == want


def test_tokens_decode(results):
    texts = {r.doc_id: r.text for r in results["mixing_sources"].collect()}
    rows = results["byte_level_bpe"].collect()
    assert len(rows) == results["mixing_sources"].count()
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)


def test_mix_of_sources(results):
    before = {r.doc_id: r for r in results["ngram_jaccard_join"].collect()}
    copies = Counter(r.doc_id for r in results["mixing_sources"].collect())
    size = {i: len((r.text or "").encode().split()) for i, r in before.items()}
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    total, weights = Counter(), {}
    for i, r in before.items():
        total[r.source] += size[i]
    for k, s in enumerate(sorted(total)):
        weights[s] = [5, 2, 1][k % 3]
    level, open_, left, want = 0, set(total), 1.5 * sum(total.values()), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * total[s]}
        if not full:
            break
        for s in full:
            want[s], left = 2 * total[s], left - 2 * total[s]
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    for s in total:
        taken = sum(size[i] * n for i, n in copies.items() if before[i].source == s)
        assert abs(taken - want[s]) <= max(size.values())


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_odd_and_empty_tables(spark, tmp_path, case):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, kept_text string, size long, score double"
    rows = [(i, t, [None, "en"][i % 2], [None, "s"][i % 3 > 0], None if t is None else len(t), 7, "k", -1, 0.0) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, BASE, None, None, 1, 7, "k", -1, 0.0), (None, None, None, None, None, 7, "k", -1, 0.0), (3, "x " + LONG, "en", "s", 9, 7, "k", -1, 0.0)]
    spark.createDataFrame(rows if case == "odd" else [], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (6, 0, 0)] if case == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch, docs = Scratch(spark, "odd"), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        # each stage on the whole odd table, and on what came before it
        alone = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        n = alone.count()
        assert (n > 0) == (case == "odd") and (name == "byte_level_bpe" or tuple(alone.columns) == cp.COLUMNS)
        if name == "byte_level_bpe":
            assert n == len(rows) * (case == "odd")
        if name == "line_dedup" and case == "odd":
            assert Counter(r.doc_id for r in alone.collect())[None] == 2
    assert (docs.count() > 0) == (case == "odd")
