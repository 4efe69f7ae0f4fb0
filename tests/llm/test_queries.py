"""The queries of the operators that SQL can't express, as they are registered, on small tables, against brute force on every column."""

import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken.load
from pyspark.sql import functions as F

from gregale.llm import quality, registry, tiff
from tests.llm.test_operators import LONG, TEXTS, brute_repeats

ROWS = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s0", "s0"][i % 4]) for i, t in enumerate([*TEXTS, LONG[:3000], "des mots " * 200, "the cat sat on the mat and saw the dog again " * 12])]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(len(ROWS))], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def run(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert len(rows) == len(ROWS) and {r.doc_id for r in rows} == {r[0] for r in ROWS}
    return {r.doc_id: r for r in rows}


def raw(row):
    return (row[1] or "").encode()


def words(row):
    return raw(row).split()


def test_op1(spark, sf):
    got = run(spark, sf, "op1_sharding")
    for row in ROWS:
        r = got[row[0]]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw(row)) + 8, zlib.crc32(raw(row)), "rows", None) and 0 <= r.shard < 24
    slots = {s: sorted(r.slot for r in got.values() if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, sf):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(path), special_tokens={})
    for i, r in run(spark, sf, "op2_bpe").items():
        text = ROWS[i][1] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op3(spark, sf):
    got = run(spark, sf, "op3_quality")
    crc = lambda i: zlib.crc32(str(i).encode())
    train = sorted((i for i, *_ in ROWS if crc(i) % 3 != 1))
    model = quality.SubwordModel().fit([ROWS[i][1] or "" for i in train], [i % 2 for i in train])
    score = quality.scorer(model)
    for row in ROWS:
        r = got[row[0]]
        assert r.held_out == (crc(row[0]) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        assert r.score == pytest.approx(score(row[1] or ""), abs=1e-9)


def test_op5(spark, sf):
    got = run(spark, sf, "op5_mixing")
    total = {s: sum(len(words(r)) for r in ROWS if r[3] == s) for s in ("s0", "s1", None)}
    taken = dict.fromkeys(total, 0)
    for row in ROWS:
        r = got[row[0]]
        assert (r["size"], r.source_size) == (len(words(row)), total[row[3]]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[row[3]] += r.taken
    assert sum({ROWS[i][3]: r.target for i, r in got.items()}.values()) == pytest.approx(1.5 * sum(total.values()))
    smallest = max(len(words(r)) for r in ROWS)
    assert all(abs(taken[s] - next(r.target for i, r in got.items() if ROWS[i][3] == s)) <= smallest for s in total)
    assert {i: r.taken for i, r in run(spark, sf, "op5_mixing").items()} == {i: r.taken for i, r in got.items()}


def test_op6(spark, sf):
    pages = {}
    for i, r in run(spark, sf, "op6_tiff").items():
        text = raw(ROWS[i])
        payload = text + b"\xff" * (576 * max(1, math.ceil(len(text) / 576)) - len(text))
        media = tiff.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        a = list(payload)
        mean = sum(a) / len(a)
        want = f"mean={mean:.4f};variance={sum(x * x for x in a) / len(a) - mean * mean:.4f};step={sum(abs(x - y) for x, y in zip(a, a[1:], strict=False)) / len(a):.4f}"
        assert r.feature.split(";", 1)[1] == want
        pages[i] = [(p.compression, p.predictor, p.tiled) for p in tiff.read_pages(media)]
    whole = pages[TEXTS.index(LONG)]
    assert {c for c, *_ in whole} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and {t for *_, t in whole} == {True, False} and {p for _, p, _ in whole} == {1, 2}


def test_op9(spark, sf):
    want = brute_repeats({(r[0], r[1]) for r in ROWS}, 100)
    for i, r in run(spark, sf, "op9_suffix").items():
        n, removed, spans, kept = want[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_op10(spark, sf):
    got = run(spark, sf, "op10_fertility")
    for row in ROWS:
        r, text, own = got[row[0]], row[1] or "", [w.decode() for w in words(row)]
        seen, dup = set(), 0
        for line in text.split("\n"):
            dup += line in seen and bool(line.strip(" \t\n\v\f\r"))
            seen.add(line)
        windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(own) < 50 or 100 * len(covered) > 50 * len(own)) and not (r.base_failed and r.kept)
