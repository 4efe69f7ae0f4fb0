"""The classifier's training and the fertility bands, each from its formulae in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from gregale.llm import fertility, quality


def bag(text, rows, n):
    """{row: count} of words between spaces, of their n-grams with marks at the ends, of the text itself, and of equal neighbours."""
    words = text.split()
    out = Counter({0: 1, 1: 8 * sum(a == b for a, b in zip(words, words[1:], strict=False))})
    for word in words:
        marked = f"<{word}>"
        for part in [marked, *(marked[i : i + n] for i in range(len(marked) - n + 1))]:
            out[2 + zlib.crc32(part.encode()) % (rows - 2)] += 1
    return out


def test_training_and_scores_follow_the_formulae():
    """Gradient steps of a softmax over averaged vectors, one text at a time, at a falling rate; the score is the softmax of the average."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["le", "chat", "dort", "ici", "xx", "yy"][: 4 if i % 2 else 6]) for _ in range(rng.randint(0, 12))) for i in range(40)]
    labels = [i % 2 for i in range(40)]
    model = quality.SubwordModel(rows=64, dim=3, epochs=2, batch=8, rate=0.3, vector_rate=5.0, seed=5).fit(texts, labels)

    order = np.random.default_rng(5)
    vectors = [[float(x) for x in row] for row in order.uniform(-1 / 3, 1 / 3, (64, 3)).astype(np.float32)]
    weights = [[0.0] * 3, [0.0] * 3]
    steps, done = 2 * 5, 0

    def average(counts):
        total = sum(counts.values())
        return [sum(c * vectors[r][d] for r, c in counts.items()) / total for d in range(3)]

    def softmax(mean):
        z = [sum(w * m for w, m in zip(row, mean, strict=True)) for row in weights]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    for _ in range(2):
        turn = order.permutation(40)
        for start in range(0, 40, 8):
            slower = 1 - done / steps
            done += 1
            for i in turn[start : start + 8]:
                counts = bag(texts[i], 64, 3)
                mean = average(counts)
                error = [p - (k == labels[i]) for k, p in enumerate(softmax(mean))]
                back = [sum(error[k] * weights[k][d] for k in (0, 1)) for d in range(3)]
                for r, c in counts.items():
                    for d in range(3):
                        vectors[r][d] -= slower * 5.0 * c / sum(counts.values()) * back[d]
                for k in (0, 1):
                    for d in range(3):
                        weights[k][d] -= slower * 0.3 * error[k] * mean[d]
    score = quality.scorer(model)
    for text in [*texts, "", "inconnu inconnu", "chat"]:
        assert score(text) == pytest.approx(softmax(average(bag(text, 64, 3)))[1], abs=2e-4)
    assert len({round(score(t), 3) for t in texts}) > 10


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def quantile(values, step, part):
    return float(np.percentile([half_up(v / step) for v in values], 100 * part)) * step


def plain_verdicts(rows, rules):
    """{id: kept} of measured rows, band by band."""
    base = {i: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for i, _, m in rows}
    name = lambda lang, m: lang if lang is not None else m["script"]
    out = {}
    for band in {name(lang, m) for _, lang, m in rows}:
        own = {m["text_hash"]: m for i, lang, m in rows if name(lang, m) == band and not base[i]}
        n, w = len(own), rules.weight
        if not n:
            out |= {i: False for i, lang, m in rows if name(lang, m) == band}
            continue
        scripts = Counter(m["script"] for m in own.values())
        fixed = fertility.FIXED[min(s for s, c in scripts.items() if c == max(scripts.values()))]
        value = {
            "chars": lambda m: m["word_chars"] / m["n_tokens"] if m["n_tokens"] else 0.0,
            "bytes": lambda m: m["n_byte_tokens"] / m["n_tokens"] if m["n_tokens"] else 0.0,
            "level": lambda m: m["word_chars"] / m["n_level_tokens"] if m["n_level_tokens"] else 0.0,
        }
        inverse, bits = ([f(m) for m in own.values()] for f in (lambda m: 1 / math.sqrt(m["n_tokens"]), lambda m: m["entropy"]))
        slope = (w * fertility.ROOTS * fertility.SLOPE - n * float(np.cov(inverse, bits, ddof=0)[0, 1])) / (w * fertility.ROOTS + n * float(np.var(inverse)))
        slope = max(0.0, half_up(slope * 10) / 10)
        value["entropy"] = lambda m, s=slope: m["entropy"] + s / math.sqrt(m["n_tokens"])
        mixed = lambda mine, first, n=n: (n * mine + w * first) / (n + w)
        middle = {k: quantile(map(f, own.values()), 0.001, 0.5) for k, f in value.items()}
        spread = {}
        for (k, f), first in zip(value.items(), fertility.SPREADS, strict=True):
            off = [(f(m) - middle[k]) * math.sqrt(m["n_tokens"]) for m in own.values()]
            spread[k] = mixed(quantile(off, 0.01, 0.75) - quantile(off, 0.01, 0.25), first)
        centre = {k: mixed(middle[k], getattr(fixed, k)) for k in value}
        side = {"chars": mixed(rules.share, fixed.share) * centre["chars"], "level": mixed(rules.share, fixed.level_share) * centre["level"], "bytes": mixed(rules.byte_excess, fixed.byte_excess), "entropy": mixed(rules.share, fixed.entropy_share) * centre["entropy"]}
        for i, lang, m in rows:
            if name(lang, m) == band:
                fits = not base[i] and all(abs(f(m) - centre[k]) <= rules.spread * spread[k] / 1.349 / math.sqrt(m["n_tokens"]) + side[k] for k, f in value.items())
                out[i] = fits and (not fixed.floor or m["entropy"] >= rules.entropy)
    return out


def test_fertility_verdicts_follow_the_bands(spark):
    rng = random.Random(2)
    common = "le chat dort sur la table et le chien mange dans une grande maison avec des enfants qui jouent toute la journée près du jardin".split()
    english = "the cat sleeps on a table while some dogs eat in one large house with children who play all day near that garden".split()
    words = {"fr": common, "en": english, None: common, "el": ["και", "το", "σπίτι", "είναι", "μεγάλο", "στην", "πόλη", "με", "κήπο"]}
    rows = []
    for i in range(260):
        lang = ["fr", "en", None, "el"][i % 4]
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", ".", str(rng.randrange(99))]) for _ in range(rng.randint(40, 200)))
        if i % 13 == 0:
            text = " ".join("".join(rng.choice("qxzjkvw#$") for _ in range(9)) for _ in range(80))
        if i % 17 == 0:
            text = " ".join(chr(rng.randrange(0x13000, 0x13400)) * 3 for _ in range(70))
        rows.append((i, text, lang))
    rows += [(300, rows[5][1], rows[5][2]), (301, None, "fr"), (302, "", None), (303, "mot " * 90, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    measured = fertility.measure_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text").cache()
    got = {r.doc_id: r.kept for r in fertility.judge(measured).collect()}
    want = plain_verdicts([(r.doc_id, r.lang, r.measures.asDict()) for r in measured.collect()], fertility.Rules())
    assert got == want and 50 < sum(got.values()) < 250
