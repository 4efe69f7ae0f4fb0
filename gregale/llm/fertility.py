"""Quality rules on tokeniser fertility.

Public vocabularies measure each text. One with byte fallback: characters per token, the share of tokens that are single fallback bytes,
and the entropy of its tokens. A byte-level one for many languages, which has no fallback: characters per token. Prose of a language lies in a band of each measure; what lies outside is rejected. The bands are
measured on all distinct texts of a language: the median, and a spread that narrows with the square root of a text's length, as a mean
over more tokens varies less. Each starts from a fixed band of the language's script and is refined by every text, so that there is
a band at any size of the table and none begins at a count. Entropy is first freed of what a short text lacks. Words are measured one by one, after a space each (a word's pieces
don't depend on its neighbours in such vocabularies), and remembered.

Beside them stand rules that need no vocabulary: too few words, or too many of them in three-word windows that come twice or more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gregale.llm.common import Scratch, read, small_batches

#: Words that a worker remembers; a full memory starts anew.
MEMORY = 300_000
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Rejection bands. spread: widths of a language's own spread, per root of tokens, beside a share of its median.

    weight: documents for which the fixed band of a language's script counts, beside the language's own. Documents without a language
    have a band of their script. entropy: a floor beside the bands, in scripts that the vocabulary has whole words of.
    """

    spread: float = 3.5
    share: float = 0.02
    byte_excess: float = 0.05
    entropy: float = 4.5
    weight: float = 5.0


@dataclass(frozen=True)
class Fixed:
    """A script's band before any document: chars per token, byte share, chars per byte-level token, and entropy freed of length, with shares of the centre to both sides."""

    chars: float
    bytes: float
    level: float
    entropy: float
    share: float = 0.45
    byte_excess: float = 0.05
    level_share: float = 0.6
    entropy_share: float = 0.2
    floor: bool = True


#: Tokens times bits that an entropy lacks per root of tokens, and spread of 1 / root of tokens: both before any document.
SLOPE, ROOTS = 13.0, 3e-4
#: Spread per root of tokens before any document: of chars per token, byte share, chars per byte-level token and entropy.
SPREADS = (1.0, 0.0, 1.0, 4.0)
#: Where scripts begin, and the number of each; 0 is Latin. ASCII signs belong to none.
STARTS = np.array([0, 0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x10000, 0x20000])
SCRIPTS = np.array([-1, 0, -1, 0, -1, 0, 2, 1, 3, 4, 5, 6, 0, 2, -1, 7, 8, 7, 9, 6, 7, 6, 6, 7])
#: From sample texts in the public vocabularies: Latin 1.9 to 3.9 chars per token, Cyrillic 2.3, the others 0.7 to 1; of byte-level ones
#: Latin 1.8 to 4.3, Cyrillic 2.8, the others 0.7 to 1.6: languages of a script differ more, as some have whole words there.
FIXED = [Fixed(2.75, 0.0, 3.0, 7.5), Fixed(2.0, 0.0, 2.5, 7.5), *[Fixed(0.9, 0.1, 1.1, 6.5, entropy_share=0.25, floor=False, byte_excess=0.2)] * 8]


MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "n_level_tokens", "script", "text_hash")] + [T.StructField("entropy", T.DoubleType())])


class Vocabularies:
    """Pieces of single words, and how many tokens each has in the byte-level vocabulary; remembers them."""

    def __init__(self, path: str, level_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        with open(level_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.level = tiktoken.Encoding("level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._words: dict[bytes, tuple[bytes, int]] = {}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """Pieces of all words, in order, and the number of byte-level tokens."""
        known = self._words
        got = list(map(known.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, g in zip(words, got, strict=True) if g is None))
            texts = [w.decode("utf-8", "replace") for w in new]
            pieces = self.model.encode(texts, num_threads=1)
            found = {w: (np.asarray(p, np.int32).tobytes(), len(self.level.encode_ordinary(f" {t}"))) for w, t, p in zip(new, texts, pieces, strict=True)}
            got = [found[w] if g is None else g for w, g in zip(words, got, strict=True)]
            if len(known) + len(found) > MEMORY:
                known.clear()
            if len(found) <= MEMORY:
                known.update((w, p) for w, p in found.items() if len(w) <= 64)
        return np.frombuffer(b"".join([p for p, _ in got]), np.int32), sum([n for _, n in got])


def repeated(words: list[bytes], n: int = 3) -> int:
    """Words in n-word windows that come twice or more, the first included."""
    if len(words) <= n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    key = ids[: len(ids) - n + 1]
    for k in range(1, n):  # numbered anew each time, so that a key never overflows
        _, key = np.unique(key * len(number) + ids[k : len(ids) - n + 1 + k], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    cover = np.zeros(len(words), bool)
    for k in range(n):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def script_of(text: str) -> int:
    """The script of most letters."""
    if text.isascii():
        return 0
    own = SCRIPTS[np.searchsorted(STARTS, np.frombuffer(text.encode("utf-32-le"), np.uint32), side="right") - 1]
    return int(np.bincount(own[own >= 0], minlength=1).argmax())


def measure(text: str, vocabularies: Vocabularies) -> tuple:
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    dup_lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += bool(line.strip(SPACES))
            else:
                seen.add(line)
    ids, level = vocabularies.ids(words)
    counts = np.bincount(ids)
    share = counts[counts > 0] / max(1, len(ids))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines, repeated(words),
        len(ids), int(vocabularies.is_byte[ids].sum()), level, script_of(text), xxhash.xxh64_intdigest(raw) - (1 << 63), float(-(share * np.log2(share)).sum()) if len(ids) else 0.0,
    )


def measure_documents(docs: DataFrame, vocabulary_path: str, level_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with `measures`: counts of words, their characters, symbols, repeated lines and words, tokens, fallback bytes, byte-level tokens, script, a hash of the text, and entropy.

    Null and empty texts measure 0 throughout; a column of that name is replaced; repeated rows are measured each. vocabulary_path: a
    sentencepiece model with byte fallback; level_path and pattern: ranks of byte-level tokens, and what splits texts before. Both files must be at their paths on every executor.
    """
    kept = [c for c in docs.columns if c != "measures"]
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("measures", MEASURES)])
    at = kept.index(text_col)
    memo: list[Vocabularies] = []
    kinds = pa.struct([(f.name, pa.float64() if f.name == "entropy" else pa.int64()) for f in MEASURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memo:
            memo.append(Vocabularies(vocabulary_path, level_path, pattern))
        for batch in batches:
            rows = [measure(t or "", memo[0]) for t in batch.column(at).to_pylist()]
            parts = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(parts, names=[f.name for f in kinds])], names=[*kept, "measures"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _quantiles(value: Column, step: float, *q: float) -> list[Column]:
    """The quantiles of a group in whole steps, exactly, from counts of each step."""
    found = F.percentile(F.round(value / step).cast("long"), list(q))
    return [found[i] * step for i in range(len(q))]


def _fixed(name: str, script: Column) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(f, name)) for f in FIXED]), (script + 1).cast("int"))


def judge(measured: DataFrame, rules: Rules = Rules(), lang_col: str = "lang") -> DataFrame:
    """measured with chars_per_token, byte_share, chars_per_level_token, base_failed and kept.

    Columns of measured named like the bands' own (band, own) or the new ones are left out. measured is read several times; it should
    be a stored table without texts. Medians are those of all distinct texts that the base rules pass; copies count once.
    """
    measured = measured.drop("band", "own", "chars_per_token", "byte_share", "chars_per_level_token", "base_failed", "kept")
    m = {f.name: F.col(f"measures.{f.name}") for f in MEASURES.fields}
    tokens, level_tokens = (F.when(m[n] > 0, m[n]) for n in ("n_tokens", "n_level_tokens"))
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    rows = measured.withColumns({"chars_per_token": F.coalesce(m["word_chars"] / tokens, F.lit(0.0)), "byte_share": F.coalesce(m["n_byte_tokens"] / tokens, F.lit(0.0)), "chars_per_level_token": F.coalesce(m["word_chars"] / level_tokens, F.lit(0.0)), "base_failed": failed})
    named = rows.withColumn("band", F.coalesce(F.col(lang_col), F.concat(F.lit("\0"), m["script"].cast("string"))))
    values = {"script": m["script"], "root": F.sqrt(m["n_tokens"]), "chars": F.col("chars_per_token"), "bytes": F.col("byte_share"), "level": F.col("chars_per_level_token"), "bits": m["entropy"]}
    texts = named.where(~F.col("base_failed")).groupBy("band", m["text_hash"].alias("hash")).agg(*[F.first(v).alias(k) for k, v in values.items()])  # a copy measures the same

    def refined(own: Column, fixed: Column | float) -> Column:
        return (F.col("n") * own + rules.weight * fixed) / (F.col("n") + rules.weight)

    ties = [F.count(F.lit(1)) * f for f in (F.var_pop(1 / F.col("root")), F.covar_pop(1 / F.col("root"), "bits"))]
    slope = F.greatest(F.lit(0.0), F.round((rules.weight * ROOTS * SLOPE - ties[1]) / (rules.weight * ROOTS + ties[0]), 1))  # of bits lacking
    centres = texts.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.mode("script", True).alias("script"), slope.alias("slope"), *[c.alias(f"{k}_mid") for k in ("chars", "bytes", "level") for c in _quantiles(F.col(k), 0.001, 0.5)])
    near = texts.join(F.broadcast(centres), "band").withColumn("entropy", F.col("bits") + F.col("slope") / F.col("root"))
    centres = centres.join(near.groupBy("band").agg(_quantiles(F.col("entropy"), 0.001, 0.5)[0].alias("entropy_mid")), "band")
    near = near.join(F.broadcast(centres.select("band", "entropy_mid")), "band")
    ends = {k: _quantiles((F.col(k) - F.col(f"{k}_mid")) * F.col("root"), 0.01, 0.25, 0.75) for k in ("chars", "bytes", "level", "entropy")}
    spreads = near.groupBy("band").agg(*[(high - low).alias(f"{k}_off") for k, (low, high) in ends.items()])
    shares = {"share": rules.share, "byte_excess": rules.byte_excess, "level_share": rules.share, "entropy_share": rules.share}
    bands = centres.join(spreads, "band").select(
        "band", "slope", _fixed("floor", F.col("script")).alias("floor"), *[refined(F.col(f"{k}_mid"), _fixed(k, F.col("script"))).alias(k) for k in ends],
        *[refined(F.col(f"{k}_off"), F.lit(s)).alias(f"{k}_spread") for k, s in zip(ends, SPREADS, strict=True)], *[refined(F.lit(v), _fixed(k, F.col("script"))).alias(k) for k, v in shares.items()],
    )
    width = lambda name, share: rules.spread * F.col(f"own.{name}_spread") / 1.349 / F.sqrt(tokens) + share
    fertile = F.abs(F.col("chars_per_token") - F.col("own.chars")) <= width("chars", F.col("own.share") * F.col("own.chars"))
    level_fits = F.abs(F.col("chars_per_level_token") - F.col("own.level")) <= width("level", F.col("own.level_share") * F.col("own.level"))
    bytes_fit = F.abs(F.col("byte_share") - F.col("own.bytes")) <= width("bytes", F.col("own.byte_excess"))
    entropy_fits = F.abs(m["entropy"] + F.col("own.slope") / F.sqrt(tokens) - F.col("own.entropy")) <= width("entropy", F.col("own.entropy_share") * F.col("own.entropy"))
    verdict = ~F.col("base_failed") & fertile & bytes_fit & level_fits & entropy_fits & (~F.col("own.floor") | (m["entropy"] >= rules.entropy))
    return named.join(F.broadcast(bands.select("band", F.struct(*[c for c in bands.columns if c != "band"]).alias("own"))), "band", "left").select(*rows.columns, verdict.alias("kept"))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = measure_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")
    out = judge(Scratch(spark, "fertility").keep(measured, "measures"))
    return out.select("doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "chars_per_token", "byte_share", "chars_per_level_token", F.col("measures.entropy").alias("token_entropy"))
