"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its words and of their character n-grams, all hashed into a fixed number of rows; a
softmax layer turns the average into class probabilities. Both layers are trained by numpy stochastic gradient descent on a bounded
sample of labelled documents. As averaging and the output layer are linear, a trained model gives each row one number (its part of
the difference of the two classes' logits), so scoring a text adds remembered numbers of its words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.llm.common import read, small_batches

#: Words that a worker remembers; a full memory starts anew.
MEMORY = 400_000


#: Rows with a meaning of their own: what every text has, and a pair of equal neighbouring words, which an average of vectors can't tell
#: for words that it hasn't learned.
TEXT, TWICE = 0, 1
#: A pair of equal neighbouring words counts as so many n-grams, as a word of usual length does.
PAIR_WEIGHT = 8


class Rows(dict):
    """Row of a hashed n-gram; remembers them, as there are few of two or three characters."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows = rows

    def __missing__(self, gram: str) -> int:
        row = 2 + zlib.crc32(gram.encode()) % (self.rows - 2)
        if len(self) < MEMORY:
            self[gram] = row
        return row


def features(word: str, rows: Rows, n: int) -> list[int]:
    """Rows of a word and of its character n-grams, with marks at its ends."""
    marked = f"<{word}>"
    return [2 + zlib.crc32(marked.encode()) % (rows.rows - 2), *[rows[marked[i : i + n]] for i in range(len(marked) - n + 1)]]


def pairs(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass
class SubwordModel:
    rows: int = 1 << 15
    dim: int = 8
    n: int = 3
    epochs: int = 5
    rate: float = 0.5
    vector_rate: float = 20.0
    batch: int = 32
    seed: int = 7
    logit: np.ndarray | None = None

    def _bag(self, text: str, memo: dict[str, list[int]], rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts: Counter[int] = Counter({TEXT: 1, TWICE: PAIR_WEIGHT * pairs(words)})
        for word, times in Counter(words).items():
            if word not in memo:
                memo[word] = features(word, rows, self.n)
            for f in memo[word]:
                counts[f] += times
        return np.fromiter(counts, np.int64), np.fromiter(counts.values(), np.float32)

    def fit(self, texts: list[str], labels: list[int]) -> SubwordModel:
        rng, memo, hashed = np.random.default_rng(self.seed), {}, Rows(self.rows)
        bags = [self._bag(t, memo, hashed) for t in texts]
        vectors = rng.uniform(-1 / self.dim, 1 / self.dim, (self.rows, self.dim)).astype(np.float32)
        out = np.zeros((2, self.dim), np.float32)
        y = np.asarray(labels, np.int64)
        steps, done = max(1, self.epochs * -(-len(bags) // self.batch)), 0
        for _ in range(self.epochs):
            order = rng.permutation(len(bags))
            for start in range(0, len(order), self.batch):
                slower = 1 - done / steps
                done += 1
                for i in order[start : start + self.batch]:
                    rows, counts = bags[i]
                    part = (counts / counts.sum())[:, None]
                    own = vectors[rows]
                    mean = (own * part).sum(axis=0)
                    z = out @ mean
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[y[i]] -= 1.0
                    vectors[rows] = own - part * (slower * self.vector_rate * (p @ out))
                    out -= slower * self.rate * np.outer(p, mean)
        self.logit = vectors.astype(np.float64) @ (out[1] - out[0]).astype(np.float64)
        return self


def scorer(model: SubwordModel):
    """A function from a text to the probability of class 1."""
    logit, memo, rows = model.logit.tolist(), {}, Rows(model.rows)

    def known(word: str) -> tuple[float, int]:
        own = features(word, rows, model.n)
        got = (sum([logit[r] for r in own]), len(own))
        if len(memo) >= MEMORY:
            memo.clear()
        if len(word) <= 64:
            memo[word] = got
        return got

    def score(text: str) -> float:
        words = text.split()
        twice = PAIR_WEIGHT * pairs(words)
        total, n = logit[TEXT] + logit[TWICE] * twice, 1 + twice
        get = memo.get
        for word in words:
            part, own = get(word) or known(word)
            total += part
            n += own
        return float(1 / (1 + np.exp(-np.clip(total / n, -30, 30))))

    return score


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` labelled rows of the training part (crc32 of the id as text, mod 3, is not 1), in the order of that crc32."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col(id_col), "quality").where(crc % 3 != 1).withColumn("crc", crc)
    sample = known.orderBy("crc", id_col, "quality").limit(most)  # a fixed number of rows
    # a repeated id brings one text, the one with the smallest hash, so that `most` holds
    texts = docs.select(id_col, "text").join(F.broadcast(sample.select(id_col).distinct()), id_col).groupBy(id_col).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sample.join(texts, id_col).select(id_col, "text", "quality")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 3000, **settings) -> SubwordModel:
    """A model fitted on at most `most` labelled documents, which the driver holds for the time of the fit.

    Null texts count as empty. Only the text is an input. Without any labelled row the model knows nothing and scores 0.5.
    """
    rows = sorted(training_rows(docs, labels, most).collect(), key=lambda r: (r.doc_id, r.text or "", r.quality))
    return SubwordModel(**settings).fit([r.text or "" for r in rows], [r.quality for r in rows])


def score_documents(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of class 1 for each whole text.

    Null and empty texts get the score of a text without words, which the model defines; null ids and repeated rows are scored
    like any. Other columns are left behind.
    """
    schema = docs.select(id_col).schema.add("score", "double")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # rows numbers, a fixed size
    memo: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memo:
            memo.append(scorer(shipped.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([memo[0](t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: SubwordModel, at_least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at_least or more, with all their columns."""
    scored = list(docs.columns).index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    memo: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memo:
            memo.append(scorer(shipped.value))
        for batch in batches:
            yield batch.filter(pa.array([memo[0](t or "") >= at_least for t in batch.column(scored).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
