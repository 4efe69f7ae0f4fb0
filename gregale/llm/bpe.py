"""Byte-level BPE by monoid tree reduction.

Texts are cut by the vocabulary's pattern; each match is encoded alone. A match that is a token of its own is that token. Any other
is halved until the halves are short, the halves are merged by rank, and neighbours are joined again: encodings form a monoid whose
product re-encodes a window around the seam.

Why a window is enough: a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of
theirs. (Until a merge crosses a border between final tokens, merges inside two neighbours run as they would without the rest, as
each is the lowest-ranked and leftmost of all pairs and so of their own; a first merge across their border would also be made
without the rest.) So a seam whose two tokens fit together needs nothing; otherwise the tokens next to it are encoded anew, twice as
many on each side that doesn't fit yet, until both ends of the window fit what lies outside. From there nothing can change.

Decoding is the same reduction with plain concatenation.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gregale.llm.common import read, small_batches

LEAF = 3
NONE = 1 << 31
#: Entries of each of a worker's memories; a full one starts anew.
MEMORY = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeEncoder:
    """Encodes bytes and texts; ranks must have all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks, self.spaced = ranks, spaced
        self.token = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.find = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self._matches: dict[str, bytes] = {}
        self._runs: dict[bytes, tuple[int, ...]] = {}
        self._chunks: dict[str, bytes | None] = {}

    def merge(self, run: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost of equals."""
        ranks = self.ranks
        if len(run) > 64:
            return self._merge_long(run)
        parts = [run[i : i + 1] for i in range(len(run))]
        pairs = [ranks.get(run[i : i + 2], NONE) for i in range(len(run) - 1)]
        while pairs and (best := min(pairs)) != NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], NONE)
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, run: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(run)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n

        def pair(i: int) -> tuple[int, int, int] | None:
            j = end[i]
            if j < n and (rank := ranks.get(run[i : end[j]])) is not None:
                return rank, i, end[j]
            return None

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
                continue
            j = end[i]
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
            for k in (i, before[i]):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[run[i : end[i]]])
            i = end[i]
        return tuple(out)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """What two neighbouring tokens' bytes encode to; they fit if to themselves."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self.merge(self.token[a] + self.token[b])
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        a, b = left[-1], right[0]
        window = self.pair(a, b)
        if window == (a, b):
            return left + right
        i = j = 1
        while True:
            left_fits = i == len(left) or self.pair(left[-i - 1], window[0]) == (left[-i - 1], window[0])
            right_fits = j == len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if left_fits and right_fits:
                return left[:-i] + window + right[j:]
            i = i if left_fits else min(2 * i, len(left))
            j = j if right_fits else min(2 * j, len(right))
            window = self.merge(b"".join([self.token[t] for t in left[-i:] + right[:j]]))

    def encode_run(self, run: bytes) -> tuple[int, ...]:
        if len(run) <= LEAF:
            known = self._runs.get(run)
            if known is None:
                known = self.merge(run)
                if len(self._runs) >= MEMORY:
                    self._runs.clear()
                self._runs[run] = known
            return known
        return self.join(self.encode_run(run[: len(run) // 2]), self.encode_run(run[len(run) // 2 :]))

    def encode_match(self, match: str) -> bytes:
        """Ids of one match of the pattern, packed as int32."""
        known = self._matches.get(match)
        if known is None:
            run = match.encode()
            whole = self.ranks.get(run)
            ids = (whole,) if whole is not None else self.encode_run(run)
            known = array("i", ids).tobytes()
            if len(run) <= 64:
                if len(self._matches) >= MEMORY:
                    self._matches.clear()
                self._matches[match] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text.

        spaced: the pattern lets a space between two characters that aren't white space begin a match and end none, so the text falls there into
        chunks that are encoded alone and remembered. A chunk that would begin or end with other white space, or be empty, makes
        its text fall back to matching as one.
        """
        if not text:
            return np.zeros(0, np.int32)
        if not self.spaced:
            return np.frombuffer(b"".join(map(self.encode_match, self.find(text))), np.int32)
        first, *rest = text.split(" ")
        known = self._chunks
        ids = [self._chunk(first, "")]
        for chunk in rest:
            got = known.get(chunk, 0)
            ids.append(self._chunk(chunk, " ") if got == 0 else got)
        if None in ids:
            return np.frombuffer(b"".join(map(self.encode_match, self.find(text))), np.int32)
        return np.frombuffer(b"".join(ids), np.int32)

    def _chunk(self, chunk: str, space: str) -> bytes | None:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        out = b"".join(map(self.encode_match, self.find(space + chunk)))
        if space and len(chunk) <= 64:
            if len(self._chunks) >= MEMORY:
                self._chunks.clear()
            self._chunks[chunk] = out
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def code_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): each whole text's tokens, and the bytes that these decode to.

    Null and empty texts have no tokens and decode to no bytes; a null id stays null; repeated rows are coded each. Other columns
    are left behind. The vocabulary file must be at ranks_path on every executor; it isn't shipped.
    """
    import public_tokenizers

    spaced = pattern == public_tokenizers.PATTERN
    schema = T.StructType([*docs.select(id_col).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    memo: list[TreeEncoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memo:
            memo.append(TreeEncoder(load_ranks(ranks_path), pattern, spaced))
        coder = memo[0]
        for batch in batches:
            each = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([coder.decode(x.tolist()) for x in each], pa.binary())], names=[id_col, "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = code_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
