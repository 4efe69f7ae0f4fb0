"""Removal of repeated byte strings by suffix arrays of linear grouping construction.

suffix_array() sorts suffixes in two phases. The first groups them by their longest Lyndon prefixes: groups are processed from the
highest down; each member points at the nearest position before it that is still in a lower group, and positions so pointed at
move into new groups right above their own, higher the more members point at them. The second phase reads the array from its
start and writes each suffix's predecessors, along the same pointers, to the next free places of their groups. No names are given
and no smaller string is sorted.

To bring equal strings of `length` bytes together, each such window is represented by one of its inner strings of GRAM bytes, the
one with the smallest hash (the last of equals): equal windows have equal representatives at the same offset. Windows of one document
with the same representative are neighbours and form one stretch of text. Grams that represent more than one stretch are found by
counts; their stretches meet in the task of their gram, where each distinct stretch is taken once, the stretches are sorted by
suffix, and of equal windows, which are neighbours then, only the first in the corpus isn't marked. Texts meet their marks by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.llm.common import Scratch, even_keys, read, shuffle_partitions, small_batches

GRAM = 32
#: Bytes of one gram's stretches that are sorted together; beyond that they are cut into shorter ones.
SORTED_BYTES = 1 << 16
#: Bytes after which the stretches of several grams are sorted.
CHUNK_BYTES = 1 << 12
#: Bytes of documents that one task's grams are to come from.
TASK_BYTES = 12_000_000
_RANDOM = np.random.default_rng(9)
BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_RANDOM.integers(0, 2**63)) * 2 + 1
PLACE_BITS = np.uint64(28)
#: Stands for several stretches of a portion that one gram represents.
SEVERAL = np.int64(-1)
#: Where a stretch begins: its row's id, the hash of its row's text, the byte.
Place = tuple[int, int, int]


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in lexicographic order, the empty one first."""
    n = len(text) + 1
    symbols = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0)
    order = np.argsort(symbols, kind="stable")
    first = np.searchsorted(symbols[order], symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    order, group, place = order.tolist(), first.tolist(), place.tolist()  # members by group; a position's group, named by its start; its place in order
    size = np.bincount(first, minlength=n).tolist()
    prev = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                m = size[g] - 1
                if m:
                    last = g + m
                    q, at = order[last], place[p]
                    order[at] = q
                    place[q] = at
                    order[last] = p
                    place[p] = last
                    size[g] = m
                    size[last] = 1
                    group[p] = last
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = prev[p]
                prev[i] = p
                pointed[p] = pointed.get(p, 0) + 1
            pointed.pop(-1, None)
            levels: dict[int, list[int]] = {}
            for p, times in pointed.items():
                levels.setdefault(times, []).append(p)
            for times in sorted(levels, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in levels[times]:
                    moved.setdefault(group[p], []).append(p)
                for g, members in moved.items():
                    m = size[g] - len(members)
                    if not m:
                        continue
                    last = g + size[g]
                    for p in members:
                        last -= 1
                        q, at = order[last], place[p]
                        order[at] = q
                        place[q] = at
                        order[last] = p
                        place[p] = last
                        group[p] = last
                    for p in members:
                        group[p] = last
                    size[g] = m
                    size[last] = len(members)
        end = start
    free = list(range(n))
    out = [0] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = free[g]
            out[at] = j
            free[g] = at + 1
            done[j] = 1
            j = prev[j]
    return out


_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64)
    return _powers


def stretches(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram's hash, gram's place, first window, last window) of each stretch, in order; data are texts that begin at starts.

    Every window of `length` bytes inside a text lies in exactly one stretch: those of neighbouring windows with one representative.
    """
    n = len(data)
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * power[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    key = h >> PLACE_BITS << PLACE_BITS
    key |= (np.uint64((1 << 28) - 1) - np.arange(len(h), dtype=np.uint64))
    low, reach = key, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (np.uint64((1 << 28) - 1) - (low & np.uint64((1 << 28) - 1))).astype(np.int64)
    inside = np.ones(len(at), bool)
    for s in starts[1:]:
        inside[max(0, s - length + 1) : s] = False
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    return h[at[first]], at[first], first, last


def _joined(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts' bytes in portions of some MB: (index of the first text, bytes, starts)."""
    at, size, raw = 0, 0, []
    for i, text in enumerate(texts):
        raw.append((text or "").encode())
        if len(raw[-1]) >= 1 << 27:
            raise ValueError("a text of 134 MB or more; places hold 28 bits")
        size += len(raw[-1])
        if size >= 1 << 20 or i == len(texts) - 1:
            starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])[:-1].astype(np.int64)
            yield at, np.frombuffer(b"".join(raw), np.uint8), starts
            at, size, raw = i + 1, 0, []


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pack(part: np.ndarray, keys: np.ndarray, **columns) -> pa.RecordBatch:
    """One row per part, under its key, with each column's values of that part as bytes. Rows must come sorted by part."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cuts[1:], len(part))
    return _batch(part=pa.array(keys[part[cuts]], pa.int64()), **{k: pa.array([v[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary()) for k, v in columns.items()})


def _part(gram: np.ndarray, parts: int) -> np.ndarray:
    """Hashes of representatives are small, so they are mixed before their upper bits choose a part."""
    mixed = gram * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def repeated_grams(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """(node, numbers): which of a text's stretches, by number, have a gram that represents another stretch, too, of this text or another. texts: (node, text)."""

    keys = np.array(even_keys(texts.sparkSession, parts))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            fresh = [i for i, x in enumerate(nodes.tolist()) if not (x in seen or seen.add(x))]
            if len(seen) > 500_000:
                seen.clear()
            nodes, texts = nodes[fresh], [texts[i] for i in fresh]
            for at, data, starts in _joined(texts):
                gram, _, first, _ = stretches(data, starts, length)
                if len(gram):
                    row = np.searchsorted(starts, first, side="right") - 1
                    number = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.uint32)
                    _, which, times = np.unique(gram, return_inverse=True, return_counts=True)
                    several = times[which] > 1
                    lone, one = np.flatnonzero(~several), np.unique(which[several], return_index=True)[1]
                    one = np.flatnonzero(several)[one]
                    told = np.flatnonzero(several)
                    # grams with the stretch that they represent (0), or with SEVERAL of this portion, which are told here (1)
                    kind = np.repeat(np.array([0, 0, 1], np.uint8), [len(lone), len(one), len(told)])
                    at_ = np.concatenate([lone, one, told])
                    node = nodes[at + row[at_]]
                    node[len(lone) : len(lone) + len(one)] = SEVERAL
                    part = _part(np.where(kind == 0, gram[at_], node.view(np.uint64)), parts)
                    order = np.lexsort((node, part))
                    yield _pack(part[order], keys, kind=kind[order], gram=gram[at_][order], node=node[order], number=number[at_][order])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[bytes]] = [[], [], [], []]
        for batch in batches:
            for i in range(4):
                columns[i] += batch.column(i + 1).to_pylist()
        kind, gram, node, number = (np.frombuffer(b"".join(c), k) for c, k in zip(columns, (np.uint8, np.uint64, np.int64, np.uint32), strict=True))
        del columns
        told_node, told_number = node[kind == 1], number[kind == 1]
        gram, node, number = gram[kind == 0], node[kind == 0], number[kind == 0]
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        same = g[1:] == g[:-1]
        many = np.zeros(len(g), bool)
        many[1:] |= same
        many[:-1] |= same
        order = order[many]
        order = order[np.lexsort((number[order], node[order], gram[order]))]
        gram, node, number = gram[order], node[order], number[order]
        # copies of a whole text bring the same (node, number); they count once
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]) | (number[1:] != number[:-1]) & (node[1:] != SEVERAL)
        gram, node, number = gram[new], node[new], number[new]
        cuts = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
        times = np.diff(np.append(cuts, len(gram)))
        held = np.logical_or.reduceat(node == SEVERAL, cuts) if len(cuts) else np.zeros(0, bool)
        many = np.repeat((times > 1) | held, times) & (node != SEVERAL)
        node, number = np.concatenate([told_node, node[many]]), np.concatenate([told_number, number[many]])
        order = np.argsort(node, kind="stable")
        node, number = node[order], number[order]
        cuts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1)) if len(node) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(node))
        for s in range(0, len(cuts), 5000):
            pick = range(s, min(s + 5000, len(cuts)))
            yield _batch(node=pa.array(node[cuts[s : s + 5000]], pa.int64()), numbers=pa.array([number[cuts[i] : ends[i]].tobytes() for i in pick], pa.binary()))

    dealt = texts.mapInArrow(find, "part long, kind binary, gram binary, node binary, number binary").repartition(parts, "part")
    return dealt.mapInArrow(count, "node long, numbers binary")


def deal_stretches(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Packed stretches by part of their grams. rows: (doc, node, text, numbers array<binary>).

    Of equal stretches of a portion only the first goes on; the others are covered whole, which is told here (kind 1). So a passage
    of a third of all texts costs an entry per portion.
    """
    keys = np.array(even_keys(rows.sparkSession, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts, wanted = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, data, starts in _joined(texts):
                gram, grams_at, first, last = stretches(data, starts, length)
                if not len(gram):
                    continue
                head = np.searchsorted(np.searchsorted(starts, first, side="right") - 1, np.arange(len(starts)))
                picked = np.unique(np.concatenate([head[i] + np.frombuffer(b"".join(wanted[at + i]), np.uint32).astype(np.int64) for i in range(len(starts))]))
                row, raw = np.searchsorted(starts, first, side="right") - 1, data.tobytes()
                place = list(zip(docs[at + row[picked]].tolist(), nodes[at + row[picked]].tolist(), (first[picked] - starts[row[picked]]).tolist(), strict=True))
                known: dict[tuple[int, bytes], int] = {}
                covered = np.zeros(len(picked), bool)
                for i, (s, e, o) in enumerate(zip(first[picked].tolist(), (last[picked] + length).tolist(), (grams_at[picked] - first[picked]).tolist(), strict=True)):
                    j = known.setdefault((o, raw[s:e]), i)
                    if j != i and place[i] != place[j]:
                        if place[i] < place[j]:
                            known[(o, raw[s:e])], i = i, j
                        covered[i] = True
                del known, place
                part = _part(np.where(covered, nodes[at + row[picked]].view(np.uint64), gram[picked]), parts)
                order = np.argsort(part, kind="stable")
                picked, part, covered = picked[order], part[order], covered[order]
                gram, grams_at, first, last, row = gram[picked], grams_at[picked], first[picked], last[picked], row[picked]
                pieces = [b"" if c else raw[s : e + length] for s, e, c in zip(first.tolist(), last.tolist(), covered.tolist(), strict=True)]
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(cuts[1:], len(part))
                packed = _pack(part, keys, kind=covered.astype(np.uint8), gram=gram, doc=docs[at + row], node=nodes[at + row], start=(first - starts[row]).astype(np.uint32), offset=(grams_at - first).astype(np.uint16), size=(last - first + length).astype(np.uint16))
                yield packed.append_column("bytes", pa.array([b"".join(pieces[s:e]) for s, e in zip(cuts, ends, strict=True)], pa.binary()))

    return rows.mapInArrow(run, "part long, kind binary, gram binary, doc binary, node binary, start binary, offset binary, size binary, bytes binary").repartition(parts, "part")


def _mark_sorted(stretch: list[bytes], owner: list[Place], length: int) -> list[list[int]]:
    """For each of the distinct stretches, offsets of windows that also start earlier. owner: each one's first place."""
    text = b"".join(stretch)
    begins = np.cumsum([0] + [len(s) for s in stretch])
    which = np.repeat(np.arange(len(stretch)), np.diff(begins))
    whole = np.arange(len(text)) + length <= begins[1:][which]
    order = np.asarray(suffix_array(text)[1:])
    order = order[whole[order]]
    marks: list[list[int]] = [[] for _ in stretch]
    same, windows = [], order.tolist()
    before = b""
    for i in [*windows, -1]:
        window = text[i : i + length] if i >= 0 else b""
        if window != before:
            if len(same) > 1:
                places = [(*owner[which[j]][:2], owner[which[j]][2] + j - int(begins[which[j]]), j) for j in same]
                earliest = min(places)
                for p in places:
                    if p[:3] != earliest[:3]:
                        marks[which[p[3]]].append(p[3] - int(begins[which[p[3]]]))
            same, before = [], window
        same.append(i)
    return marks


def _mark_group(items: dict[tuple[int, bytes], Place], length: int, out: list[tuple[int, int, int, int]], queue: list[tuple[list[bytes], list[Place]]]) -> None:
    """items: distinct (offset, stretch) of one gram with their first places; what later equal ones cover is in out already."""
    if len(items) < 2:
        return
    size = sum(len(s) for _, s in items)
    if all(len(s) == length for _, s in items):
        return  # single windows that differ in offset or text
    if size <= SORTED_BYTES:
        queue.append(([s for _, s in items], list(items.values())))
        return
    # too much to sort at once: the gram's stretches fall into two of half the windows each, aligned at the gram
    middle = sorted(o - (len(s) - length) / 2 for o, s in items)[len(items) // 2]
    for left in (True, False):
        part: dict[tuple[int, bytes], Place] = {}
        for (o, s), (doc, node, start) in items.items():
            cut = min(max(0, int(np.ceil(o - middle))), len(s) - length + 1)  # windows before this one go left
            a, b = (0, cut) if left else (cut, len(s) - length + 1)
            if a < b:
                _keep(part, (o - a, s[a : b + length - 1]), (doc, node, start + a), out)
        if len(part) == len(items) and sum(len(s) for _, s in part) == size:
            queue.append(([s for _, s in part], list(part.values())))  # nothing left to cut
        else:
            _mark_group(part, length, out, queue)


def _keep(items: dict, key: tuple[int, bytes], place: Place, out: list[tuple[int, int, int, int]]) -> None:
    """Of equal stretches the first stays; another is covered whole."""
    known = items.get(key)
    if known is None:
        items[key] = place
    elif known != place:
        items[key], later = min(known, place), max(known, place)
        out.append((*later, later[2] + len(key[1])))


def mark(dealt: DataFrame, length: int) -> DataFrame:
    """(doc, node, start, end): covered bytes, in pieces that may touch and overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            a = np.asarray(out, np.int64).reshape(-1, 4)
            out.clear()
            a = a[np.lexsort(a.T[2::-1])]
            # neighbours that touch become one
            if len(a):
                new = np.ones(len(a), bool)
                new[1:] = (a[1:, :2] != a[:-1, :2]).any(axis=1) | (a[1:, 2] > a[:-1, 3])
                head = np.flatnonzero(new)
                a = np.column_stack([a[head, :3], np.maximum.reduceat(a[:, 3], head)])
            return _batch(**{c: pa.array(a[:, i]) for i, c in enumerate(("doc", "node", "start", "end"))})

        columns: list[list[bytes]] = [[] for _ in range(8)]
        for batch in batches:
            for i in range(8):
                columns[i] += batch.column(i + 1).to_pylist()
        raw = b"".join(columns.pop())
        kind, gram, doc, node, start, offset, size = (np.frombuffer(b"".join(c), k) for c, k in zip(columns, (np.uint8, np.uint64, np.int64, np.int64, np.uint32, np.uint16, np.uint16), strict=True))
        del columns
        begin = np.cumsum(np.where(kind == 0, size, 0), dtype=np.int64) - size
        if kind.any():
            told = kind == 1
            out.extend(zip(doc[told].tolist(), node[told].tolist(), start[told].tolist(), (start[told].astype(np.int64) + size[told]).tolist(), strict=True))
            yield flush()
        order = np.flatnonzero(kind == 0)
        order = order[np.argsort(gram[order], kind="stable")]
        cuts = np.append(np.flatnonzero(np.diff(gram[order], prepend=~gram[order[:1]])), len(order))
        queue: list[tuple[list[bytes], list[Place]]] = []
        waiting, held = ([], []), 0
        for c in range(len(cuts) - 1):
            own, items = order[cuts[c] : cuts[c + 1]], {}
            for d, x, s, o, n, at in zip(doc[own].tolist(), node[own].tolist(), start[own].tolist(), offset[own].tolist(), size[own].tolist(), begin[own].tolist(), strict=True):
                _keep(items, (o, raw[at : at + n]), (d, x, s), out)
            _mark_group(items, length, out, queue)
            while queue:
                more = queue.pop()
                waiting[0].extend(more[0])
                waiting[1].extend(more[1])
                held += sum(map(len, more[0]))
            if held >= CHUNK_BYTES or held and c == len(cuts) - 2:
                for (d, x, s), offsets in zip(waiting[1], _mark_sorted(*waiting, length), strict=True):
                    out.extend((d, x, s + a, s + b + length) for a, b in _runs(offsets))
                waiting, held = ([], []), 0
                if len(out) > 200_000:
                    yield flush()
        if out:
            yield flush()

    return dealt.mapInArrow(run, "doc long, node long, start long, end long")


def _runs(offsets: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of runs of whole numbers without gaps."""
    offsets = sorted(offsets)
    first = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] != offsets[i - 1] + 1:
            yield offsets[first], offsets[i - 1]
            first = i


def covered_spans(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node, spans array<struct<start, end>>), (doc_id, node, n_bytes, copy)): covered bytes of each first of equal texts, and all rows.

    copy: a row of a smaller id has the same text of at least `length` bytes (by two 64-bit hashes and the length), so all of it is
    covered. Rows of one id are told apart by node, a hash of their text. docs: (doc_id, text), without null ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    rows = scratch.keep(keyed.select("doc_id", "node", F.xxhash64(F.lit(length), "text").alias("check"), F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    total = rows.where(F.col("n_bytes") >= length).agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(shuffle_partitions(spark), int(total // TASK_BYTES) + 1)
    small_batches(spark)
    long_enough = keyed.where(F.octet_length("text") >= length)
    firsts = rows.groupBy("node", "check", "n_bytes").agg(F.min("doc_id").alias("first"))
    grams = repeated_grams(long_enough.select("node", "text"), length, parts)
    wanted = grams.groupBy("node").agg(F.collect_list("numbers").alias("numbers")).join(firsts.select("node", F.col("first").alias("doc_id")).distinct(), "node").select("doc_id", "node", "numbers")
    # a repeated row brings its stretches twice from the same places
    cut = long_enough.select("doc_id", "node", "text").join(wanted, ["doc_id", "node"]).select("doc_id", "node", "text", "numbers")
    spans = scratch.keep(mark(deal_stretches(cut, length, parts), length), "spans")
    by_doc = spans.groupBy(F.col("doc").alias("doc_id"), "node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    all_rows = rows.join(firsts, ["node", "check", "n_bytes"]).select("doc_id", "node", "n_bytes", ((F.col("n_bytes") >= length) & (F.col("first") < F.col("doc_id"))).alias("copy"))
    return by_doc, all_rows


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row: its text without bytes that an earlier equal string covers.

    Strings are `length` bytes (32 to 32,000), judged on the whole input, inside one row each; earlier means a smaller id, or an
    earlier start in the row. Null and empty texts have no bytes. Rows with a null id are kept whole. Rows that repeat an id count as
    one document if their texts are equal; otherwise they are documents of their own, the one whose text has the smaller hash first.
    Ids are integers. Texts of 134 MB or more are an error. Other columns are left behind.
    """
    if not GRAM <= length <= 32_000:
        raise ValueError(f"length {length} lies outside {GRAM} to 32000")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_doc, rows = covered_spans(docs.where(F.col("doc_id").isNotNull()), length)
    copies = rows.where("copy").select("doc_id", "node").distinct().withColumn("copy", F.lit(True))
    facts = by_doc.join(copies, ["doc_id", "node"], "full_outer")
    joined = docs.withColumn("node", F.xxhash64(F.coalesce("text", F.lit("")))).join(facts, ["doc_id", "node"], "left").select("doc_id", "text", "spans", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, copy in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                raw = (text or "").encode()
                if copy and len(raw) >= length:
                    out.append((len(raw), len(raw), 1, b""))
                    continue
                kept, at, removed, n = [], 0, 0, 0
                for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                    if e > at or not n:
                        if s > at or not n:
                            n += 1
                            kept.append(raw[at:s])
                            removed -= s
                        else:
                            removed -= at
                        removed += e
                        at = e
                kept.append(raw[at:])
                out.append((len(raw), removed, n, b"".join(kept)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
