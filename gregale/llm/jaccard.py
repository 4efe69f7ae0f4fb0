"""Exact n-gram Jaccard join: size-aware, heavy and light.

A document is the set of hashes of its word shingles. The sets share one order of all elements: first by the magnitude of the number
of sets that hold them, rare ones first, then by hash; passages that many documents share stand last. Two sets of n <= m elements reach a Jaccard
similarity of 3/4 only if they share t = ceil(3 (n + m) / 7) elements, and then the first n - t + k and m - t + k of them share k:

* Light sets (few elements) enumerate the subsets of size k = 2 of those first elements and meet on equal subsets.
* Heavy sets put the first elements for k = 1 into inverted lists, and so do the light sets that a heavy one can reach; lists are
  scanned for pairs, and how many lists a pair shares bounds what its whole sets can share.

The boundary is the size at which the subsets to enumerate cost more than list entries to scan.

Before that, documents that can't link with any are put aside: of the elements whose hashes lie in a fixed part of the range, all but
a quarter of the set's size must be in some other set, as a link leaves out no more. Only these elements of all documents are
shuffled; few documents but near copies remain.

Links are not expanded within groups. Equal sets are one node from the start. Then every list ties its members to one of them, its
head, and each node is compared with the few heads that it shares most lists with. What that doesn't connect, and only that, is compared
pair by pair: lists that hold several components yield the pairs between these, and the pairs that share enough lists are compared.
So a group of m near copies costs about m comparisons, and no link is lost. Every comparison is exact on the whole sets.

Hot elements: what a batch says of one element is aggregated before it is dealt, so that an element of a third of all sets costs an
entry per batch, not per set; lists that stay open and are longer than BLOCK are met block by block in several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.llm.common import Scratch, even_keys, read, shuffle_partitions, small_batches

WORDS = 5
#: Cost of scanning one entry of an inverted list, in enumerated subsets.
SCAN_COST = 4.0
#: Entries (hash, node and what belongs to them) that one task is to hold.
TASK_ENTRIES = 1_000_000
#: Members of a list that meet in one task, of its largest component and of the others each; longer lists are met in blocks.
BLOCK = 4096
#: List heads that a node is compared with before open lists are met pair by pair.
HEADS = 4
#: Part of the hash range whose elements are counted over all documents.
SAMPLED = 0.4
SAMPLE_END = np.uint64(int(SAMPLED * 2**64))
#: Stands for two or more nodes of one batch.
SEVERAL = np.int64(-1)
#: A set of this size or more costs more subsets than list entries, whatever the other sizes are: (n/4+2)(n/4+1)/2 > SCAN_COST (n/4+1).
LARGE = 64
#: Bits of the map of documents that may link, as a power of two.
MAP_BITS = 28
#: In the sum of a pair's meetings: one on a subset of two.
ON_SUBSET = 1 << 24
ODD = np.random.default_rng(5).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence, if it is shorter; none without words.

    Words are longest runs of bytes other than ASCII white space, with A-Z in lower case.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(own) < WORDS:
        return mix((own * ODD[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    last = len(own) - WORDS + 1
    total = own[:last] * ODD[0]
    for k in range(1, WORDS):
        total += own[k : k + last] * ODD[k]
    return np.unique(mix(total))


def index_length(n, k: int = 1):
    """First elements in which a set meets every set of its size or larger that it can link with, at least k times."""
    return np.minimum(n, n - (6 * n + 6) // 7 + k)


def probe_length(n, k: int = 1):
    """The same for smaller sets."""
    return np.minimum(n, n - (3 * n + 3) // 4 + k)


def least_shared(n, m):
    return (3 * (n + m) + 6) // 7


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which sets are light: where subsets, summed over the sets up to it, still cost less than their list entries."""
    best, spare, light = 0.0, 0.0, 0
    for n in sorted(sizes):
        first = int(probe_length(n, 2))
        spare += sizes[n] * (SCAN_COST * int(probe_length(n)) - first * (first - 1) / 2)
        if spare > best:
            best, light = spare, n
    return light


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _node(own: np.ndarray) -> int:
    node = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True)
    return node if node != SEVERAL else 0


def _key(id_col: str = "doc_id", text_col: str = "text"):
    """A hash of the row's id, or of its text where it has none."""
    return F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(text_col))


def shingle_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, node, sampled, spare): node is a 64-bit hash of the set, null for none; sampled, its elements in the sampled part of the range; spare, how many of them must be in another set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            sampled = [int(np.searchsorted(s, SAMPLE_END)) for s in sets]
            yield _batch(doc_id=batch.column(0), key=batch.column(1), n=pa.array([len(s) for s in sets], pa.int64()), node=pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), sampled=pa.array(sampled, pa.int64()), spare=pa.array([k - len(s) // 4 for k, s in zip(sampled, sets, strict=True)], pa.int64()))

    return docs.select("doc_id", _key().alias("key"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, node long, sampled long, spare long")


def _fresh(nodes: list[int], seen: set[int]) -> list[int]:
    """Places of nodes that this task hasn't met. So a third of all rows being copies costs as many entries as tasks."""
    out = []
    for i, x in enumerate(nodes):
        if x is not None and x not in seen:
            seen.add(x)
            out.append(i)
    if len(seen) > 500_000:
        seen.clear()
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in columns sorted together."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _sorted(*columns: np.ndarray) -> list[np.ndarray]:
    """The columns in the order of the first, then the second, and so on."""
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def _summed(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of all columns but the last, with the sum of the last."""
    *by, value = _sorted(*columns)
    at = _runs(*by)
    return [c[at] for c in by] + [np.add.reduceat(value, at, dtype=value.dtype) if len(at) else value]


def _home(node: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The part that each node belongs to."""
    return keys[((mix(node.view(np.uint64)) >> np.uint64(32)) * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int64)]


def _packed(part: np.ndarray, name: str = "part", **columns: np.ndarray) -> pa.RecordBatch:
    """One row per part, with each column's values of that part as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = _runs(part)
    ends = np.append(at[1:], len(part))[: len(at)]
    return _batch(**{name: pa.array(part[at], pa.int64())}, **{k: pa.array([v[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary()) for k, v in ((k, v[order]) for k, v in columns.items())})


def _unpacked(batches: Iterator[pa.RecordBatch], *kinds) -> list[np.ndarray]:
    columns: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for i in range(len(kinds)):
            columns[i] += batch.column(i + 1).to_pylist()
    return [np.frombuffer(b"".join(c), k) for c, k in zip(columns, kinds, strict=True)]


def _exchanged(table: DataFrame, parts: int, deal, *names: str) -> DataFrame:
    """What deal yields for the batches of table, packed rows of part and names, each part in one partition."""
    return table.mapInArrow(deal, ", ".join(["part long", *[f"{n} binary" for n in names]])).repartition(parts, "part")


def shared_counts(docs: DataFrame, parts: int) -> DataFrame:
    """(node, shared): for how many of a set's sampled elements another set has them, too; more where copies of a set lie in several tasks.

    Elements that several sets of a batch share are counted there, and stand for these sets in one entry of the batch.
    """
    keys = np.array(even_keys(docs.sparkSession, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            nodes = [_node(s) if len(s) else None for s in sets]
            fresh = _fresh(nodes, seen)
            if not fresh:
                continue
            own = [sets[i][: int(np.searchsorted(sets[i], SAMPLE_END))] for i in fresh]
            key, node = _sorted(np.concatenate(own), np.repeat(np.array([nodes[i] for i in fresh], np.int64), [len(s) for s in own]))
            at = _runs(key)
            times = np.diff(np.append(at, len(key)))
            here, n = np.unique(node[np.repeat(times > 1, times)], return_counts=True)
            sent = np.where(times > 1, SEVERAL, node[at])
            node, key = _sorted(sent, key[at])  # equal nodes side by side compress
            # kind 1: entries of elements; kind 0: counts of nodes, passed on
            kind = np.repeat(np.array([1, 0], np.uint8), [len(key), len(here)])
            part = np.concatenate([_home(key, keys), _home(here, keys)])
            yield _packed(part, kind=kind, key=np.concatenate([key, n.astype(np.uint64)]), node=np.concatenate([node, here]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, node = _unpacked(batches, np.uint8, np.uint64, np.int64)
        counted, counts = node[kind == 0], key[kind == 0].astype(np.int64)
        key, node = _sorted(key[kind == 1], node[kind == 1])
        at = _runs(key, node)
        key, node = key[at], node[at]
        at = _runs(key)
        times = np.diff(np.append(at, len(key)))
        shared = np.repeat((times > 1) | (node[at] == SEVERAL), times) & (node != SEVERAL)
        node, n = _summed(np.concatenate([counted, node[shared]]), np.concatenate([counts, np.ones(int(shared.sum()), np.int64)]))
        if len(node):
            yield _packed(_home(node, keys), node=node, n=n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n = _summed(*_unpacked(batches, np.int64, np.int64))
        yield _batch(node=pa.array(node, pa.int64()), shared=pa.array(n, pa.int64()))

    return _exchanged(_exchanged(docs.select("text"), parts, deal, "kind", "key", "node"), parts, count, "node", "n").mapInArrow(total, "node long, shared long")


def consult(table: DataFrame, parts: int, ask: Callable, asked: dict[str, type], answer: Callable, told: dict[str, type], use: Callable, out: str) -> DataFrame:
    """Rows of table (home, …), each batch told what all rows say of its keys.

    ask(batch) gives (home, key, *asked) of a batch, aggregated there; answer(home, key, *asked), with all that is said of the keys
    of one part, gives (home, key, *told); use(rows, told of rows' home: sorted keys and what belongs to them) yields batches of out.
    A task holds the answers for one home at a time, and what is asked of one part.
    """
    keys = np.array(even_keys(table.sparkSession, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, key, *values = ask(batch)
            if len(key):
                yield _packed(_home(key, keys), home=home, key=key, **dict(zip(asked, values, strict=True)))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, key, *values = answer(*_unpacked(batches, np.int64, np.uint64, *asked.values()))
        if len(key):
            yield _packed(home, "home", key=key, **dict(zip(told, values, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, said, known = None, [], None
        kinds = [np.uint64, *told.values()]
        for batch in batches:
            home, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = _runs(home, row)
            for s, e in zip(starts, np.append(starts[1:], len(home))[: len(starts)], strict=True):
                if home[s] != at:
                    at, said, known = home[s], [], None
                piece = batch.slice(s, e - s)
                if not row[s]:
                    said.append([piece.column(2 + i).to_pylist() for i in range(len(kinds))])
                    continue
                if known is None:
                    columns = [np.frombuffer(b"".join(x for p in said for x in p[i]), k) for i, k in enumerate(kinds)]
                    order = np.argsort(columns[0], kind="stable")
                    said, known = [], [c[order] for c in columns]
                yield from use(pa.RecordBatch.from_arrays([piece.column("home"), *piece.columns[2 + len(kinds) :]], names=names), known)

    names = ["home", *[c for c in table.columns if c != "home"]]
    answers = _exchanged(table, parts, deal, "home", "key", *asked).mapInArrow(reply, ", ".join(["home long", "key binary", *[f"{n} binary" for n in told]]))
    answers = answers.select("home", F.lit(False).alias("row"), F.col("key").alias("__key"), *[F.col(n).alias(f"__{n}") for n in told])
    rows = table.withColumn("row", F.lit(True))
    both = answers.unionByName(rows, allowMissingColumns=True).select("home", "row", "__key", *[f"__{n}" for n in told], *names[1:])
    return both.repartition(parts, "home").sortWithinPartitions("home", "row").mapInArrow(run, out)


def _at(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that are known, and where they stand among these."""
    at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
    hit = np.flatnonzero(known[at] == key) if len(known) else np.zeros(0, np.int64)
    return hit, at[hit]


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def ordered(sets: DataFrame, parts: int) -> DataFrame:
    """(home, node, n, own, prefix) of sets (home, node, n, set): prefix, the first elements of each in the common order; own, the part of elements that few other sets hold."""

    def ask(batch: pa.RecordBatch):
        own = _arrays(batch.column("set"))
        home = np.repeat(batch.column("home").to_numpy(zero_copy_only=False), [len(s) for s in own])
        key = np.concatenate(own) if own else np.zeros(0, np.uint64)
        home, key, n = _summed(home, key, np.ones(len(key), np.uint32))
        return home, key, n

    def answer(home, key, n):
        key, home, n = _sorted(key, home, n)
        at = _runs(key)
        times = np.add.reduceat(n.astype(np.int64), at) if len(at) else n
        each = np.diff(np.append(at, len(key)))
        level = np.repeat(np.floor(np.log2(np.maximum(times, 1))).astype(np.uint8), each)
        common = level >= 2  # elements of one to three sets are of one magnitude, which needn't be told
        home, key, level = home[common], key[common], level[common]
        at = _runs(key, home)  # once per home, which several batches may have asked for
        return home[at], key[at], level[at]

    def use(rows: pa.RecordBatch, known) -> Iterator[pa.RecordBatch]:
        prefixes, part = [], []
        for own in _arrays(rows.column("set")):
            level = np.zeros(len(own), np.uint8)
            hit, at = _at(known[0], own)
            level[hit] = known[1][at]
            part.append(np.count_nonzero(level == 0) / len(level))
            prefixes.append(own[np.argsort(level, kind="stable")][: int(probe_length(len(own), 2))].tobytes())
        yield _batch(home=rows.column("home"), node=rows.column("node"), n=rows.column("n"), own=pa.array(part, pa.float64()), prefix=pa.array(prefixes, pa.binary()))

    return consult(sets, parts, ask, {"times": np.uint32}, answer, {"level": np.uint8}, use, "home long, node long, n long, own double, prefix binary")


def _keys(prefixes: list[np.ndarray], n: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): list keys of all rows, even ones of single elements, odd ones of subsets."""
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    singly = n * 4 >= light * 3  # what a heavy set can reach
    for i, prefix in enumerate(prefixes):
        size = int(n[i])
        if singly[i]:
            keys.append(prefix[: int(probe_length(size))] & ~np.uint64(1))
        if size <= light and len(prefix) > 1:
            a, b = np.triu_indices(len(prefix), 1)
            own = mix(prefix[a] * ODD[0] + prefix[b]) | np.uint64(1)
            if singly[i]:
                keys[-1] = np.concatenate([keys[-1], own])
            else:
                keys.append(own)
        elif not singly[i]:
            continue
        rows.append(np.full(len(keys[-1]), i, np.int64))
    return np.concatenate(keys), np.concatenate(rows)


def _near(n, m):
    """Whether sets of so many elements can link."""
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


def head_pairs(rows: DataFrame, light: int, parts: int) -> DataFrame:
    """(a, b) of rows (home, node, n, own, prefix): each node with the HEADS list heads b that it shares most lists with.

    The head of a list is its node with the smallest part of elements of its own, as what a group was copied from has fewer than its
    copies. Members of a list that lie in one batch are tied to the head of these there, which alone goes on to meet the others.
    """
    keys = np.array(even_keys(rows.sparkSession, parts))

    def heads(key, own, node, n):
        """Places of the heads, and (node, head) of the others, in columns sorted by key, own, node."""
        at = _runs(key)
        head = np.repeat(at, np.diff(np.append(at, len(key))))
        tied = (node != node[head]) & _near(n, n[head])
        return at, node[tied], node[head[tied]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "own"))
            key, row = _keys(_arrays(batch.column("prefix")), n, light)
            key, own, node, n = _sorted(key, own.astype(np.float32)[row], node[row], n.astype(np.uint32)[row])
            at, a, b = heads(key, own, node, n.astype(np.int64))
            a, b, lists = _summed(a, b, np.ones(len(a), np.int64))
            none = lambda like, dtype: np.zeros(len(like), dtype)
            # kind 1: list entries; kind 0: ties with their numbers of lists, passed on
            yield _packed(
                np.concatenate([_home(key[at], keys), _home(a, keys)]), kind=np.repeat(np.array([1, 0], np.uint8), [len(at), len(a)]), key=np.concatenate([key[at], lists.astype(np.uint64)]), node=np.concatenate([node[at], a]),
                head=np.concatenate([none(at, np.int64), b]), n=np.concatenate([n[at], none(a, np.uint32)]), own=np.concatenate([own[at], none(a, np.float32)]),
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, node, head, n, own = _unpacked(batches, np.uint8, np.uint64, np.int64, np.int64, np.uint32, np.float32)
        ties, met = kind == 0, kind == 1
        k, o, x, m = _sorted(key[met], own[met], node[met], n[met])
        _, a, b = heads(k, o, x, m.astype(np.int64))
        a, b, lists = _summed(np.concatenate([node[ties], a]), np.concatenate([head[ties], b]), np.concatenate([key[ties].astype(np.int64), np.ones(len(a), np.int64)]))
        if len(a):
            yield _packed(_home(a, keys), a=a, b=b, lists=lists)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, lists = _summed(*_unpacked(batches, np.int64, np.int64, np.int64))
        a, _, b = _sorted(a, -lists, b)
        at = _runs(a)
        at = np.flatnonzero(np.arange(len(a)) - np.repeat(at, np.diff(np.append(at, len(a)))) < HEADS)
        yield _batch(a=pa.array(a[at], pa.int64()), b=pa.array(b[at], pa.int64()))

    met = _exchanged(rows.select("node", "n", "own", "prefix"), parts, deal, "kind", "key", "node", "head", "n", "own")
    return _exchanged(met, parts, meet, "a", "b", "lists").mapInArrow(best, "a long, b long")


def open_pairs(rows: DataFrame, light: int, parts: int) -> DataFrame:
    """(a, b) of rows (home, node, n, comp, prefix): the pairs of different components that share lists enough to link, each once.

    Lists of one component are left out: batches ask which lists hold others. In an open list the members outside its largest
    component meet all its members. Of more than BLOCK members, the largest component's are dealt to several columns of cells, the
    others to rows and columns, so that a task holds two blocks of a list and each pair still meets once.
    """
    keys = np.array(even_keys(rows.sparkSession, parts))
    ROW, COLUMN, LARGEST = np.uint8(1), np.uint8(2), np.uint8(4)

    def entries(batch: pa.RecordBatch):
        node, n, comp, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "comp", "home"))
        key, row = _keys(_arrays(batch.column("prefix")), n, light)
        return key, node[row], n.astype(np.uint32)[row], comp[row], home[row]

    def ask(batch: pa.RecordBatch):
        key, _, _, comp, home = entries(batch)
        home, key, comp, n = _summed(home, key, comp, np.ones(len(key), np.int64))
        return home, key, comp, n

    def answer(home, key, comp, n):
        k, c, m = _summed(key, comp, n)
        at = _runs(k)
        each = np.diff(np.append(at, len(k)))
        is_open = np.repeat(each > 1, each)
        k, c, m = k[is_open], c[is_open], m[is_open]
        k, m, c = _sorted(k, -m, c)  # the largest component first
        at = _runs(k)
        total = np.add.reduceat(-m, at) if len(at) else m
        largest, others = c[at], total + m[at]
        cells = [np.maximum(1, -(-x // BLOCK)).astype(np.uint32) for x in (-m[at], others)]
        home, key = _sorted(home, key)
        first = _runs(home, key)
        home, key = home[first], key[first]
        hit, where = _at(k[at], key)
        return home[hit], key[hit], largest[where], cells[0][where], cells[1][where]

    def use(batch: pa.RecordBatch, known) -> Iterator[pa.RecordBatch]:
        key, node, n, comp, _ = entries(batch)
        hit, at = _at(known[0], key)
        key, node, n, comp = key[hit], node[hit], n[hit], comp[hit]
        largest, columns, lines = comp == known[1][at], known[2][at].astype(np.int64), known[3][at].astype(np.int64)
        role = np.full(len(key), ROW | COLUMN, np.uint8) | np.where(largest, LARGEST, np.uint8(0))
        whole = (columns == 1) & (lines == 1)
        dealt = [(key[whole], node[whole], n[whole], comp[whole], role[whole])]
        mixed = mix(node.view(np.uint64)) >> np.uint64(20)
        for i in np.flatnonzero(~whole):  # entries of hot lists
            if largest[i]:
                put = [(line, int(mixed[i] % np.uint64(columns[i])), COLUMN | LARGEST) for line in range(lines[i])]
            else:
                q = int(mixed[i] % np.uint64(lines[i]))
                put = [(q, c, ROW) for c in range(columns[i])] + [(q, columns[i] + o, ROW) for o in range(q + 1, lines[i])] + [(o, columns[i] + q, COLUMN) for o in range(q)] + [(q, columns[i] + q, ROW | COLUMN)]
            cells = np.array([line << 32 | column + 1 for line, column, _ in put], np.uint64)
            cells = mix(key[i : i + 1] ^ mix(cells)) & ~np.uint64(1) | key[i] & np.uint64(1)
            dealt.append((cells, np.full(len(put), node[i]), np.full(len(put), n[i], np.uint32), np.full(len(put), comp[i]), np.array([r for *_, r in put], np.uint8)))
        key, node, n, comp, role = (np.concatenate(c) for c in zip(*dealt, strict=True))
        if len(key):
            yield _packed(_home(key, keys), key=key, node=node, n=n, comp=comp, role=role)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, n, comp, role = _unpacked(batches, np.uint64, np.int64, np.uint32, np.int64, np.uint8)
        key, node, n, comp, role = _sorted(key, node, n, comp, role)
        at = _runs(key, node)  # a repeated id may give a node twice
        key, node, n, comp, role = key[at], node[at], n[at].astype(np.int64), comp[at], role[at]
        at = _runs(key)
        size = np.diff(np.append(at, len(key)))
        start, size = np.repeat(at, size), np.repeat(size, size)
        line = np.flatnonzero(((role & ROW) > 0) & ((role & LARGEST) == 0))
        told = np.cumsum(size[line])
        for s in np.unique(np.searchsorted(told, np.arange(0, told[-1] if len(told) else 0, TASK_ENTRIES))):  # so many pairs at a time
            e = np.searchsorted(told, (told[s] // TASK_ENTRIES + 1) * TASK_ENTRIES)
            some = line[s : max(e, s + 1)]
            a = np.repeat(some, size[some])
            b = np.arange(len(a)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + start[a]
            twice = ((role[b] & (ROW | LARGEST)) == ROW) & ((role[a] & COLUMN) > 0) & (b <= a)  # b meets a, too
            ok = ((role[b] & COLUMN) > 0) & (comp[a] != comp[b]) & _near(n[a], n[b]) & ~twice
            a, b = a[ok], b[ok]
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            x, y, k, l, lists = _summed(node[a], node[b], n[a], n[b], np.where(key[a] & np.uint64(1), ON_SUBSET, 1))
            if len(x):
                yield _packed(_home(x ^ (y << 1), keys), a=x, b=y, n=k, m=l, lists=lists)

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """If a's prefix ends first in the common order, all that a and b share up to there is in both, and beyond it at most the rest of a; and the other way round."""
        a, b, n, m, lists = _summed(*_unpacked(batches, np.int64, np.int64, np.int64, np.int64, np.int64))
        alone = lists % ON_SUBSET
        rest = np.maximum(n - probe_length(n), m - probe_length(m))
        ok = np.where(4 * np.minimum(n, m) >= 3 * light, alone >= np.maximum(1, least_shared(n, m) - rest), lists >= ON_SUBSET)
        yield _batch(a=pa.array(a[ok], pa.int64()), b=pa.array(b[ok], pa.int64()))

    asked, told = {"comp": np.int64, "n": np.int64}, {"largest": np.int64, "columns": np.uint32, "lines": np.uint32}
    names = ("key", "node", "n", "comp", "role")
    dealt = consult(rows, parts, ask, asked, answer, told, use, ", ".join(["part long", *[f"{c} binary" for c in names]])).repartition(parts, "part")
    return _exchanged(dealt, parts, meet, "a", "b", "n", "m", "lists").mapInArrow(enough, "a long, b long")


def _bitmap(keys: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, words): a bit for each of n keys, by its upper bits; sixteen times as many bits as keys, and 2^MAP_BITS (32 MB) at most."""
    bits = min(MAP_BITS, max(12, (16 * n).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    found = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, words


def _sets(docs: DataFrame, wanted: DataFrame, n: int, parts: int) -> DataFrame:
    """(home, node, n, set): whole sets of the n wanted (key), from their texts, by home.

    A row's key is looked up in a bitmap of fixed size; what it lets through beside, the more the more are wanted, is work that
    changes nothing, as is a node that several rows bring. So no text is shuffled.
    """
    keys = np.array(even_keys(docs.sparkSession, parts))
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("key"), n))  # 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words = shipped.value
        seen: set[int] = set()
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            picked = np.flatnonzero(words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
            sets = [s for t in batch.column(1).take(pa.array(picked)).to_pylist() if len(s := shingles(t))]
            nodes = [_node(s) for s in sets]
            fresh = _fresh(nodes, seen)
            node, sets = np.array([nodes[i] for i in fresh], np.int64), [sets[i] for i in fresh]
            yield _batch(home=pa.array(_home(node, keys), pa.int64()), node=pa.array(node), n=pa.array([len(s) for s in sets], pa.int64()), set=pa.array([s.tobytes() for s in sets], pa.binary()))

    return docs.select(_key().alias("key"), "text").mapInArrow(run, "home long, node long, n long, set binary").repartition(parts, "home")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. b may be in many pairs; its set goes once to the partition of b, which is split where it is large (AQE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield _batch(a=batch.column(0).filter(keep), b=batch.column(1).filter(keep))

    one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp): for each node of the links (a, b) the smallest node that it is connected with.

    Tasks of TASK_ENTRIES links each make forests of them; what one task holds is done then. Forests of several tasks are joined
    by steps: alternates the two star steps (each node's larger neighbours, then its smaller ones, are tied to its smallest) until nothing
    changes; every step is stored. Hot nodes are reduced by a partial minimum, and the tie joins are left to skew handling.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), f"{name}-0")
    parts = edges.count() // TASK_ENTRIES + 1
    edges = scratch.keep(edges.repartition(parts).mapInArrow(_forest, "u long, v long"), f"{name}-forest")
    if parts == 1:
        return _labels(edges)
    state = lambda ties: ties.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    step, before = 0, state(edges)
    while True:
        step += 1
        # large star: over both directions, ties of a node's larger neighbours to its smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: ties of a node and its smaller neighbours to its smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        ties = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = scratch.keep(ties, f"{name}-{step}")
        now = state(after)
        if now == before:
            break
        edges, before = after, now
    return _labels(after)


def _labels(ties: DataFrame) -> DataFrame:
    """Every node but the roots is tied to its root, once."""
    return ties.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(ties.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (u, v) of each node of the links to the smallest node that they connect it with, themselves left out."""
    columns = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for i in (0, 1):
            columns[i].append(batch.column(i).to_numpy(zero_copy_only=False))
    u, v = (np.concatenate(c) for c in columns)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    yield _batch(u=pa.array(nodes[tied], pa.int64()), v=pa.array(nodes[root[tied]], pa.int64()))


def merged(comp: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """comp (node, comp) after further links (a, b) between its nodes.

    Only links between different components are followed, as links between their smallest nodes; a round that ties none costs one
    count. Every node keeps a row.
    """
    ends = [comp.select(F.col("node").alias(x), F.col("comp").alias(y)) for x, y in (("a", "u"), ("b", "v"))]
    open_links = scratch.keep(links.select("a", "b").join(ends[0], "a").join(ends[1], "b").where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), f"{name}-open")
    if open_links.isEmpty():
        return comp
    root = components(open_links, scratch, name).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return scratch.keep(comp.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"{name}-all")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    n_shingles: size of the row's set; 0 for null, empty and blank texts, which link with nothing, so that component_id is their own
    id. component_id: the smallest doc_id reachable over links, the row's own included; rows of equal sets are linked. Null ids
    take part but aren't anyone's component unless all ids of it are null. Repeated rows are rows each. Other columns are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = scratch.keep(shingle_table(docs), "rows")
    nodes = table.where("n > 0")
    # of a node's rows, the one with the smallest id; of those without an id any
    members = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("n").alias("n"), F.max("spare").alias("spare"))
    members = members.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("key")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    counts = shared_counts(docs, _parts(spark, total * SAMPLED))
    wanted = scratch.keep(members.join(counts, "node", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("spare")).select("key", "n"), "wanted")
    many, size = wanted.agg(F.count("key"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = scratch.keep(_sets(docs, wanted, many, _parts(spark, size)), "sets")
    rows = scratch.keep(ordered(sets, _parts(spark, size)), "ordered")
    sizes = {r.n: r["count"] for r in rows.where(F.col("n") < LARGE).groupBy("n").count().collect()}
    light = boundary(sizes)
    single, first = F.col("n") - F.ceil(F.col("n") * 0.75) + 1, F.least("n", F.col("n") - F.ceil(F.col("n") * 0.75) + 2)
    parts = _parts(spark, rows.agg(F.sum(single + F.when(F.col("n") <= light, first * (first - 1) / 2).otherwise(0))).first()[0] or 0)
    comp = scratch.keep(rows.select("node", F.col("node").alias("comp")).distinct(), "components")
    found = scratch.keep(_linked(head_pairs(rows, light, parts), sets), "links-heads")
    comp = merged(comp, found, scratch, "heads")
    found = scratch.keep(_linked(open_pairs(rows.join(comp, "node").select("home", "node", "n", "comp", "prefix"), light, parts), sets), "links-open")
    comp = merged(comp, found, scratch, "open")
    labelled = members.join(comp, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = scratch.keep(labelled.join(smallest, "comp").select("node", "component_id"), "labels")
    scratch.keep_only("rows", "labels")
    return table.select("doc_id", F.col("n").alias("n_shingles"), "node").join(label, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _parts(spark: SparkSession, entries: float) -> int:
    return max(shuffle_partitions(spark), int(entries // TASK_ENTRIES) + 1)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


SQL4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, w[i : i + 4] AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, w FROM w WHERE len(w) BETWEEN 1 AND 4)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= 75 * (x.n + y.n - i.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
