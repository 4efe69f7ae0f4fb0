"""Conversation structure repair: the cheapest edits that give a conversation the role grammar (s?(ua)+)?, by layers of cost.

The grammar has four states: nothing yet (0), after system (1), after user (2), after assistant (3); 0 and 3 accept. For each cost, one
layer more than the last, and each turn, a bitset holds the states from which the turns from there on can be brought to an accepting
state at exactly that cost. Layers grow from the last turn to the first, by cost 0, 1, 2, ...: a kept turn leads to the same layer, edits
to the layers 3, 4 and 6 below. The first layer that holds state 0 at the first turn gives the cost. The bits are then traced from the
first turn on, taking the least initial whose end is in the layer that its cost leaves; this is the ASCII-least of all cheapest audits.

Turns are dealt by ranges of (conversation, turn), so that a conversation with a third of all turns lies in many tasks, each of which
reads its turns in order. A conversation of up to STRETCH turns that begins and ends inside one task is done there. Of others, each
stretch of so many turns gets the cost and the least audit from every state to every state, by the same layers; these are combined in
order, ties by audit, and the audit's pieces meet their stretches' texts again in one sorted stream, as a hash of the whole repaired text
needs it in order. Least audits of a stretch are no prefixes of each other, since each ends with an edit of its last turn; so their
order decides the whole's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from gregale.llm.common import Scratch, read, shuffle_partitions, small_batches

#: Turns of a stretch, at most; their texts come to STRETCH_CHARS at most unless one turn is longer.
STRETCH, STRETCH_CHARS = 64, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ACCEPTING = 0b1001
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: By role initial and bitset: the states from which the role leads into the bitset.
BEFORE = {r: [sum(1 << q for q, to in NEXT.get(r, {}).items() if bits >> to & 1) for bits in range(16)] for r in ("s", "u", "a", "x")}
#: The states from which a user's or an assistant's turn leads into the bitset.
BEFORE_ANY = [u | a for u, a in zip(BEFORE["u"], BEFORE["a"], strict=True)]
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = "\x20\x09-\x0d"


def wanted(state: int) -> str:
    """The one role of user and assistant that the grammar takes in a state."""
    return "a" if state == 2 else "u"


def layers(codes: str, goal: int, trailing: bool, until: int) -> list[list[int]]:
    """[cost][turn]: bitsets of the states from which the turns from there on reach the goal, a bitset too, at exactly that cost.

    codes: a turn's role initial (s, u, a, or x for others), in upper case if it is truncated, or d where it must be deleted.
    trailing: turns may be inserted after the last. Ends with the layers in which all states of `until` have come at the first turn.
    """
    n = len(codes)
    none = [0] * (n + 1)
    out: list[list[int]] = []
    seen = 0
    while until & ~seen:
        c = len(out)
        now = [0] * (n + 1)
        three, four, six = (out[c - k] if c >= k else none for k in (INSERT, DELETE, REROLE + TRUNCATED))
        now[n] = (goal if c == 0 else 0) | (BEFORE_ANY[three[n]] if trailing else 0)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            bits = four[i + 1] | BEFORE_ANY[three[i]]
            if code != "d":
                if code < "a":  # truncated
                    bits |= BEFORE[code.lower()][three[i + 1]] | BEFORE_ANY[six[i + 1]]
                else:
                    bits |= BEFORE[code][now[i + 1]] | BEFORE_ANY[three[i + 1]]
            now[i] = bits
        out.append(now)
        seen |= now[0]
    return out


def traced(codes: str, found: list[list[int]], cost: int, state: int, trailing: bool) -> tuple[str, int]:
    """(the least audit of that cost from the state, the state that it ends in)."""
    n, i, out = len(codes), 0, []
    while i < n or cost:
        role = wanted(state)
        to = NEXT[role][state]
        code = codes[i] if i < n else "d"
        slow = TRUNCATED * (code < "a")
        own = NEXT.get(code.lower(), {}).get(state)
        if i < n and cost >= DELETE and found[cost - DELETE][i + 1] >> state & 1:
            out.append("D")
            cost, i = cost - DELETE, i + 1
        elif (i < n or trailing) and cost >= INSERT and found[cost - INSERT][i] >> to & 1:
            out.append("I")
            cost, state = cost - INSERT, to
        elif own is not None and cost >= slow and found[cost - slow][i + 1] >> own & 1:
            out.append("K")
            cost, state, i = cost - slow, own, i + 1
        else:
            out.append("R")
            cost, state, i = cost - REROLE - slow, to, i + 1
    return "".join(out), state


def repaired(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    found = layers(codes, ACCEPTING, True, 1)
    return len(found) - 1, traced(codes, found, len(found) - 1, 0, True)[0]


def ways(codes: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a stretch, for every state and each that it can lead to; what is inserted after its last turn is the next one's."""
    out = []
    for to in range(4):
        starts = {0: 0b0001, 1: 0b0011 if "s" in codes.lower() else 0b0010}.get(to, 0b1111)  # nothing leads back to 0 and 1
        found = layers(codes, 1 << to, False, starts)
        for start in range(4):
            if starts >> start & 1:
                cost = next(c for c, layer in enumerate(found) if layer[0] >> start & 1)
                out.append((start, to, cost, traced(codes, found, cost, start, False)[0]))
    return out


class Chain:
    """The cheapest way through stretches in order, for each state that it can have come to."""

    def __init__(self):
        self.best = {0: (0, 0)}  # by state: cost, and its audit's place among those of the others
        self.steps: list[dict[int, tuple[int, str]]] = []

    def add(self, own: list[tuple[int, int, int, str]]) -> None:
        found: dict[int, tuple] = {}
        for start, to, cost, audit in own:
            if start in self.best:
                way = (self.best[start][0] + cost, self.best[start][1], audit, start)
                found[to] = min(found.get(to, way), way)
        ranks = {to: i for i, to in enumerate(sorted(found, key=lambda to: found[to][1:3]))}
        self.best = {to: (way[0], ranks[to]) for to, way in found.items()}
        self.steps.append({to: (way[3], way[2]) for to, way in found.items()})

    def end(self) -> tuple[int, list[tuple[int, str]], str]:
        """(cost, (state before it, audit) of each stretch, what is inserted at the end)."""
        tails = {0: "", 1: "II", 2: "I", 3: ""}
        cost, _, state = min((cost + INSERT * len(tails[q]), rank, q) for q, (cost, rank) in self.best.items())
        tail, pieces = tails[state], []
        for step in reversed(self.steps):
            state, audit = step[state]
            pieces.append((state, audit))
        return cost, pieces[::-1], tail


def edited(audit: str, state: int, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) of turns (role, text)."""
    i, out = 0, []
    for edit in audit:
        role = wanted(state)
        if edit == "K":
            out.append(turns[i])
            state = NEXT[turns[i][0][0]][state]
        elif edit != "D":
            out.append(("user" if role == "u" else "assistant", turns[i][1] if edit == "R" else ""))
            state = NEXT[role][state]
        i += edit != "I"
    return out


class Stretch:
    """Turns of one conversation in order, those that damage dropped left out, and what the report counts in them."""

    NUMBERS = ("n", "blank", "duplicate", "truncated", "illegal", "distinct", "least", "most")
    STRINGS = ("first", "final", "codes")

    def __init__(self):
        self.turns: list[tuple[str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.chars = 0
        self.least = self.most = self.first = self.final = None
        self.codes: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.turns:
            self.illegal += (self.final, initial) not in LEGAL
        else:
            self.first = initial
        self.final = initial
        if turn is not None:  # turns come in order
            self.distinct += self.most != turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        code = initial if initial in ("s", "u", "a") else "x"
        self.codes.append("d" if fault in ("b", "d") else code.upper() if fault == "t" else code)
        self.turns.append((role, text))
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.turns) >= STRETCH or self.chars >= STRETCH_CHARS

    def fields(self) -> dict:
        return {c: getattr(self, c) for c in (*self.NUMBERS[1:], *self.STRINGS[:2])} | {"n": len(self.turns), "codes": "".join(self.codes), "turns": _turns(self.turns)}


def damaged(conversations: DataFrame, text_nulls: str = " ") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows as the crc32 of `conv_id:turn` damages them, nulls as one space; dropped ones are marked.

    Of each twenty rows, 0: is dropped, 1: loses its text, 2: loses `.`, `!` and `?`, 3: comes twice, 4: becomes a user's.
    """
    space = F.lit(text_nulls)
    own = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    way = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.withColumn("way", way).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


#: The order of a conversation's turns: by turn, those without one first, and ties by role and text (as far as heads and a hash tell them apart).
_ORDER = ("turn", "role_head", "text_head", "tie", "row")
#: What the report says of a conversation besides its audit.
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECE = pa.schema([("conv_id", pa.int64()), ("whole", pa.bool_()), ("task", pa.int64()), ("place", pa.int64()), ("last", pa.bool_()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired", _TURNS)])
_STRETCH = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("place", pa.int64()), *[(c, pa.int64()) for c in Stretch.NUMBERS], *[(c, pa.string()) for c in Stretch.STRINGS], ("turns", _TURNS)])
_BOTH = pa.schema([("piece", pa.struct(list(_PIECE))), ("stretch", pa.struct(list(_STRETCH)))])


def _spark(schema: pa.Schema) -> StructType:
    return from_arrow_schema(schema)


def _turns(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def with_faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone, row) with what orders them, and the first fault of each: b(lank), d(uplicate), t(runcated) or none.

    The first of equal turns of a conversation is found by an aggregate; only those that repeat are joined.
    """
    turns = turns.withColumns({"role_head": F.substring("role", 1, 32), "text_head": F.substring("text", 1, 64), "tie": F.xxhash64("role", "text"), "h": F.xxhash64("conv_id", "role", "text"), "g": F.xxhash64(F.lit(1), "text", "role", "conv_id")})
    turns = turns.withColumns({"isblank": ~F.col("text").rlike(f"[^{WHITE}]"), "place": F.struct(*_ORDER)})
    first = turns.where("NOT gone AND NOT isblank").groupBy("h", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "g", "first")
    cut = ~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")
    fault = F.when(F.col("isblank"), "b").when(F.col("place") > F.col("first"), "d").when(cut, "t").otherwise("")
    return turns.join(first, ["h", "g"], "left").select("conv_id", *_ORDER, "role", "text", "gone", fault.alias("fault"))


def read_stretches(turns: DataFrame) -> DataFrame:
    """(piece, stretch), one of them null, of turns dealt in order: the piece of each conversation that one stretch inside a task holds,
    and the stretches of all others."""
    tasks = shuffle_partitions(turns.sparkSession)
    dealt = turns.repartitionByRange(tasks, "conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    rows = dealt.select("conv_id", "turn", "role", "text", "gone", "fault", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, task, place, own, first, parts = None, 0, 0, None, True, False

        def close(more: bool) -> None:
            """more: the conversation goes on, perhaps in another task. The task's first one may have begun in another."""
            nonlocal place, parts
            if parts or more or first:
                out.append({"stretch": {"conv_id": conv, "task": task, "place": place, **own.fields()}})
                place, parts = place + 1, True
                return
            cost, audit = repaired("".join(own.codes))
            counts = {"gaps": 0 if own.least is None else own.most - own.least + 1 - own.distinct, "cost": cost} | {c: getattr(own, c) for c in COUNTS[1:5]}
            out.append({"piece": {"conv_id": conv, "whole": True, "last": True, **counts, "audit": audit, "repaired": _turns(edited(audit, 0, own.turns))}})

        for batch in batches:
            for conv_, turn, role, text, gone, fault, task in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None or conv_ != conv:
                    if own is not None:
                        close(False)
                        first = False
                    conv, own, parts = conv_, Stretch(), False
                elif own.full():
                    close(True)
                    own = Stretch()
                if not gone:
                    own.add(turn, role, text, fault)
            yield _batch(out, _BOTH)
            out.clear()
        if own is not None:
            close(True)
            yield _batch(out, _BOTH)

    small_batches(turns.sparkSession)
    return rows.mapInArrow(run, _spark(_BOTH))


def chained(stretches: DataFrame) -> DataFrame:
    """(task, place, state, part, last, counts...): of each stretch, what its conversation's cheapest audit says of it, and the state before it.

    The last stretch's row holds the conversation's counts. Stretches of one conversation meet in one task in order, without their texts.
    """
    columns = ["conv_id", "task", "place", *Stretch.NUMBERS, *Stretch.STRINGS]
    rows = stretches.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "task", "place")
    schema = pa.schema([("task", pa.int64()), ("place", pa.int64()), ("state", pa.int64()), ("part", pa.string()), ("last", pa.bool_()), *[(c, pa.int64()) for c in COUNTS]])

    def total(own: list[dict]) -> list[dict]:
        chain, counts = Chain(), dict.fromkeys(COUNTS, 0)
        final = most = least = None
        distinct = 0
        for s in own:
            if not s["n"]:
                continue
            chain.add(ways(s["codes"]))
            for c in COUNTS[1:5]:
                counts[c] += s[c]
            counts["illegal"] += final is not None and (final, s["first"]) not in LEGAL
            final = s["final"]
            if s["least"] is not None:
                distinct += s["distinct"] - (most == s["least"])
                least, most = s["least"] if least is None else least, s["most"]
        cost, pieces, tail = chain.end()
        counts |= {"cost": cost, "gaps": 0 if least is None else most - least + 1 - distinct}
        told = iter(pieces)
        out = [dict(zip(("state", "part"), next(told) if s["n"] else (0, ""), strict=True)) | {"task": s["task"], "place": s["place"], "last": False} for s in own]
        if tail:  # there are turns then
            out[max(i for i, s in enumerate(own) if s["n"])]["part"] += tail
        out[-1] |= {"last": True} | counts
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            for s in batch.to_pylist():
                if own and own[0]["conv_id"] != s["conv_id"]:
                    yield _batch(total(own), schema)
                    own = []
                own.append(s)
        if own:
            yield _batch(total(own), schema)

    return rows.mapInArrow(run, _spark(schema))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Pieces of the repaired conversations: (conv_id, whole, task, place, last, counts..., audit, repaired).

    turns: (conv_id, turn, role, text), and gone, which marks turns that aren't there but whose conversation is to be told. A
    conversation is one piece (whole) or several, in the order of (task, place), of which the last holds its counts; audit and
    repaired, an array of (role, text), are the piece's own.

    Turns go by number, those without one first, and ties by role and text. Turns without an id are a conversation of their own.
    Null roles and texts count as empty. Equal rows are duplicates of each other. No rows: no rows. Other columns are left behind.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "repair")
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), gone.alias("gone"), F.monotonically_increasing_id().alias("row"))
    own = scratch.keep(own, "turns")  # rows keep their numbers
    both = scratch.keep(read_stretches(with_faults(own)), "stretches")
    scratch.drop("turns")
    stretches = both.where("stretch IS NOT NULL").select("stretch.*")
    texts = stretches.select("conv_id", "task", "place", "turns").join(chained(stretches), ["task", "place"])
    columns = ["conv_id", "task", "place", "last", *COUNTS, "part", "state", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = edited(r["part"], r["state"], [(t["role"], t["text"]) for t in r["turns"]])
                out.append({c: r[c] for c in columns[:-3]} | {"whole": False, "audit": r["part"], "repaired": _turns(found)})
            yield _batch(out, _PIECE)

    small_batches(spark)
    return both.where("piece IS NOT NULL").select("piece.*").unionByName(texts.select(*columns).mapInArrow(run, _spark(_PIECE)))


def report(pieces: DataFrame) -> DataFrame:
    """(conv_id, counts..., audit, repaired_sha256): a row for each conversation, of `repair_conversations`.

    The hash of a conversation of several pieces needs them in order: they stream through one task, a piece in memory at a time.
    """
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    lines = pieces.select("conv_id", "whole", "task", "place", "last", *COUNTS, "audit", F.size("repaired").alias("n"), said.alias("said"))
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    whole = lines.where("whole").select(*names[:-1], F.sha2("said", 256).alias(names[-1]))
    schema = pa.schema([(c, pa.string() if c in names[-2:] else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits, sha, begun = [], hashlib.sha256(), False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audits.append(r["audit"])
                if r["n"]:
                    sha.update((("\n" if begun else "") + r["said"]).encode())
                    begun = True
                if r["last"]:
                    out.append({c: r[c] for c in names[:-2]} | {"audit": "".join(audits), "repaired_sha256": sha.hexdigest()})
                    audits, sha, begun = [], hashlib.sha256(), False
            yield _batch(out, schema)

    rest = lines.where("NOT whole").drop("whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "place")
    return whole.unionByName(rest.mapInArrow(run, _spark(schema)))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repair_conversations(damaged(read(spark, sf_dir, "conversations"))))
