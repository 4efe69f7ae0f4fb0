"""Conversation repair against a plain programme over whole audits, and the grammar itself."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gregale.llm import registry, repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        own += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in convs.items()}


def best_of(turns, faults):
    """(cost, audit, lines) of the cheapest edits: by state, the cheapest of all that came before, with its whole audit."""
    best = {0: (0, "", ())}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(own):
        own = dict(own)
        for _ in range(4):
            for state, (cost, audit, lines) in list(own.items()):
                for r in "ua":
                    if (state, r) in NEXT:
                        put(own, NEXT[state, r], (cost + 3, audit + "I", (*lines, ROLE[r] + ":")))
        return own

    for (_, role, text), fault in zip(turns, faults, strict=True):
        now = {}
        for state, (cost, audit, lines) in inserted(best).items():
            put(now, state, (cost + 4, audit + "D", lines))
            if fault in ("", "t"):
                more = 3 * (fault == "t")
                if (state, role[:1]) in NEXT:
                    put(now, NEXT[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (state, r) in NEXT:
                        put(now, NEXT[state, r], (cost + 3 + more, audit + "R", (*lines, f"{ROLE[r]}:{text}")))
        best = now
    return min(way for state, way in inserted(best).items() if state in (0, 3))


def brute(rows):
    out = {}
    for conv, own in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = best_of(own, faults)
        out[conv] = (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(seed, convs=60, turns=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "well", " \t", "", None, "a. b", "x.\n", "é. \v", "long " * 2000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(roles[: 4 if c % 2 else 9]), r.choice(texts)) for c in range(convs) for t in range(r.randrange(1, turns))]
    rows += [(None, t, "user", "Hm.") for t in range(4)] + rows[:3] + [(7, -5, "user", "so."), (7, 40, "assistant", "so.")]
    return rows


def check(spark, tmp_path, rows, name):
    spark.createDataFrame([(*row, 1) for row in rows], "conv_id long, turn long, role string, text string, gone int").drop("gone").repartition(3).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = registry.QUERIES["op13_repair"](spark, f"{tmp_path}/{name}")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r) for r in got.collect()} == (want := brute(rows)) and got.count() == len(want)


def test_op13(spark, tmp_path):
    check(spark, tmp_path, table(1), "odd")


def test_long_conversations_in_many_stretches(spark, tmp_path, monkeypatch):
    """One conversation holds most rows and lies in all tasks; stretches hold 5 turns, or few characters."""
    monkeypatch.setattr(repair, "STRETCH", 5)
    r = random.Random(4)
    hot = [(3, t, r.choice(["user", "assistant", "assistant", "system", "x"]), r.choice(["One.", "Two", f"{t}.", f"{t}"])) for t in range(400)]
    check(spark, tmp_path, table(2, 20) + hot + [(1000, t, "assistant", "") for t in range(30)], "hot")
    monkeypatch.setattr(repair, "STRETCH_CHARS", 1)
    check(spark, tmp_path, table(3, 15), "chars")


def test_no_conversations(spark, tmp_path):
    check(spark, tmp_path, [], "none")


def test_all_dropped(spark, tmp_path):
    gone = [(c, t, "user", "Hi.") for c in range(40) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    check(spark, tmp_path, gone, "gone")
    assert all(v[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in brute(gone).values())


def test_repaired_conversations_fit_the_grammar(spark):
    rows = [r for r in table(5) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = {}
    for p in sorted(repair.repair_conversations(df).collect(), key=lambda p: (p.conv_id, p.task or 0, p.place or 0)):
        pieces.setdefault(p.conv_id, []).extend(p.repaired)
    assert len(pieces) == len({r[0] for r in rows})
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own)) for own in pieces.values())


@pytest.mark.parametrize("codes", ["", "u", "a", "s", "d", "x", "ua", "sua", "uu", "aa", "UA", "ds", "suXdau", "aSuua", "uadUuaxA"])
def test_chain_of_stretches_equals_one_pass(codes):
    """Wherever it is cut, into one, two or three stretches."""
    want = repair.repaired(codes)
    for i, j in itertools.combinations_with_replacement(range(len(codes) + 1), 2):
        chain = repair.Chain()
        for part in (codes[:i], codes[i:j], codes[j:]):
            if part:
                chain.add(repair.ways(part))
        cost, pieces, tail = chain.end()
        assert (cost, "".join(audit for _, audit in pieces) + tail) == want


def test_every_short_code_against_the_plain_programme():
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    for n in range(5):
        for codes in itertools.product("suaxUAd", repeat=n):
            turns = [(None, role[c.lower()], "t") for c in codes]
            faults = ["b" if c == "d" else "t" if c < "a" else "" for c in codes]
            assert repair.repaired("".join(codes)) == best_of(turns, faults)[:2]
