"""Conversation repair against plain dynamic programming and against all edit strings."""

import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from tallyweave.llm import dialogue, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def text_key(text):
    return hashlib.md5(text.encode()).digest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0d]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def step(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def cheapest(roles, found):
    """(cost, audit, [(row or None, initial)]) by memoised search over all edits."""
    memo = {}

    def best(i, state, inserts):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        options = [(0, "", ())] if i == len(roles) and state in ("", "a") else []

        def go(cost, letter, i, state, put, inserts=0):
            rest = best(i, state, inserts)
            if rest is not None:
                options.append((cost + rest[0], letter + rest[1], put + rest[2]))

        if inserts < 3:
            for c in "ua":
                if step(state, c):
                    go(5, "I", i, step(state, c), ((None, c),), inserts + 1)
        if i < len(roles):
            go(2, "D", i + 1, state, ())
            if found[i] in ("", "truncated"):
                more = 5 if found[i] else 0
                if step(state, roles[i][:1]):
                    go(more, "K", i + 1, step(state, roles[i][:1]), ((i, roles[i]),))
                for c in "ua":
                    if step(state, c):
                        go(1 + more, "R", i + 1, step(state, c), ((i, c),))
        memo[i, state, inserts] = min(options, key=lambda o: o[:2]) if options else None
        return memo[i, state, inserts]

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(roles) + 1000))
    return best(0, "", 0)


def report(rows, everyone):
    out = {}
    for conv in everyone:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], text_key(r[3])))
        found = faults(own)
        roles = [r[2] for r in own]
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, put = cheapest(roles, found)
        name = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{name.get(c, c)}:{'' if i is None else own[i][3]}" for i, c in put)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def values(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def some_rows(rng, conversations, longest):
    texts = ["Yes.", "No", "", " \t", "Why? ", "So!\n", "a.", "b", "Long text. End", "é?"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((c, t * 2 if c % 5 == 0 else t, role, rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randrange(99)}."))
    return rows


def test_cheapest_edits_of_all_short_signatures():
    """The automaton against memoised search, for every signature of up to three rows."""
    roles = ["system", "user", "assistant", "tool"]
    letters = [(r, f) for r in range(4) for f in range(4)]
    words = sorted(
        (bytes(dialogue.LETTER + 4 * r + f for r, f in reversed(w)), w) for n in range(4) for w in itertools.product(letters, repeat=n)
    )
    kinds = ["", "blank", "duplicate", "truncated"]
    for (_, w), got in zip(words, dialogue.solve(s for s, _ in words), strict=True):
        cost, audit, _ = cheapest([roles[r] for r, _ in w], [kinds[f] for _, f in w])
        assert got == (cost, audit), w


def test_audits_enumerated():
    """The search itself against all edit strings, for short conversations."""
    for roles, found in ([["user", "user"], ["", ""]], [["assistant", "system"], ["truncated", ""]], [["user"], [""]], [["user", "assistant", "user"], ["", "", "truncated"]]):
        best = None
        for n in range(2 * len(roles) + 3):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != len(roles):
                    continue
                i, state, cost = 0, "", 0
                for e in audit:
                    wanted = "a" if state == "u" else "u"
                    if e == "I":
                        state, cost = step(state, wanted), cost + 5
                        continue
                    cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if found[i] == "truncated" and e != "D" else 0)
                    state = state if e == "D" else step(state, wanted if e == "R" else roles[i][:1])
                    i += 1
                    if state is None:
                        break
                if state in ("", "a") and (best is None or (cost, "".join(audit)) < best):
                    best = (cost, "".join(audit))
        assert cheapest(roles, found)[:2] == best


def test_nodes_are_shared():
    automaton = dialogue.Suffixes()
    known = automaton.last
    for _ in range(10000):
        known, _ = automaton.node(dialogue.LETTER + 4, known)
    assert len(automaton.entries) < 20 and len(automaton.steps) < 20


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    rows = some_rows(random.Random(seed), 120, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert values(dialogue.repair_report(df)) == report(damaged(rows), {r[0] for r in rows})


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(6)
    rows = some_rows(rng, 30, 6) + [(99, t, ["user", "assistant"][t % 2], f"t{t % 400}.") for t in range(1500)] + [(98, None, "user", "Hi.")] * 700
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert values(dialogue.repair_report(df)) == report(damaged(rows), {r[0] for r in rows})


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hello."), (None, 3, "user", "Hello."), (1, None, "system", "Be kind."), (1, None, "user", "A" * 100000), (1, 4, "assistant", "B."),
        (2, 1, "", ""), (3, -(1 << 63), "user", "a."), (3, (1 << 63) - 1, "assistant", "b."), (4, 0, "user", "Hello.\n\x0b "), (4, 0, "assistant", "\U0001f600"), (4, 1, "user", " "),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as `{c}`" for c in ("copies", "digest", "fault", "row", "audit", "signature", "kind", "c", "part")])
    got, want = values(dialogue.repair_report(df)), report(damaged(rows), {r[0] for r in rows})
    want = {c: (min(v[0], (1 << 63) - 1), *v[1:]) for c, v in want.items()}
    assert got == want
    assert dialogue.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    # a conversation whose rows are all dropped
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    only = values(dialogue.repair_report(spark.createDataFrame([(7, gone, "user", "x.")], SCHEMA)))
    assert only == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "system", "Rules."), (2, 1, "assistant", "Lost")]
    got = [tuple(r) for r in dialogue.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    # one of the two user turns goes; the system turn alone costs less deleted than completed
    assert got == [(1, 0, "K", "user", "Again."), (1, 1, "K", "assistant", "Yes.")]
    for conv in (some_rows(random.Random(s), 40, 8) for s in (3, 4)):
        shapes = {}
        for r in dialogue.repaired(spark.createDataFrame(conv, SCHEMA)).orderBy("conv_id", "place").collect():
            shapes[r["conv_id"]] = shapes.get(r["conv_id"], "") + r["role"][:1]
        assert shapes and all(re.fullmatch("s?(ua)+", s) for s in shapes.values())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert values(queries.QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01")) == report(damaged(rows), {r[0] for r in rows})
