"""Conversation repair against a search over all edits, and its pieces against the whole."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from loreline.llm import conversations
from loreline.llm.conversations import Stacks, damaged, digests, repaired
from loreline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)
        fault = "blank" if not last.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines), by trying every edit before every row; state: what the grammar has read."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, put):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if put < 3:
            for name in ("user", "assistant"):
                if (state, name[0]) in follow:
                    c, a, t = best(i, follow[state, name[0]], put + 1)
                    ways.append((c + 5, "I" + a, (f"{name}:", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, t))
            if fault in ("", "truncated"):
                for cost, edit, name in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    if (state, name[:1]) in follow:
                        c, a, t = best(i + 1, follow[state, name[:1]], 0)
                        ways.append((c + cost + 5 * (fault == "truncated"), edit + a, (f"{name}:{text}", *t)))
        return min(ways, default=(10**9, "", ()))

    for k in range(len(rows), -1, -1):  # from the end, so that recursion stays shallow
        for state in ("", "s", "u", "a"):
            for put in (3, 2, 1, 0):
                best(k, state, put)
    return best(0, "", 0)


def expected(rows):
    """Every column of the query for one conversation's (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marked = faults_of(rows)
    cost, audit, lines = cheapest(tuple(marked))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    kinds = [f for _, _, f in marked]
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def found(spark, rows):
    fixed = repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    sha = {r.key: r.sha for r in digests(fixed.turns).collect()}
    empty = hashlib.sha256().hexdigest()
    return {r.key: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.key, empty)) for r in fixed.reports.collect()}


@pytest.mark.parametrize("piece", [2, 5, 1024])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    draw = random.Random(piece)
    rows = []
    for conv in range(220):
        for _ in range(draw.choice([1, 2, 3, 5, 8, 40])):
            text = draw.choice(["", " ", "a.", "b.", "c", "d!", "e? ", "f"]) if draw.random() < 0.5 else f"{draw.random()}" + draw.choice(["", ".", ".", "."])
            rows.append((conv, draw.choice([None, *range(30)]), draw.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), text))
    rows += [(500, 3, "user", "same.")] * 30 + [(501, 3, "user", " ")] * 9 + [(502, t % 4, "assistant", "same.") for t in range(16)]
    by = {}
    for conv, *row in rows:
        by.setdefault(f"={conv}", []).append(tuple(row))
    assert found(spark, rows) == {k: expected(v) for k, v in by.items()}


def test_long_conversation_in_pieces(spark):
    draw = random.Random(9)
    rows = [(1, t, draw.choice(["user", "assistant", "user", "assistant", "system"]), f"{t}" + draw.choice(["", ".", ".", ".", "."])) for t in range(5000)]
    got = found(spark, rows)["=1"]
    stacks = Stacks()
    marked = faults_of([r[1:] for r in rows])
    ways = stacks.paths([(role[:1], fault, 1) for role, _, fault in marked], [stacks.root])
    ends = stacks.endings()
    cost, audit = min((c + ends[n][0], a + "I" * len(ends[n][1])) for _, n, c, a, _ in ways if n in ends)
    assert got[5:7] == (cost, audit)


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {conv: [] for conv, *_ in table}
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, SF_DIR).collect()}
    assert got == {conv: expected(rows) for conv, rows in by.items()}


def test_damage_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)] + [(None, i, None, None) for i in range(30)], "conv_id long, turn long, role string, text string")
    want = []
    for turn in [None, *range(30)]:
        kind = zlib.crc32(f" :{' ' if turn is None else turn}".encode()) % 20
        want += [(turn, "user" if kind == 4 else " ", "" if kind == 1 else " ")] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted([(r.turn, r.role, r.text) for r in damaged(df).collect()], key=str) == sorted(want, key=str)


def test_other_grammars():
    assert Stacks((("x", ("x", "u")), ("x", ("u",))), "x").accepts[0] is False
    with pytest.raises(ValueError):
        Stacks((("x", ("u", "x")), ("x", ())), "x")
