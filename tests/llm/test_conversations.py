"""Repairs of conversations, held against a search through all edits."""

import hashlib
import random
import re
import zlib

from quern.llm import conversations
from quern.llm.conversations import Repair

AFTER = {"": "user", "s": "user", "u": "assistant", "a": "user"}
RNG = random.Random(1)


def cheapest(rows):
    """Least cost, then ASCII-least edits, of all ways to edit up to six rows."""

    def inserted(found):
        found = dict(found)
        for _ in range(2):
            for (state, audit, lines), cost in list(found.items()):
                key = (AFTER[state][0], audit + "I", (*lines, AFTER[state] + ":"))
                found[key] = min(cost + 5, found.get(key, 999))
        return found

    found = {("", "", ()): 0}
    for role, text, fault in rows:
        after = {}
        for (state, audit, lines), cost in inserted(found).items():
            ways = [(2, "D", state, lines)]
            if fault not in ("blank", "duplicate"):
                more, to = 5 * (fault == "truncated"), AFTER[state]
                if role[:1] == to[0]:
                    ways.append((more, "K", to[0], (*lines, f"{role}:{text}")))
                if role[:1] == "s" and not state:
                    ways.append((more, "K", "s", (*lines, f"{role}:{text}")))
                ways.append((more + 1, "R", to[0], (*lines, f"{to}:{text}")))
            for price, letter, to, new in ways:
                key = (to, audit + letter, new)
                after[key] = min(cost + price, after.get(key, 999))
        least = min(after.values())
        found = {k: v for k, v in after.items() if v <= least + 15}  # what lies further off can never win
    return min((cost, audit, lines) for (state, audit, lines), cost in inserted(found).items() if state in ("", "a"))


def repaired(rows):
    repair, edits = Repair(), []
    for row in rows:
        edits += list(repair.row(*row))
    cost, rest = repair.finish()
    edits += list(rest)
    return cost, "".join(e.letter for e in edits), tuple(f"{e.role}:{e.text}" for e in edits if e.role is not None)


def test_edits_are_the_cheapest_and_the_least():
    for _ in range(1500):
        rows = [(RNG.choice(["user", "assistant", "system", " ", "", "u2"]), f"t{i}", RNG.choice([None, None, None, "blank", "duplicate", "truncated"])) for i in range(RNG.randint(0, 6))]
        assert repaired(rows) == cheapest(rows), rows


def test_decided_edits_are_forgotten():
    repair, most, given = Repair(), 0, 0
    for i in range(20_000):
        given += len(list(repair.row(("user", "assistant")[i % 2] if i % 17 else "x", "t", None if i % 11 else "truncated")))
        most = max(most, *(len(repair._between(p.last)) for p in repair.alive.values()))
    assert most < 100 and given > 19_900


def by_hand(rows):
    """Accounts of damaged rows in plain Python."""
    space = lambda x: " " if x is None else str(x)
    kept = {}
    for id, turn, role, text in rows:
        lines = kept.setdefault(id, [])
        case = zlib.crc32(f"{space(id)}:{space(turn)}".encode()) % 20
        role, text = "user" if case == 4 else space(role), "" if case == 1 else re.sub("[.!?]", "", space(text)) if case == 2 else space(text)
        lines += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    out = {}
    for id, lines in kept.items():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faulted = set(), []
        for _, role, text in lines:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulted.append((role, text, fault))
        turns = [t for t, _, _ in lines if t is not None]
        count = lambda k: sum(f == k for _, _, f in faulted)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulted, faulted[1:], strict=False))
        cost, audit, repaired_lines = cheapest(faulted)
        digest = hashlib.sha256("\n".join(repaired_lines).encode()).hexdigest()
        out[id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


def rows():
    out = []
    for id in [None, *range(150)]:
        for turn in range(RNG.randint(1, 6)):
            text = RNG.choice([None, "", " \t", "Yes.", "Yes.", "A line\nand more! ", "No end", "ü?", "x" * 3000 + "."])
            out.append((id, RNG.choice([turn, turn, turn, turn + 3, None]), RNG.choice(["user", "assistant", "system", "tool", None, ""]), text))
    return out + out[:20]


def test_accounts_are_those_of_plain_python(spark):
    given = rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in given], "conv_id long, turn long, role string, text string, fault string, cost int").repartition(4)
    found = {r["conv_id"]: tuple(r)[1:] for r in conversations.accounts(conversations.damaged(df)).collect()}
    assert found == by_hand(given)


def test_edits_give_the_repaired_lines(spark):
    df = conversations.damaged(spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string"))
    accounts, edits = {r["conv_id"]: r for r in conversations.accounts(df).collect()}, {}
    for r in sorted(conversations.edits(df).collect(), key=lambda r: r["step"]):
        edits.setdefault(r["conv_id"], []).append(r)
    for id, account in accounts.items():
        own = edits.get(id, [])
        assert [r["step"] for r in own] == list(range(1, len(own) + 1)) and "".join(r["edit"] for r in own) == account["audit"]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own if r["role"] is not None).encode()).hexdigest() == account["repaired_sha256"]


def test_no_rows_and_dropped_rows(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.accounts(conversations.damaged(none)).collect() == []
    dropped = [t for t in range(100) if zlib.crc32(f"c:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame([("c", t, "user", "Hi.") for t in dropped], "conv_id string, turn long, role string, text string")
    assert [tuple(r) for r in conversations.accounts(conversations.damaged(df)).collect()] == [("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
