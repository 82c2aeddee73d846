"""Conversation repair against exhaustive dynamic programming, with ties, nulls, long and split conversations."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache
from math import inf

import pytest

from panelspark.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def repaired(rows):
    """(cost, audit, texts) of rows (role, text) by plain recursion over what the repaired conversation ends with."""
    seen, marks = set(), []
    for role, text in rows:
        core = text.strip(SPACE)
        marks.append((not core or (role, text) in seen, bool(core) and core[-1] not in ".!?"))
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserted):
        """Least (cost, audit) from row i on; at most two inserts in a row are ever useful."""
        out = [(0, "")] if i == len(rows) and last in "0a" else []
        asked = "a" if last == "u" else "u"
        if i < len(rows):
            (must_go, late), initial = marks[i], rows[i][0][:1]
            ahead = [("D", 2, last)]
            if not must_go:
                if (last == "0" and initial in "su" or last in "sa" and initial == "u" or last == "u" and initial == "a") and initial:
                    ahead.append(("K", 5 * late, initial))
                ahead.append(("R", 1 + 5 * late, asked))
            for edit, cost, to in ahead:
                c, a = best(i + 1, to, 0)
                out.append((cost + c, edit + a))
        if inserted < 3:
            c, a = best(i, asked, inserted + 1)
            out.append((5 + c, "I" + a))
        return min(out, default=(inf, ""))

    for i in reversed(range(len(rows) + 1)):
        for last in "0sua":
            best(i, last, 3)
    cost, audit = best(0, "0", 0)
    texts, i, last = [], 0, "0"
    for e in audit:
        if e == "I":
            last = "a" if last == "u" else "u"
            texts.append({"u": "user:", "a": "assistant:"}[last])
            continue
        role, text = rows[i]
        i += 1
        if e == "R":
            last = "a" if last == "u" else "u"
            role = {"u": "user", "a": "assistant"}[last]
        elif e == "K":
            last = role[0]
        if e != "D":
            texts.append(f"{role}:{text}")
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for (role, text), (must_go, late) in zip(rows, marks):
        name = "blank" if not text.strip(SPACE) else "duplicate" if must_go else "truncated" if late else None
        if name:
            faults[name] += 1
    return cost, audit, texts, faults


def brute(table):
    """The contract, row by row."""
    by = defaultdict(list)
    for conv, turn, role, text in table:
        rows = by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, texts, faults = repaired(tuple(r[1:] for r in rows)) if rows else (0, "", [], {"blank": 0, "duplicate": 0, "truncated": 0})
        sha = hashlib.sha256("\n".join(texts).encode()).hexdigest()
        out[conv] = {"conv_id": conv, "gaps": gaps, **faults, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}
    return out


def check(spark, df, rows):
    got = {r["conv_id"]: r.asDict() for r in cv.conversation_digests(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["Hi.", "Well?", "no end", " ", "", None, "Ünï!\n", "end. ", "x" * 50 + "."]
    out = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(texts)
            text = text and text.strip() and rng.random() < 0.7 and f"{turn} {text}" or text
            out.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(roles), text))
    return out


def test_codes_against_recursion():
    rng = random.Random(3)
    for _ in range(1500):
        rows = tuple((rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b.", "c", "", f"{rng.random()}."])) for _ in range(rng.randint(0, 9)))
        seen, codes = set(), ""
        for role, text in rows:
            codes += cv.code_of(role[0], not text, (role, text) in seen, text[-1:] in ".!?")
            seen.add((role, text))
        assert cv.cheapest(codes) == repaired(rows)[:2], codes


def test_blocks_and_fragments_give_the_same_paths():
    rng = random.Random(4)
    for n in (0, 1, 31, 32, 33, 64, 100, 700):
        codes = "".join(rng.choice("ssuuaaaUASxd") for _ in range(n))
        cost, audit = cv.cheapest(codes)
        cut = sorted(rng.sample(range(n + 1), min(3, n)))
        parts = [codes[a:b] for a, b in zip([0, *cut], [*cut, n])]
        behind = tuple(cv.blocks(parts[-1], cv.FINAL, True)[0].price[:4])
        exits = [cv.FINAL, behind]
        for p in parts[-2::-1]:
            t = cv.transfer(p)
            behind = tuple(min(t[e][x] + behind[x] for x in range(4)) for e in range(4))
            exits.append(behind)
        exits = exits[-2::-1] if len(parts) > 1 else [cv.FINAL]
        state, found = cv.EMPTY, ""
        for i, p in enumerate(parts):
            a, state = cv.follow(cv.blocks(p, exits[i], i + 1 == len(parts)), state)
            found += a
        assert found == audit and (n == 0 or behind[0] == cost)


@pytest.mark.parametrize("seed, convs, longest", [(1, 60, 7), (2, 5, 40)])
def test_query_against_brute_force(spark, table, seed, convs, longest):
    rows = some_rows(seed, convs, longest)
    rows += rows[:5] + [(None, 1, "user", "Lost."), (None, None, None, None), (900, None, None, None), (901, None, "user", "x"), (901, None, "user", "x")]
    check(spark, table(rows, SCHEMA), rows)


def test_one_conversation_over_many_ranges(spark, table):
    rows = [(7, t % 900, ("user", "assistant", "system")[t % 5 % 3], f"{t % 700} words{'.' if t % 7 else ''}") for t in range(1200)]
    rows += [(7, 5, "user", "Same.")] * 300 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    check(spark, table(rows, SCHEMA), rows)


def test_empty_table(spark, table):
    assert cv.conversation_digests(table([], SCHEMA)).collect() == []
    assert cv.repair_conversations(table([], SCHEMA)).collect() == []


def test_edits_tell_the_repaired_conversation(spark, table):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "user", "Again?"), (1, 3, "assistant", "cut off"), (1, 4, "user", " ")]
    got = [(r["edit"], r["fault"], r["new_role"]) for r in cv.repair_conversations(table(rows, SCHEMA)).orderBy("at").collect()]
    want = repaired(tuple((r[2], r[3]) for r in rows))
    assert "".join(e for e, _, _ in got) == want[1]
    assert [f for _, f, _ in got if f] == ["truncated", "blank"]


def test_long_text_and_clashing_columns(spark, table):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "\n" * 1_000_000), (2, 0, "user", "Hi.")]
    df = table(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "at", "row", "part", "edit", "digest", "uid", "dropped", "h")})
    check(spark, df, rows)
