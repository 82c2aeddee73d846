"""Cheapest repair of conversations: which turns to keep, rerole, delete or insert so that roles alternate.

A conversation is a path through a lattice of (row, state) nodes, where the state is what stands last in the repaired
conversation. Bertsekas's auction algorithm finds the shortest path: a path grows from the origin towards the arc of
least cost plus price, and where the price of its end is below that, the price is raised and the path loses its end.
Prices never exceed an arc's cost plus the price of its head, so on an arc of a shortest path the two are equal: the
repair is the first path in the order of labels along such tight arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import shuffle_parts, small_batches
from panelspark.llm.words import CRC_TABLE_SQL, crc32_sql
from panelspark.session import materialize

# Costs of the edits, white space and sentence ends of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: states by what stands last in the repaired conversation: nothing, system, user, assistant
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: state after a kept role
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the role that a state asks for, which a rerole or an insert supplies
ASKED = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: a conversation may end where nothing or an assistant stands last
FINAL = (0, inf, inf, 0)
#: rows priced by one auction; prices of a block are the costs at the end of the block before it
BLOCK = 32
#: Arrow rows handed on at once
SLICE = 1024


# ---- the lattice -------------------------------------------------------------------------------
# A row is one letter: its role's initial (x: another one), in upper case if it is truncated, or d if it must go.


class Block:
    """The lattice over at most ``BLOCK`` rows; node 4 * i + s is in front of row i in state s.

    ``exits`` are the costs from each state behind the last row on. Inserts in front of the rows belong to this block,
    those behind the last row to the next block, or to this one if it is the ``last``.
    """

    def __init__(self, codes: str, exits: tuple, last: bool):
        self.codes, self.exits, self.last, self.n = codes, exits, last, len(codes)
        self.goal = 4 * self.n + 4
        # prices start at the least cost behind the block, which no path undercuts
        self.price = [min(exits)] * self.goal + [0]
        self.known: dict[int, list[tuple[str, int, int]]] = {}
        some = [x < inf for x in exits]
        self.ends = some[USER] or some[ASSISTANT]
        #: the last row that brings an empty conversation to a system turn
        self.opened = max((i for i, c in enumerate(codes) if c in "sS"), default=-1) if some[SYSTEM] else -1

    def alive(self, i: int, s: int) -> bool:
        """Whether an exit of finite cost can be reached."""
        if i == self.n and not (self.last and self.ends):
            return self.exits[s] < inf
        return self.ends or (s <= SYSTEM and self.exits[s] < inf) or (s == EMPTY and i <= self.opened)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(label, cost, head) in the order of labels; no two arcs of a node share a label."""
        if (found := self.known.get(node)) is not None:
            return found
        i, s = divmod(node, 4)
        out, asked = [], AFTER[s, ASKED[s]]
        if i < self.n:
            code = self.codes[i]
            late = TRUNCATED if code.isupper() else 0
            out.append(("D", DELETE, i + 1, s))
            out.append(("I", INSERT, i, asked))
            if code != "d":
                if (kept := AFTER.get((s, code.lower()))) is not None:
                    out.append(("K", late, i + 1, kept))
                out.append(("R", REROLE + late, i + 1, asked))
        elif self.last:
            out.append(("I", INSERT, i, asked))
        found = [(label, cost, 4 * j + t) for label, cost, j, t in out if self.alive(j, t)]
        if i == self.n and self.exits[s] < inf:
            found.insert(0, ("", self.exits[s], self.goal))
        self.known[node] = found
        return found

    def auction(self, state: int) -> float:
        """Least cost from the first row in ``state`` to the end of the conversation, by contractions and extensions."""
        if not self.alive(0, state):
            return inf
        price, goal, path = self.price, self.goal, [state]
        while path[-1] != goal:
            node = path[-1]
            best, ahead = inf, goal
            for _, cost, head in self.arcs(node):
                if cost + price[head] < best:
                    best, ahead = cost + price[head], head
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(ahead)
        return price[state]

    def trace(self, state: int) -> tuple[str, int]:
        """Labels of the least path of tight arcs from ``state``, and the state behind the block. Run ``auction`` first."""
        dead, path, labels, price = set(), [state], [], self.price
        tries = [iter(self.arcs(state))]
        while True:
            for label, cost, head in tries[-1]:
                if price[path[-1]] == cost + price[head] and head not in dead:
                    break
            else:
                dead.add(path.pop())
                tries.pop()
                labels.pop()
                continue
            if head == self.goal:
                return "".join(labels), path[-1] % 4
            path.append(head)
            labels.append(label)
            tries.append(iter(self.arcs(head)))


def blocks(codes: str, exits: tuple, last: bool) -> list[Block]:
    """Priced blocks of a run of rows; the prices at the front of each are exact."""
    out = []
    for lo in reversed(range(0, max(len(codes), 1), BLOCK)):
        block = Block(codes[lo : lo + BLOCK], exits, last and not out)
        exits = tuple(block.auction(s) for s in range(4))
        out.append(block)
    return out[::-1]


def follow(priced: list[Block], state: int) -> tuple[str, int]:
    labels = []
    for block in priced:
        part, state = block.trace(state)
        labels.append(part)
    return "".join(labels), state


@lru_cache(1 << 16)
def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    priced = blocks(codes, FINAL, True)
    return int(priced[0].price[EMPTY]), follow(priced, EMPTY)[0]


def transfer(codes: str) -> list[list[float]]:
    """Cost from each state in front of some rows to each state behind them; ends of conversations are elsewhere."""
    out = []
    for s in range(4):
        exits = tuple(0 if t == s else inf for t in range(4))
        first = blocks(codes, exits, False)[0]
        out.append([first.price[e] if first.alive(0, e) else inf for e in range(4)])
    return [list(x) for x in zip(*out)]


def steps(audit: str, codes: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row or None for an insert, role or None for a deletion) of each edit."""
    at = 0
    for edit in audit:
        row = None if edit == "I" else at
        at += edit != "I"
        role = None if edit == "D" else codes[row].lower() if edit == "K" else ASKED[state]
        state = state if role is None else AFTER[state, role]
        yield edit, row, role


def code_of(initial: str, blank: bool, seen: bool, ended: bool) -> str:
    if blank or seen:
        return "d"
    letter = initial if initial in ROLES else "x"
    return letter if ended else letter.upper()


# ---- Spark -------------------------------------------------------------------------------------


def conversation_key(conv_id: Column) -> Column:
    """A string that tells conversations apart, a missing id included."""
    return F.when(conv_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn, role, text digest); no conversation needs to fit into one range."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    out = rows.select(
        conversation_key(F.col("conv_id")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
    )
    out = out.withColumns({"digest": F.unhex(F.sha2("text", 256)), "end": F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1), "uid": F.monotonically_increasing_id()})
    # rows that agree in all of it are equal, so their own numbers may part them anywhere
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("uid")]
    return out.repartitionByRange(shuffle_parts(rows), *order).sortWithinPartitions(*order).drop("uid")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per edit: conv_id, at (its order), edit, fault, turn, role, text, new_role.

    ``rows`` are (conv_id, turn, role, text); a null role or text counts as one space, a missing turn comes first, rows
    of one turn are ordered by role and text digest, a missing conv_id is a conversation too, other columns are ignored,
    and an empty table has no edits. ``edit`` is K, R, D or I; ``role`` and ``text`` are those of the row and null for an
    insert; ``new_role`` is null for a deletion. The repaired conversation are the rows with a ``new_role`` in order.

    Rows are dealt in ranges. A conversation inside one range is solved there; the first and last one of a range may
    reach into others and goes through ``_across``, so one conversation may hold any share of the rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv string, conv_id {kind}, at long, edit string, fault string, turn long, role string, text string, new_role string, part int, row long, code string, digest binary"
    types = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), Rows(types)
        held, now, first, n, at = [], None, True, 0, part << 40
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "text", "digest", "end")]):
                if row[0] != now:
                    for r in solved(held, at):
                        out.add(r)
                        at += 1
                    first, now, held, n = now is None, row[0], [], 0
                if first:
                    out.add(opened(row, part, n))
                else:
                    held.append(row)
                n += 1
                if len(out.rows) >= SLICE:
                    yield out.batch()
        for i, row in enumerate(held):
            out.add(opened(row, part, i))
            if len(out.rows) >= SLICE:
                yield out.batch()
        yield out.batch()

    def opened(row: tuple, part: int, n: int) -> tuple:
        conv, conv_id, turn, role, text, digest, end = row
        return conv, conv_id, None, None, None, turn, role, text, None, part, n, code_of(role[:1], not end, False, end in ENDS), digest

    def solved(held: list[tuple], at: int) -> Iterator[tuple]:
        seen, codes, faults = set(), [], []
        for _, _, _, role, _, digest, end in held:
            again = (role, digest) in seen
            seen.add((role, digest))
            codes.append(code_of(role[:1], not end, again, end in ENDS))
            faults.append(fault_of(codes[-1], not end))
        whole = "".join(codes)
        for i, (edit, row, role) in enumerate(steps(cheapest(whole)[1], whole, EMPTY)):
            if row is None:
                yield held[0][0], held[0][1], at + i, edit, None, None, None, None, ROLES[role], None, None, None, None
            else:
                conv, conv_id, turn, was, text, _, _ = held[row]
                now = was if edit == "K" else role and ROLES[role]
                yield conv, conv_id, at + i, edit, faults[row], turn, was, text, now, None, None, None, None

    done = materialize(small_batches(_sorted_rows(rows)).mapInArrow(run, schema), "edits")
    columns = ["conv_id", "at", "edit", "fault", "turn", "role", "text", "new_role"]
    return done.where("edit is not null").select(*columns).unionByName(_across(done.where("edit is null")).select(*columns))


def fault_of(code: str, blank: bool) -> str | None:
    return "blank" if blank else "duplicate" if code == "d" else "truncated" if code.isupper() else None


class Rows:
    """Tuples that become Arrow batches."""

    def __init__(self, types: pa.Schema):
        self.types, self.rows = types, []

    def add(self, row: tuple) -> None:
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(self.types)
        out = pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, self.types)], schema=self.types)
        self.rows = []
        return out


def _across(rows: DataFrame) -> DataFrame:
    """Edits of conversations that may lie in several ranges.

    The rows of one conversation in one range are a fragment. Codes of a fragment are one string, as long as the range has
    rows; costs between its four states are 16 numbers. Only these numbers meet in the driver, two fragments a range.
    """
    spark = rows.sparkSession
    narrow = rows.select("conv", "part", "row", "role", "digest", "code")
    place = F.struct("part", "row")
    # a blank row is one whatever came before; equal rows are counted by their first place, which pre-aggregates
    first = narrow.where("code <> 'd'").groupBy("conv", "role", "digest").agg(F.min(place).alias("first"))
    marked = narrow.join(first, ["conv", "role", "digest"], "left")
    marked = marked.withColumn("code", F.when(F.col("first").isNull() | (F.col("first") < place), F.lit("d")).otherwise(F.col("code")))
    marked = marked.select("conv", "part", "row", "code", F.col("first").isNull().alias("blank"))
    marked = materialize(marked, "marked")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "code"))), lambda x: x["code"]), "")
    pieces = materialize(marked.groupBy("conv", "part").agg(joined.alias("codes")), "fragments")

    def costs(batches):
        for b in batches:
            found = [sum(transfer(c), []) for c in b.column("codes").to_pylist()]
            whole = [[float(x) for x in blocks(c, FINAL, True)[0].price[:4]] for c in b.column("codes").to_pylist()]
            yield pa.record_batch([b.column("conv"), b.column("part"), pa.array(found, pa.list_(pa.float64())), pa.array(whole, pa.list_(pa.float64()))], ["conv", "part", "between", "last"])

    def traced(batches):
        for b in batches:
            for r in b.to_pylist():
                exits = tuple(x if x == inf else int(x) for x in r["exits"])
                priced = blocks(r["codes"], exits, r["last"])
                out = [(r["conv"], r["part"], s, *reversed(follow(priced, s))) for s in range(4) if priced[0].alive(0, s)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), ways_of)], ["conv", "part", "entry", "leaves", "audit"])

    def edits(batches):
        for b in batches:
            for r in b.to_pylist():
                found = list(steps(r["audit"], r["codes"], r["entry"]))
                for lo in range(0, len(found), SLICE):
                    some = found[lo : lo + SLICE]
                    out = [(r["conv"], r["part"], row, (r["part"] << 40) + lo + i, e, role) for i, (e, row, role) in enumerate(some)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv", "part", "row", "at", "edit", "asked"])

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    ways_of = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    # at most two fragments a range
    between = pieces.mapInArrow(costs, "conv string, part int, between array<double>, last array<double>").collect()
    exits, ahead = [], {}
    for r in sorted(between, key=lambda r: (r["conv"], -r["part"])):
        behind = ahead.get(r["conv"])
        exits.append((r["conv"], r["part"], [float(x) for x in behind or FINAL], behind is None))
        ahead[r["conv"]] = r["last"] if behind is None else [min(r["between"][4 * e + x] + behind[x] for x in range(4)) for e in range(4)]
    known = spark.createDataFrame(exits, "conv string, part int, exits array<double>, last boolean")
    ways = pieces.join(F.broadcast(known), ["conv", "part"]).mapInArrow(traced, "conv string, part int, entry int, leaves int, audit string")
    ways = materialize(ways, "ways")
    leaves = {(r["conv"], r["part"], r["entry"]): r["leaves"] for r in ways.drop("audit").collect()}
    chosen, state = [], {}
    for conv, part in sorted({k[:2] for k in leaves}):
        entry = state.get(conv, EMPTY)
        chosen.append((conv, part, entry))
        state[conv] = leaves[conv, part, entry]
    chosen = spark.createDataFrame(chosen, "conv string, part int, entry int")
    plan = ways.join(F.broadcast(chosen), ["conv", "part", "entry"]).join(pieces, ["conv", "part"])
    plan = plan.mapInArrow(edits, "conv string, part int, row long, at long, edit string, asked string")
    ids = rows.select("conv", "conv_id").distinct()
    full = rows.select("conv", "part", "row", "turn", "role", "text").join(marked, ["conv", "part", "row"])
    out = plan.join(ids, "conv").join(full, ["conv", "part", "row"], "left")
    asked = F.when(F.col("edit") == "K", F.col("role"))
    for letter, name in ROLES.items():
        asked = asked.when(F.col("asked") == letter, F.lit(name))
    fault = F.when(F.col("blank"), "blank").when(F.col("code") == "d", "duplicate").when(F.col("code") == F.upper("code"), "truncated")
    return out.withColumns({"new_role": asked, "fault": F.when(F.col("code").isNotNull(), fault)})


# ---- the query ---------------------------------------------------------------------------------


def damaged(rows: DataFrame, every: int = 20) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults chosen by a hash of conversation and turn; nulls are one space.

    Dropped rows stay, with a null role and text and ``dropped`` set.
    """
    space = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % every
    out = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    out = out.withColumns({
        "dropped": F.col("h") == 0, "text": F.when(F.col("h") != 0, text),
        "role": F.when(F.col("h") == 4, "user").when(F.col("h") != 0, F.col("role")),
    })
    twice = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(twice)).drop("copy", "h")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digests(edits: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id) from its edits, zeros and an empty hash where it has none.

    The SHA-256 of a repaired conversation is defined over its texts one behind the other, so a conversation streams
    through one task in order; the task holds one row and a letter per edit.
    """
    kind = ids.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {DIGEST}"
    types = ids.sparkSession.createDataFrame([], schema).toArrow().schema
    names = [f.name for f in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("conv", "conv_id", "edit", "fault", "turn", "role", "text", "new_role")]):
                if now is None or row[0] != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = Digest(row[0], row[1])
                now.add(*row[2:])
            if len(out) >= SLICE:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        if now is not None:
            out.append(now.row())
        yield pa.RecordBatch.from_pylist(out, schema=types)

    none = [F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("edit", "string"), ("fault", "string"), ("turn", "long"), ("role", "string"), ("text", "string"), ("new_role", "string"))]
    every = edits.unionByName(ids.select("conv_id").distinct().select("conv_id", *none))
    every = every.withColumn("conv", conversation_key(F.col("conv_id")))
    every = every.repartition(shuffle_parts(edits), "conv").sortWithinPartitions("conv", F.col("at").asc_nulls_first())
    return small_batches(every).mapInArrow(run, schema).select(*names)


class Digest:
    """What the edits of one conversation add up to."""

    def __init__(self, conv: str, conv_id):
        self.conv, self.conv_id, self.sha, self.audit = conv, conv_id, hashlib.sha256(), []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = self.texts = 0

    def add(self, edit, fault, turn, role, text, new_role) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if fault is not None:
            self.faults[fault] += 1
            self.cost += TRUNCATED if fault == "truncated" and edit != "D" else 0
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
        if new_role is not None:
            self.sha.update(f"{chr(10) if self.texts else ''}{new_role}:{text or ''}".encode())
            self.texts += 1

    def row(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation after damage and repair; an empty table has no rows."""
    hurt = damaged(conversations)
    return repair_digests(repair_conversations(hurt.where("not dropped")), conversations)


def _put(role: str, rest: str) -> str:
    """An insert in front of the rest of a repair (cost, audit, text)."""
    return f"{{'c': {rest}.c + {INSERT}, 'a': concat('I', {rest}.a), 't': concat(chr(10), '{role}:', {rest}.t)}}"


def _edit(letter: str, cost: str, rest: str, text: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'c': {rest}.c + {cost}, 'a': concat('{letter}', {rest}.a), 't': concat({text}, {rest}.t)}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_KEPT, _NEVER = "concat(chr(10), role, ':', text)", "{'c': 1000000000000::BIGINT, 'a': '', 't': ''}"
_USER, _ASSISTANT = "concat(chr(10), 'user:', text)", "concat(chr(10), 'assistant:', text)"
_D = [_edit("D", "2", x) for x in ("e0", "es", "eu", "ea")]
_R = [_edit("R", "1 + late", "ea" if i == 2 else "eu", _ASSISTANT if i == 2 else _USER, "NOT bad") for i in range(4)]
_K = {x: _edit("K", "late", f"e{x}", _KEPT, f"NOT bad AND initial = '{x}'") for x in "sua"}

#: a recursion from the last row to the first: for each state in front of a row the least (cost, audit, text) of the rest
SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations, crc_table
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS core FROM hurt
), marked AS (
  SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    core <> '' AND right(core, 1) NOT IN ('.', '!', '?') AS open, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), rows AS (
  SELECT *, blank OR again AS bad, CASE WHEN open THEN 5 ELSE 0 END AS late FROM marked
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again) AS duplicate, count(*) FILTER (open AND NOT again) AS truncated,
    count(*) FILTER (concat(before, initial) NOT IN ('su', 'ua', 'au') AND i > 1) AS illegal, max(i) AS n FROM rows GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e0, {_NEVER} AS es,
    {_put("assistant", "{'c': 0::BIGINT, 'a': '', 't': ''}")} AS eu, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS ea FROM told
  UNION ALL
  SELECT conv_id, i, {_least("b0", _put("user", "eu"))} AS e0, {_least("bs", _put("user", "eu"))} AS es, eu, {_least("ba", _put("user", "bu"))} AS ea
  FROM (SELECT conv_id, i, b0, bs, bu, ba, {_least("bu", _put("assistant", "ba"))} AS eu
    FROM (SELECT w.conv_id, w.i - 1 AS i, {_least(_D[0], _R[0], _K["s"], _K["u"])} AS b0, {_least(_D[1], _R[1], _K["u"])} AS bs,
        {_least(_D[2], _R[2], _K["a"])} AS bu, {_least(_D[3], _R[3], _K["u"])} AS ba
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i))
), found AS (
  SELECT conv_id, e0 FROM walk WHERE i = 0
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e0.c, 0) AS cost, coalesce(e0.a, '') AS audit,
  sha256(coalesce(substr(e0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""
