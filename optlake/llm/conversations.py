"""Repair of conversation structure by a run-length dynamic program.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Rows are kept,
given another role, deleted, or empty rows are inserted, at the least cost. A row is a
symbol: its initial and its fault. Equal consecutive symbols are one run. A symbol's step
is a 4 x 4 min-plus matrix over the places of the pattern (inserts included), and a run of
n rows is n steps, taken through the binary powers of the matrix, which are made once a
task. Going back over the runs gives the cost that is left from every place; going forward,
each run is unrolled by halves through the same powers, and in every place the first edit
by letter that keeps to the least cost is taken.

Faults are found in Spark: repeated rows by the first turn of each (conversation, role,
text), with digests in place of texts. Then rows are dealt by conversation and sorted, and
a task streams over them: of a conversation it holds its runs and one letter a row, which
is the audit. The hash of the repaired rows needs them in order, so they are sorted a second
time behind their audit and streamed through the hash batch by batch. A conversation of any
length thus takes one task's time, as its one hash demands, but not its memory.

Defined cases: a null role or text is one space, and in the key of a row's damage a null id
or turn is one; rows without an id are one conversation; null turns come first; rows of one
turn follow role and text; of equal rows the first is no duplicate; a conversation of which
nothing is left gives zeros, an empty audit and the hash of nothing; very long texts pass in
batches; an empty table gives an empty one; columns not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.llm.common import bucket_of, stored

#: The cost of each edit, and of a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places in the pattern: start, after s, after u, after a; the place each initial leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}


def product(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two matrices, or of a matrix and a column."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(len(b[0]))) for row in a)


def inserts() -> tuple:
    """Least cost of inserts from place to place."""
    cost = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for _ in range(4):
        for i in range(4):
            for j in range(4):
                for role in ROLES:
                    if role in NEXT[j]:
                        k = NEXT[j][role]
                        cost[i][k] = min(cost[i][k], cost[i][j] + INSERT)
    return tuple(map(tuple, cost))


INSERTS = inserts()
END = product(INSERTS, ((0,), (NEVER,), (NEVER,), (0,)))


def edits(symbol: str, place: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, place after) of the edits of a row, in order of their letters. A
    symbol is an initial and a fault: blank, duplicate, truncated or "-"."""
    initial, fault = symbol
    yield "D", DELETE, place
    if fault in "bd":
        return
    stay = TRUNCATED if fault == "t" else 0
    if initial in NEXT[place]:
        yield "K", stay, NEXT[place][initial]
    for role in sorted(ROLES):
        if role in NEXT[place] and role != initial:
            yield "R", stay + RENAME, NEXT[place][role]


class Steps:
    """Binary powers of the step of each symbol, made when first asked for."""

    def __init__(self):
        self.powers: dict[str, list] = {}

    def power(self, symbol: str, k: int) -> tuple:
        found = self.powers.setdefault(symbol, [])
        if not found:
            step = [[NEVER] * 4 for _ in range(4)]
            for i in range(4):
                for _, cost, j in edits(symbol, i):
                    step[i][j] = min(step[i][j], cost)
            found.append(product(INSERTS, tuple(map(tuple, step))))
        while len(found) <= k:
            found.append(product(found[-1], found[-1]))
        return found[k]

    def back(self, symbol: str, n: int, left: tuple) -> tuple:
        """Cost left from each place before ``n`` rows, given that after them."""
        for k in range(n.bit_length()):
            if n >> k & 1:
                left = product(self.power(symbol, k), left)
        return left

    def unroll(self, symbol: str, n: int, left: tuple, place: int) -> tuple[list[str], int]:
        """Edits of ``n`` rows from ``place``, and the place after them."""
        if n == 1:
            best = product(self.power(symbol, 0), left)[place][0]
            letters = []
            while True:
                for letter, cost, after in edits(symbol, place):
                    if letter == "D" and cost + left[after][0] == best:
                        return [*letters, letter], after
                role = next((r for r in ROLES if r in NEXT[place]))
                after = NEXT[place][role]
                if INSERT + product(self.power(symbol, 0), left)[after][0] == best:
                    letters, place, best = [*letters, "I"], after, best - INSERT
                    continue
                for letter, cost, after in edits(symbol, place):
                    if cost + left[after][0] == best:
                        return [*letters, letter], after
        half = n // 2
        first, place = self.unroll(symbol, half, self.back(symbol, n - half, left), place)
        second, place = self.unroll(symbol, n - half, left, place)
        return first + second, place

    def repair(self, runs: list[tuple[str, int]]) -> tuple[int, str]:
        """Least cost and the first audit of that cost."""
        left = [END]
        for symbol, n in reversed(runs):
            left.append(self.back(symbol, n, left[-1]))
        cost, place, audit = left[-1][0][0], 0, []
        for (symbol, n), after in zip(runs, left[-2::-1]):
            letters, place = self.unroll(symbol, n, after, place)
            audit += letters
        audit += "I" * (END[place][0] // INSERT)
        return cost, "".join(audit)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the damage leaves them; a dropped row
    has no copies."""
    blank = F.lit(" ")
    named = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = bucket_of(key, 20)
    rows = named.withColumn("_kind", kind)
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def whole(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as they are, nulls as one space."""
    blank = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(1).alias("copies"))


def _after(turn: Column, first: Column) -> Column:
    """Whether ``turn`` comes after ``first``, nulls before all others."""
    return F.when(first.isNull(), turn.isNotNull()).otherwise(turn > first)


def _flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault`` ("b", "t" or "-") and ``again``: an earlier turn of the
    conversation has the same role and text."""
    digest = F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("_digest", digest)
    said = rows.where("copies > 0").groupBy("conv_id", "_digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))).alias("_first"), F.count("*").alias("_n"))
    said = said.where("_n > 1").select(F.col("conv_id").alias("_id"), F.col("_digest").alias("_said"), F.col("_first.turn").alias("_turn"))
    marked = rows.join(said, (F.col("conv_id").eqNullSafe(F.col("_id"))) & (F.col("_digest") == F.col("_said")), "left")
    last = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(last == "", "b").when(F.substring(last, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    again = F.col("_said").isNotNull() & _after(F.col("turn"), F.col("_turn"))
    return marked.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), again.alias("again"))


def _dealt(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _audits(batches):
    """Counts, cost and audit of each conversation from its sorted rows."""
    steps, out = Steps(), []
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def closed(state):
        cost, audit = steps.repair(state["runs"])
        turns = state["turns"]
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return [state["id"], gaps, *(state["count"][f] for f in "bdt"), state["illegal"], cost, audit]

    def packed():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names=names)

    state, ids = None, None
    for batch in batches:
        ids = batch.schema.field("conv_id").type
        for conv, turn, role, text, copies, fault, again in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state["id"] != conv:
                if state:
                    out.append(closed(state))
                    if len(out) == 1000:
                        yield packed()
                state = {"id": conv, "runs": [], "count": dict.fromkeys("bdt-", 0), "illegal": 0, "last": None, "turns": None, "row": None}
            for _ in range(copies):
                row = (turn, role, text)
                kind = "d" if fault != "b" and (again or row == state["row"]) else fault
                state["row"] = row
                state["count"][kind] += 1
                pair = (state["last"], role[:1])
                state["illegal"] += state["last"] is not None and "".join(pair) not in ("su", "ua", "au")
                state["last"] = role[:1]
                if turn is not None:
                    low, high, n = state["turns"] or (turn, None, 0)
                    state["turns"] = (low, turn, n + (turn != high))
                symbol = (role[:1] if role[:1] in ("s", "u", "a") else "-") + kind
                runs = state["runs"]
                if runs and runs[-1][0] == symbol:
                    runs[-1] = (symbol, runs[-1][1] + 1)
                else:
                    runs.append((symbol, 1))
    if state:
        out.append(closed(state))
    if out:
        yield packed()


def _repaired(audit: str) -> Iterator[tuple[str, str | None]]:
    """(letter, role) of each edit; the role is null for deleted rows."""
    size = len(audit) - audit.count("D")
    kept = 0
    for letter in audit:
        if letter == "D":
            yield letter, None
        else:
            first = kept == 0 and size % 2 == 1
            yield letter, "s" if first else "ua"[(kept - size % 2) % 2]
            kept += 1


def _hashes(batches):
    """The hash of each conversation's repaired rows, which follow their audit."""
    digest, conv, plan, none, ids, out = None, None, None, True, None, []

    def flush_inserts(edit):
        while edit and edit[0] == "I":
            put(ROLES[edit[1]], "")
            edit = next(plan, None)
        return edit

    def put(role, text):
        nonlocal none
        digest.update((("" if none else "\n") + role + ":" + text).encode())
        none = False

    def closed():
        flush_inserts(edit)
        return conv, digest.hexdigest()

    def packed():
        a, b = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, pa.string())], names=["conv_id", "repaired_sha256"])

    edit = None
    for batch in batches:
        ids = batch.schema.field("conv_id").type
        for c, audit, role, text, copies in zip(*(x.to_pylist() for x in batch.columns)):
            if audit is not None:
                if digest:
                    out.append(closed())
                    if len(out) == 1000:
                        yield packed()
                digest, conv, none, plan = hashlib.sha256(), c, True, _repaired(audit)
                edit = next(plan, None)
                continue
            for _ in range(copies):
                letter, initial = edit = flush_inserts(edit)
                if letter != "D":
                    put(role if letter == "K" else ROLES[initial], text)
                edit = next(plan, None)
    if digest:
        out.append(closed())
    if out:
        yield packed()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, copies): its faults,
    the least cost, the audit, and the hash of what the audit makes of it."""
    turn = F.col("turn").asc_nulls_first()
    kind = dict(rows.dtypes)["conv_id"]
    flagged = _dealt(_flagged(rows), turn, F.col("role"), F.col("text"))
    audits = stored(flagged.mapInArrow(_audits, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    none = F.lit(None).cast("string")
    heads = audits.select("conv_id", "audit", none.alias("role"), none.alias("text"), F.lit(0).alias("copies"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"))
    body = rows.where("copies > 0").select("conv_id", none.alias("audit"), "role", "text", "copies", "turn")
    behind = _dealt(heads.unionAll(body), F.col("audit").isNull(), turn, F.col("role"), F.col("text"))
    hashes = behind.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_hashes, f"conv_id {kind}, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv_id", "_id")
    return audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
