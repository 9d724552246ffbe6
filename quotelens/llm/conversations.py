"""Conversation structure repair by a cost DP and prefix-doubling path ranking.

The rows of a conversation are kept, given another role, deleted, or rows are inserted, until the roles' initials read
`(s?(ua)+)?`. A node is a place between rows and the state of that pattern. After the cost DP the nodes of cheapest edits are
ranked by their audits of 1, 2, 4, ... letters; the ranks select the least edit at each node, and pointers doubled over
these edits spell the audit.

Rows are sorted by range, so a conversation of any size spreads over tasks. A conversation that lies inside one task is
repaired there; one that reaches a task's first or last row, or is large, is cut into pieces: their cost matrices are
chained, then every piece is solved by itself from the costs behind it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .ship import ship
from .work import stored

# fixed values: roles, letters of edits in ASCII order, costs
ROLES = {2: "user", 3: "assistant"}
LETTERS = np.frombuffer(b" DIKR", np.uint8)
RETURN, DELETE, INSERT, KEEP, REROLE = range(5)
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
# states: nothing yet, after s, after u, after a; the state that an inserted or changed role leads to
NEXT = np.array([2, 2, 3, 2])
INITIALS = {"s": 1, "u": 2, "a": 3}
# the state that keeping a row of an initial (other, s, u, a) leads to, or -1
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
LEGAL = {(1, 2), (2, 3), (3, 2)}
FAR = 1 << 40
AT_END = np.array([0, FAR, FAR, 0])
EMPTY = hashlib.sha256(b"").hexdigest()

PIECE_BITS = 16  # a piece has at most 2**PIECE_BITS rows
SOLVE_ROWS = 20_000  # about as many rows are solved at once


def relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs [.., state] once rows may be inserted before going on."""
    user = np.minimum(cost[:, 2], INSERT_COST + cost[:, 3])
    answer = np.minimum(cost[:, 3], INSERT_COST + cost[:, 2])
    return np.stack([np.minimum(cost[:, 0], INSERT_COST + user), np.minimum(cost[:, 1], INSERT_COST + user), user, answer], axis=1)


class Lattice:
    """Cheapest edits of many pieces at once.

    `initial` and `fault` are the rows' codes, `begin` the pieces' offsets (one more for the end), `after` [piece, state] the
    costs behind a piece, `last` whether rows may be inserted at its end.
    """

    def __init__(self, initial: np.ndarray, fault: np.ndarray, begin: np.ndarray, after: np.ndarray, last: np.ndarray):
        n, self.pieces = np.diff(begin), len(begin) - 1
        self.first = begin[:-1] + np.arange(self.pieces)  # layer of each piece's begin
        end = self.first + n
        self.cost = np.full((len(initial) + self.pieces, 4), FAR, np.int64)
        self.cost[end] = np.where(last[:, None], relaxed(after), after)
        free, extra = (fault != BLANK) & (fault != DUPLICATE), np.where(fault == TRUNCATED, TRUNCATED_COST, 0)
        order = np.argsort(-n, kind="stable")
        live = np.searchsorted(-n[order], -np.arange(1, n.max(initial=0) + 1), "right")
        for back, m in enumerate(live.tolist(), 1):  # all pieces of at least `back` rows
            p = order[:m]
            layer, row = end[p] - back, begin[p + 1] - back
            self.cost[layer] = relaxed(self.edits(self.cost[layer + 1], initial[row], free[row], extra[row])[0].min(axis=2))
        self.arcs(initial, free, extra, begin, end, after, last)

    @staticmethod
    def edits(ahead: np.ndarray, initial: np.ndarray, free: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost [row, state, edit] of deleting, keeping and changing a row, and the state it leads to."""
        kept = KEPT[:, initial].T
        to = np.stack([np.broadcast_to(np.arange(4), kept.shape), np.maximum(kept, 0), np.broadcast_to(NEXT, kept.shape)], axis=2)
        cost = np.take_along_axis(np.broadcast_to(ahead[:, :, None], to.shape), to, axis=1)
        cost = cost + np.stack([np.full(len(free), DELETE_COST), extra, extra + REROLE_COST], axis=1)[:, None, :]
        cost[:, :, 1][kept < 0] = FAR
        cost[:, :, 1:][~free] = FAR
        return cost, to

    def arcs(self, initial, free, extra, begin, end, after, last):
        """Targets [node, letter] of all cheapest edits, -1 for none. A node is 4 * layer + state."""
        layers = len(self.cost)
        at = np.setdiff1d(np.arange(layers), end, assume_unique=True)  # one layer in front of each row
        target = np.full((layers, 4, 5), -1, np.int64)
        cost, to = self.edits(self.cost[at + 1], initial, free, extra)
        best = (cost == self.cost[at][:, :, None]) & (cost < FAR)
        for k, letter in enumerate((DELETE, KEEP, REROLE)):
            target[at, :, letter] = np.where(best[:, :, k], 4 * (at + 1)[:, None] + to[:, :, k], -1)
        may = np.ones(layers, bool)
        may[end] = last
        insert = (INSERT_COST + self.cost[:, NEXT] == self.cost) & may[:, None] & (self.cost < FAR)
        target[:, :, INSERT] = np.where(insert, 4 * np.arange(layers)[:, None] + NEXT, -1)
        stop = self.cost[end] == after  # the piece ends here
        target[end, :, INSERT] = np.where(stop, -1, target[end, :, INSERT])
        self.target = target.reshape(-1, 5)

    def ranked(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(letter of each node's edit on its least path, 0 where the path ends, pointers over 1, 2, 4 ... of these edits).

        Round k ranks the nodes by their least audits of 2**k letters. A node has at most one cheapest edit of a letter, so an
        audit fixes the node it leads to, and its rank with that node's rank gives the rank of twice the length.
        """
        nodes = np.arange(len(self.target))
        known = self.target >= 0
        letter = np.where(known.any(axis=1), known.argmax(axis=1), RETURN)
        jump = np.where(letter > 0, self.target[nodes, letter], nodes)
        rank = letter
        while (jump[jump] != jump).any():
            rank = np.unique(rank * np.int64(len(nodes) + 5) + rank[jump], return_inverse=True)[1]
            jump = jump[jump]
        rank = np.unique(rank * np.int64(len(nodes) + 5) + rank[jump], return_inverse=True)[1]
        # the least audit begins with the edit of least letter and, behind it, least rank
        value = np.where(known, np.arange(5) * np.int64(len(nodes) + 1) + rank[self.target], np.iinfo(np.int64).max)
        letter = np.where(known.any(axis=1), value.argmin(axis=1), RETURN)
        doubled = [np.where(letter > 0, self.target[nodes, letter], nodes)]
        while (doubled[-1][doubled[-1]] != doubled[-1]).any():
            doubled.append(doubled[-1][doubled[-1]])
        return letter, doubled

    def audits(self, start: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audit from each of the nodes `start`, and the state it ends in."""
        letter, doubled = self.ranked()
        owner, step, node = np.arange(len(start)), np.zeros(len(start), np.int64), start
        on = letter[node] > 0
        owner, step, node = owner[on], step[on], node[on]
        for k, jump in enumerate(doubled):
            ahead = jump[node]
            on = letter[ahead] > 0
            owner, step, node = np.append(owner, owner[on]), np.append(step, step[on] + (1 << k)), np.append(node, ahead[on])
        order = np.lexsort((step, owner))
        text = LETTERS[letter[node[order]]].tobytes().decode()
        ends = np.cumsum(np.bincount(owner, minlength=len(start))).tolist()
        return [text[x:y] for x, y in zip([0, *ends], ends, strict=False)], doubled[-1][doubled[-1]][start] & 3


def codes(roles: list[str], texts: list[str]) -> tuple[list[int], list[int]]:
    """Initial and fault of each row; duplicates are not known here."""
    ends = [t.rstrip(SPACE)[-1:] for t in texts]
    return [INITIALS.get(r[:1], 0) for r in roles], [BLANK if not e else 0 if e in ".!?" else TRUNCATED for e in ends]


def illegal(initial: list[int]) -> int:
    return sum(p not in LEGAL for p in zip(initial, initial[1:], strict=False))


def repaired(audit: str, rows):
    """(edit, role, text) of each row after the edits; `rows` gives (role, text) and is read as far as the audit goes."""
    state, rows = 0, iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = int(KEPT[state, INITIALS.get(role[:1], 0)] if edit == "K" else NEXT[state])
        yield edit, role if edit == "K" else ROLES[state], text


def digest(rows) -> str:
    """SHA-256 of the rows' `role:text`, one a line."""
    sha, sep = hashlib.sha256(), ""
    for _, role, text in rows:
        sha.update(f"{sep}{role}:{text}".encode("utf-8", "surrogatepass"))
        sep = "\n"
    return sha.hexdigest()


def gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


REPORT = StructType([StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                    + [StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
TURN = StructType([StructField("place", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType())])
OPEN = StructType([StructField("__at", LongType()), StructField("__turn", LongType()), StructField("__role", StringType()), StructField("__text", StringType()),
                   StructField("__same", StringType()), StructField("__gone", BooleanType()), StructField("__initial", IntegerType()), StructField("__fault", IntegerType())])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`rows` with faults put in by crc32(`conv:turn`) % 20, and the column `gone` for dropped rows.

    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 sets the role user. Null keys, roles and texts
    count as one space.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    own = F.coalesce(F.col(text), space)
    made = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(own, ".!?", "")).otherwise(own).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return made.drop("copy")


def sorted_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """(conv, __conv, OPEN without codes), sorted by range over all tasks; `__at` is the place in that order."""
    space = F.lit(" ")
    name = F.when(F.col(conv).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(conv).cast("string")))  # never null
    flat = rows.select(
        F.col(conv).alias("__id"), name.alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.coalesce(F.col(role), space).alias("__role"),
        F.coalesce(F.col(text), space).alias("__text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("__gone"))
    flat = flat.withColumn("__same", F.sha2(F.concat(F.length("__role").cast("string"), F.lit(":"), "__role", "__text"), 256))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__conv", "__turn", "__role", "__same"]
    return flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())


def solved_in_place(rows: DataFrame, turns: bool) -> DataFrame:
    """(__id, __conv, what is asked for, OPEN): results of conversations inside one task, and the rows of all others."""
    asked = TURN if turns else REPORT
    out = StructType([rows.schema["__id"], rows.schema["__conv"], *asked, *OPEN])
    arrow = to_arrow_schema(out)
    names = out.names
    source = rows.select("__id", "__conv", *OPEN.names[:6])

    def results(held: list[list[tuple]]):
        """Rows of the conversations `held`, lists of (__id, __conv, __at, __turn, __role, __text, __same, __gone)."""
        live = [[r for r in c if not r[7]] for c in held]
        coded = []
        for c in live:
            initial, fault = codes([r[4] for r in c], [r[5] for r in c])
            seen: set[str] = set()
            for i, r in enumerate(c):
                if fault[i] != BLANK and r[6] in seen:
                    fault[i] = DUPLICATE
                seen.add(r[6])
            coded.append((initial, fault))
        begin = np.concatenate([[0], np.cumsum([len(c) for c in live])])
        lattice = Lattice(np.array([x for i, _ in coded for x in i], np.int64), np.array([x for _, f in coded for x in f], np.int64), begin,
                          np.tile(AT_END, (len(live), 1)), np.ones(len(live), bool))
        audits, _ = lattice.audits(4 * lattice.first)
        cost = lattice.cost[lattice.first, 0].tolist()
        for whole, c, (initial, fault), audit, price in zip(held, live, coded, audits, cost, strict=True):
            head = whole[0][:2]
            after = repaired(audit, ((r[4], r[5]) for r in c))
            if turns:
                yield from ((*head, place, *row) for place, row in enumerate(after))
            else:
                yield (*head, gaps([r[3] for r in c]), fault.count(BLANK), fault.count(DUPLICATE), fault.count(TRUNCATED), illegal(initial), price, audit, digest(after))

    def table(rows: list[tuple], start: int) -> pa.RecordBatch:
        """Rows as a batch; they hold __id, __conv and the columns from `start` on."""
        cols = list(zip(*rows, strict=True))
        made = [pa.array(cols[i], arrow.field(i).type) for i in range(2)]
        for i in range(2, len(names)):
            k = i - start + 2
            made.append(pa.array(cols[k], arrow.field(i).type) if 2 <= k < len(cols) else pa.nulls(len(rows), arrow.field(i).type))
        return pa.RecordBatch.from_arrays(made, schema=arrow)

    def as_open(rows: list[tuple]) -> pa.RecordBatch:
        initial, fault = codes([r[4] for r in rows], [r[5] for r in rows])
        return table([(*r, i, f) for r, i, f in zip(rows, initial, fault, strict=True)], 2 + len(asked))

    def run(batches):
        ready, size, held, spread = [], 0, [], True  # spread: the conversation in hand goes on as rows
        now = None
        for batch in batches:
            loose = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if row[1] != now:
                    if held:
                        ready.append(held)
                        size += len(held)
                    held, spread, now = [], now is None, row[1]
                held.append(row)
                if spread or len(held) > 1 << PIECE_BITS:
                    spread = True
                    loose += held
                    held = []
            if loose:
                yield as_open(loose)
            if size > SOLVE_ROWS:
                yield table(list(results(ready)), 2)
                ready, size = [], 0
        if ready:
            done = list(results(ready))
            if done:
                yield table(done, 2)
        if held:
            yield as_open(held)

    return source.mapInArrow(run, out)


def pieces_of(live: DataFrame) -> DataFrame:
    """(__conv, __piece, __at, __initial, __fault) of the rows of spread conversations; here repeated rows become known."""
    first = live.groupBy("__conv", "__same").agg(F.min("__at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when((F.col("__fault") != BLANK) & (F.col("__at") > F.col("first")), DUPLICATE).otherwise(F.col("__fault"))
    return live.select("__conv", "__same", "__at", "__initial", "__fault").join(first, ["__conv", "__same"], "left").select(
        "__conv", F.shiftright("__at", PIECE_BITS).alias("__piece"), "__at", "__initial", fault.alias("__fault"))


def as_codes(piece: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    piece = piece.sort_by("__at")
    return tuple(piece.column(c).to_numpy().astype(np.int64) for c in ("__initial", "__fault"))


def piece_costs(piece: pa.Table) -> pa.Table:
    """Costs [state before, state behind] of a piece as 16 numbers, with its faults and its ends' initials."""
    initial, fault = as_codes(piece)
    n = len(initial)
    lattice = Lattice(np.tile(initial, 4), np.tile(fault, 4), np.arange(5) * n, np.where(np.eye(4, dtype=bool), 0, FAR), np.zeros(4, bool))
    costs = lattice.cost[lattice.first].T.ravel().tolist()
    found = np.bincount(fault, minlength=4).tolist()
    return pa.table({"__conv": [piece.column("__conv")[0].as_py()], "__piece": pa.array([piece.column("__piece")[0].as_py()], pa.int64()),
                     "costs": pa.array([costs], pa.list_(pa.int64())), "found": pa.array([[*found[1:], illegal(initial.tolist()), int(initial[0]), int(initial[-1])]], pa.list_(pa.int64()))})


PIECE_COSTS = "__conv string, __piece long, costs array<long>, found array<long>"


def chained(pieces: pa.Table) -> pa.Table:
    """The costs behind each piece of a conversation, and the conversation's totals."""
    pieces = pieces.sort_by("__piece")
    found = np.array(pieces.column("found").to_pylist(), np.int64)
    costs = np.array(pieces.column("costs").to_pylist(), np.int64).reshape(-1, 4, 4)
    after = np.empty((len(costs) + 1, 4), np.int64)
    after[-1] = relaxed(AT_END[None, :])[0]
    for i in range(len(costs) - 1, -1, -1):
        after[i] = np.minimum((costs[i] + after[i + 1][None, :]).min(axis=1), FAR)
    across = sum(p not in LEGAL for p in zip(found[:-1, 5].tolist(), found[1:, 4].tolist(), strict=True))
    total = [*found[:, :3].sum(axis=0).tolist(), int(found[:, 3].sum()) + across, int(after[0, 0])]
    n = len(costs)
    last = np.arange(n) == n - 1
    behind = np.where(last[:, None], AT_END, after[1:])
    return pa.table({"__conv": pieces.column("__conv"), "__piece": pieces.column("__piece"), "after": pa.array(behind.tolist(), pa.list_(pa.int64())), "last": pa.array(last),
                     "total": pa.array([total] * n, pa.list_(pa.int64()))})


CHAINED = "__conv string, __piece long, after array<long>, last boolean, total array<long>"


def piece_audits(piece: pa.Table, behind: pa.Table) -> pa.Table:
    """Audit and last state of a piece for each state before it."""
    initial, fault = as_codes(piece)
    lattice = Lattice(initial, fault, np.array([0, len(initial)]), np.array(behind.column("after").to_pylist(), np.int64), np.array(behind.column("last").to_pylist()))
    audits, ends = lattice.audits(np.arange(4))
    return pa.table({"__conv": behind.column("__conv"), "__piece": behind.column("__piece"), "audits": pa.array([audits], pa.list_(pa.string())),
                     "ends": pa.array([ends.tolist()], pa.list_(pa.int64())), "total": behind.column("total")})


PIECE_AUDITS = "__conv string, __piece long, audits array<string>, ends array<long>, total array<long>"


def whole_audit(pieces: pa.Table) -> pa.Table:
    pieces = pieces.sort_by("__piece")
    state, out = 0, []
    for audits, ends in zip(pieces.column("audits").to_pylist(), pieces.column("ends").to_pylist(), strict=True):
        out.append(audits[state])
        state = ends[state]
    total = pieces.column("total")[0].as_py()
    return pa.table({"__conv": [pieces.column("__conv")[0].as_py()], "audit": ["".join(out)],
                     **{n: pa.array([v], pa.int64()) for n, v in zip(("blank", "duplicate", "truncated", "illegal", "cost"), total, strict=True)}})


AUDITS = "__conv string, audit string, blank long, duplicate long, truncated long, illegal long, cost long"


def spread_audits(live: DataFrame) -> DataFrame:
    """AUDITS of the conversations that are spread over tasks. No task sees more than a piece, or some numbers of each piece."""
    rows = stored(pieces_of(live), "conversation-pieces")
    by_piece = rows.groupBy("__conv", "__piece")
    behind = by_piece.applyInArrow(piece_costs, PIECE_COSTS).groupBy("__conv").applyInArrow(chained, CHAINED)
    made = by_piece.cogroup(behind.groupBy("__conv", "__piece")).applyInArrow(piece_audits, PIECE_AUDITS)
    return stored(made.groupBy("__conv").applyInArrow(whole_audit, AUDITS), "conversation-audits")


def in_stream(live: DataFrame, audits: DataFrame, turns: bool) -> DataFrame:
    """(__conv, repaired_sha256), or (__conv, TURN), of spread conversations.

    A conversation's audit comes in front of its rows, which are read once in order and not held. SHA-256 has to read a
    conversation in order in one task.
    """
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = audits.select("__conv", F.lit(-1).cast("long").alias("__at"), F.lit("").alias("__role"), F.col("audit").alias("__text"))
    source = front.unionByName(live.select("__conv", "__at", "__role", "__text")).repartition(parts, "__conv").sortWithinPartitions("__conv", "__at")
    out = StructType([StructField("__conv", StringType()), *(TURN if turns else [REPORT["repaired_sha256"]])])
    arrow = to_arrow_schema(out)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        for conv, _, _, audit in rows:  # the audit's edits read exactly the conversation's rows
            after = repaired(audit, ((r[2], r[3]) for r in rows))
            made = ((conv, place, *r) for place, r in enumerate(after)) if turns else iter([(conv, digest(after))])
            while part := [r for _, r in zip(range(1000), made)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, out)


def _parts(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None, turns: bool):
    ship(rows.sparkSession)
    first = stored(solved_in_place(sorted_rows(rows, conv, turn, role, text, gone), turns), "conversations")
    spread = first.where("__at IS NOT NULL")
    live = spread.where(~F.col("__gone"))
    return first.where("__at IS NULL"), spread, live, spread_audits(live)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(conv, REPORT): one row for each conversation, also for one of which all rows are `gone`.

    Rows stand by turn, nulls first; rows of one turn by role and then by a digest of role and text. A null role or text counts
    as one space, a null conversation is one of its own. Each row's first fault counts: blank (nothing visible), duplicate
    (role and text seen earlier in the conversation), truncated (last visible character not `[.!?]`). `gaps` counts the turns
    missing between the least and the greatest, nulls left out. `illegal` counts neighbours whose initials are not su, ua or au.
    The audit is the cheapest edits' initials (Keep 0, Rerole 2, Delete 3 and the only one for blank and duplicate rows,
    Insert 2, one more for a truncated row that stays), the ASCII-least of equal cost. A conversation without rows has
    zeros, an empty audit and the digest of the empty string. Columns of other names are not read. An empty table gives an
    empty result.
    """
    closed, spread, live, audits = _parts(rows, conv, turn, role, text, gone, False)
    every = spread.groupBy("__conv").agg(F.first("__id").alias("__id"))
    turns = live.groupBy("__conv", "__turn").count().groupBy("__conv").agg((F.max("__turn") - F.min("__turn") + 1 - F.count("__turn")).alias("gaps"))
    named = every.join(audits, "__conv", "left").join(turns, "__conv", "left").join(in_stream(live, audits, False), "__conv", "left")
    filled = [F.coalesce(F.col(f.name), F.lit("" if f.name == "audit" else EMPTY if f.dataType == StringType() else 0)).cast(f.dataType).alias(f.name) for f in REPORT]
    return closed.select(F.col("__id").alias(conv), *REPORT.names).unionByName(named.select(F.col("__id").alias(conv), *filled))


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations in order, see `repair`."""
    closed, spread, live, audits = _parts(rows, conv, turn, role, text, gone, True)
    every = spread.groupBy("__conv").agg(F.first("__id").alias("__id"))
    return closed.select(F.col("__id").alias(conv), *TURN.names).unionByName(
        in_stream(live, audits, True).join(every, "__conv").select(F.col("__id").alias(conv), *TURN.names))
