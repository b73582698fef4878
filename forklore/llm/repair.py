"""Repair of the structure of conversations by the cheapest edits, found by iterative-deepening A*.

Each row of a conversation is kept, given another role or deleted, and rows may be inserted, so that the initials of the
roles read ``(s?(ua)+)?``. A depth-first search tries edits in ASCII order (D, I, K, R) within a bound on the cost; what is
left to pay is estimated from below by the least cost of each row to come. While no path is accepted the bound rises to the least
estimate that exceeded it. A state that failed is kept with the budget it failed with, from bound to bound. So
the first accepted path is the cheapest, and the ASCII-least of the cheapest.

Conversations are searched in blocks of rows, so that neither memory nor the depth of the search grows with a
conversation. A block is searched for the cheapest way to each state behind it; sums of these, from the last block to the
first, give what each state costs to the end (:func:`costs_to_end`); with them the blocks are walked from the first one on. A
path through a block never continues another one, so the ASCII-least path is ASCII-least in each block. Only
conversations of more than a block need the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forklore.llm.common import BLANKS, rank_within, shuffle_partitions
from forklore.session import materialize, materialize_counted

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
# States: nothing emitted yet, behind s, behind u, behind a. An initial that is missing is not accepted.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
ROLES = {"u": "user", "a": "assistant"}
END = [0, None, None, 0]  # what each state pays at the end; None: not accepted there
ILLEGAL = ("su", "ua", "au")


class Search:
    """The cheapest edits of ``rows`` (role initial, fault or None) that pay ``ahead[state]`` behind the last one.

    Where ``last`` is set, rows may be inserted behind the last one as well.
    """

    def __init__(self, rows: list[tuple[str, str | None]], ahead: list[int | None], last: bool):
        self.rows, self.ahead, self.last = rows, ahead, last
        self.failed: dict[tuple[int, int], int] = {}
        self.floor = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            initial, fault = rows[i]
            least = DELETE if fault else KEEP if initial in "sua" else REROLE
            self.floor[i] = self.floor[i + 1] + least
        # all rows deleted and two inserted, or the state is out of reach
        self.most = DELETE * len(rows) + 3 * INSERT + max([a for a in ahead if a is not None], default=0)

    def need(self, at: int, state: int) -> int:
        return max(self.floor[at], self.failed.get((at, state), -1) + 1)

    def moves(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: letter, cost, next row, next state."""
        here = at < len(self.rows)
        if here:
            initial, fault = self.rows[at]
            yield "D", DELETE, at + 1, state
        if here or self.last:
            for letter in ROLES:
                if letter in NEXT[state]:
                    yield "I", INSERT, at, NEXT[state][letter]
        if here and fault not in ("blank", "duplicate"):
            extra = CUT if fault else 0
            if initial in NEXT[state]:
                yield "K", KEEP + extra, at + 1, NEXT[state][initial]
            for letter in ROLES:
                if letter in NEXT[state]:
                    yield "R", REROLE + extra, at + 1, NEXT[state][letter]

    def within(self, entry: int, bound: int) -> tuple[str, int] | int | None:
        """Edits and exit state of a path of at most ``bound``; else the next bound, None for none."""
        over = None
        path: list[str] = []
        stack = [(0, entry, bound, self.moves(0, entry))]
        if self.need(0, entry) > bound:
            return self.need(0, entry)
        while stack:
            at, state, left, moves = stack[-1]
            if at == len(self.rows) and self.ahead[state] is not None:
                if self.ahead[state] <= left:
                    return "".join(path), state
                over = min(x for x in (over, bound - left + self.ahead[state]) if x is not None)
            for letter, cost, at_next, to in moves:
                total = bound - left + cost + self.need(at_next, to)
                if total <= bound:
                    path.append(letter)
                    stack.append((at_next, to, left - cost, self.moves(at_next, to)))
                    break
                over = total if over is None else min(over, total)
            else:
                self.failed[at, state] = max(left, self.failed.get((at, state), -1))
                stack.pop()
                if path:
                    path.pop()
        return over

    def run(self, entry: int) -> tuple[int, str, int] | None:
        """Cost (that ahead included), edits and exit state of the cheapest path; None if there is none."""
        bound = self.need(0, entry)
        while bound is not None and bound <= self.most:
            found = self.within(entry, bound)
            if isinstance(found, tuple):
                return bound, *found
            bound = found
        return None


def crossing(rows: list[tuple[str, str | None]]) -> list[int | None]:
    """Least cost from each state before ``rows`` to each state behind them, 16 numbers; None for no way.

    No state leads back to the first two: to be in them behind a block is to delete all rows, but for a kept s.
    """
    deleted = DELETE * len(rows)
    kept = [CUT if wrong else 0 for initial, wrong in rows if initial == "s" and wrong not in ("blank", "duplicate")]
    through = {(START, START): deleted, (SYSTEM, SYSTEM): deleted}
    if kept:
        through[START, SYSTEM] = deleted - DELETE + min(kept)
    for entry in STATES:
        for leave in (USER, ASSISTANT):
            through[entry, leave] = Search(rows, [0 if s == leave else None for s in STATES], last=False).run(entry)[0]
    return [through.get((entry, leave)) for entry in STATES for leave in STATES]


def _before(costs: list[int | None], ahead: list[int | None]) -> list[int | None]:
    """What each state before a block pays to the end, by the block's crossings and what is paid behind it."""
    return [
        min((c + a for c, a in zip(costs[4 * s : 4 * s + 4], ahead) if c is not None and a is not None), default=None)
        for s in STATES
    ]


def fault(text: Column, nth: Column) -> Column:
    """The first fault of a row, the ``nth`` of its role and text; null for none."""
    bare = F.btrim(text, F.lit(BLANKS))
    ended = F.right(bare, F.lit(1)).isin(*".!?")
    return F.when(bare == "", "blank").when(nth > 1, "duplicate").when(~ended, "truncated")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Add ``nth``, the number of a row among those of its role and text, and ``fault``; equal rows go by ``nth``."""
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "pos")
    return rows.withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault(F.col("text"), F.col("nth")))


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index("rows")).to_pylist()
        costs = [crossing([(r["initial"], r["fault"]) for r in block]) for block in rows]
        at = batch.schema.get_field_index("rows")
        yield batch.set_column(at, "costs", pa.array(costs, pa.list_(pa.int32())))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first of each conversation: ``ahead``, null behind the last one."""
    conv, costs, behind = object(), None, END
    for batch in batches:
        ahead = []
        for conv_id, block, own in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "costs"))):
            if conv_id != conv:
                conv, behind, first = conv_id, None, True
            ahead.append(behind)
            if first:  # rows may be inserted behind the last block: u needs one more, s two
                behind, first = [END[START], 2 * INSERT, INSERT, END[ASSISTANT]], False
            behind = _before(own, behind)
        at = batch.schema.get_field_index("costs")
        yield batch.set_column(at, "ahead", pa.array(ahead, pa.list_(pa.int32())))


def costs_to_end(rows: DataFrame, block: int) -> DataFrame:
    """``conv_id, block, ahead``: what each state pays behind each block; ``rows`` has ``pos, role, fault``.

    Blocks are searched apart from each other; then the blocks of a conversation pass one task, last to first, a few
    numbers each and one at a time.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    row = F.struct("pos", F.left("role", F.lit(1)).alias("initial"), "fault")
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # few bytes and much work: dealt to all tasks, whatever the bytes
    blocks = blocks.repartition(shuffle_partitions(rows.sparkSession), "conv_id", "block")
    crossed = blocks.mapInArrow(_crossings, f"conv_id {kind}, block long, costs array<int>")
    dealt = crossed.repartition(shuffle_partitions(rows.sparkSession), "conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.desc("block"))
    return dealt.mapInArrow(_sums, f"conv_id {kind}, block long, ahead array<int>")


EDIT = "step long, edit string, turn long, was string, role string, text string, fault string, cost long"


def _edits(block: int, schema: pa.Schema):
    """Rows of conversations, each in order, to their edits."""

    def apply(conv_id, state: int, step: int, rows: list[tuple], ahead: list | None) -> tuple[list[tuple], int]:
        search = Search([(r[1][:1], r[3]) for r in rows], END if ahead is None else ahead, last=ahead is None)
        _, path, _ = search.run(state)
        edits, coming = [], iter(rows)
        for letter in path:
            turn, was, text, wrong = (None, None, "", None) if letter == "I" else next(coming)
            role = was
            if letter in "IR":
                role = next(ROLES[x] for x in NEXT[state] if x in ROLES)
            if letter != "D":
                state = NEXT[state][role[:1]]
            cost = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter]
            cost += CUT if wrong == "truncated" and letter != "D" else 0
            edits.append((conv_id, step + len(edits), letter, turn, was, role, text, wrong, cost))
        return edits, state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(edits: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*edits), schema)], schema=schema)

        conv, state, step, number, ahead = None, START, 0, 0, None
        held: list[tuple] = []
        done: list[tuple] = []
        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "fault", "pos", "ahead")
            for conv_id, turn, role, text, wrong, pos, behind in zip(*(batch.column(n).to_pylist() for n in names)):
                now = 0 if pos is None else pos // block
                if held and (conv_id != conv or now != number):
                    edits, state = apply(conv, state, step, held, ahead)
                    done += edits
                    step += len(edits)
                    held = []
                    if len(done) > 4096:
                        yield packed(done)
                        done = []
                if conv_id != conv or not held and now == 0:
                    state, step = START, 0
                conv, number, ahead = conv_id, now, behind
                held.append((turn, role, text, wrong))
        if held:
            done += apply(conv, state, step, held, ahead)[0]
        if done:
            yield packed(done)

    return run


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cheapest edits that make each conversation ``(s?(ua)+)?``, by the initials of its roles.

    ``conversations`` has ``conv_id, turn, role, text``. One row per edit: ``conv_id, step`` (from 0), ``edit``
    (K keep, R other role, D delete, I insert), ``turn``, ``was`` (the role before), ``role``, ``text``, ``fault`` (blank, duplicate,
    truncated or null) and ``cost``. What is not deleted, in order of ``step``, is the repaired conversation. The rows
    of a conversation stand in one partition, next to each other and in order of ``step``.

    Rows are taken by turn, nulls first; rows of one turn by role and text, bytewise. A null role or text is one space, so
    blank, and no role that is accepted. A repeated row is a duplicate. Rows whose conv_id is null are one
    conversation. Other columns play no part. An empty table gives an empty result.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    long, n_long = materialize_counted(
        rows.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "long"
    )
    order = ["turn", "role", "text"]
    short = rows
    more = None
    if n_long:
        among = F.col("conv_id").eqNullSafe(F.col("_c"))
        short = rows.join(long, among, "left_anti")
        ranked = rank_within(rows.join(long, among, "left_semi"), ["conv_id"], order, "pos")
        ranked = materialize(ranked.withColumn("pos", F.col("pos") - 1), "ranked")
        ahead = materialize(costs_to_end(_with_faults(ranked), block), "ahead")
        ahead = ahead.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "ahead")
        at = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.floor(F.col("pos") / block) == F.col("_b"))
        more = ranked.join(ahead, at).drop("_c", "_b")
    rows = short.withColumn("pos", F.lit(None).cast("long")).withColumn("ahead", F.lit(None).cast("array<int>"))
    rows = rows if more is None else rows.unionByName(more)
    # one exchange: duplicates are counted inside the partition that holds the conversation
    dealt = _with_faults(rows.repartition(shuffle_partitions(spark), "conv_id"))
    dealt = dealt.sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in ("pos", *order, "nth")])
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = spark.createDataFrame([], f"conv_id {kind}, {EDIT}").schema
    return dealt.mapInArrow(_edits(block, _arrow(schema)), schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digests(schema: pa.Schema):
    """Edits as :func:`repair` gives them, conversation by conversation, to one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: dict | None = None

        def closed() -> tuple:
            gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
            numbers = [gaps, *(state[n] for n in NUMBERS[1:])]
            return (state["conv_id"], *numbers, "".join(state["audit"]), state["sha"].hexdigest())

        for batch in batches:
            names = ("conv_id", "step", "edit", "turn", "was", "role", "text", "fault", "cost")
            for conv_id, step, edit, turn, was, role, text, wrong, cost in zip(*(batch.column(n).to_pylist() for n in names)):
                if step == 0:
                    if state:
                        rows.append(closed())
                    state = {"conv_id": conv_id, "turns": 0, "first": None, "last": None, "was": None, "kept": 0}
                    state |= {"audit": [], "sha": hashlib.sha256(), **dict.fromkeys(NUMBERS[1:], 0)}
                state["audit"].append(edit)
                state["cost"] += cost
                if wrong:
                    state[wrong] += 1
                if edit != "I":
                    if state["was"] is not None and state["was"] + was[:1] not in ILLEGAL:
                        state["illegal"] += 1
                    state["was"] = was[:1]
                    if turn is not None and turn != state["last"]:
                        state["turns"] += 1
                        state["first"] = turn if state["first"] is None else state["first"]
                        state["last"] = turn
                if edit != "D":
                    line = f"{role}:{text}"
                    state["sha"].update((("\n" if state["kept"] else "") + line).encode())
                    state["kept"] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(closed()), schema)], schema=schema)

    return run


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of the result of :func:`repair`, as it stands.

    ``conv_id``; ``gaps`` in the turns; the rows that are ``blank``, ``duplicate`` and ``truncated``; ``illegal`` neighbours by the
    roles before; ``cost``; ``audit`` (the edits' letters) and ``repaired_sha256`` (of the repaired ``role:text``, joined by line feeds).
    The text of a conversation passes through the hash row by row and is never held whole.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    columns = ", ".join(f"{n} long" for n in NUMBERS)
    schema = edits.sparkSession.createDataFrame([], f"conv_id {kind}, {columns}, audit string, repaired_sha256 string").schema
    return edits.mapInArrow(_digests(_arrow(schema)), schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in, by ``crc32(conv_id:turn) % 20``.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls of the
    key, role and text are one space.
    """
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    marked = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("_k"))
    k = F.col("_k")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return marked.where(k != 0).select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("nth"),
    ).drop("nth")


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """:func:`digests` of the conversations after :func:`damage`, with a row for those that lost all rows."""
    found = digests(repair(damage(conversations))).withColumnRenamed("conv_id", "_c")
    every = conversations.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
