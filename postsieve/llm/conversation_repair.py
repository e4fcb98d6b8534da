"""Cheapest repairs of conversations whose rows are blank, repeated, cut off or out of turn.

A repaired conversation's roles are `(s?(ua)+)?` by their initials. A row may be kept (0), get another role (3) or be
deleted (4); an empty row may be inserted anywhere (3). Blank and repeated rows have to go, and a row that is cut
off costs 3 more where it stays. Of the cheapest lists of edits the one with the least initials is taken.

Method: Four Russians. What a row can cost depends on one of nine symbols (its role by initial, cut off or not,
or that it has to go). The costs still to come from each of four states (before the start, after s, after u, after
a), less their least, form few vectors: all that can arise are found once, and a table says for each of them and
each block of three symbols which vector lies before the block and how much the block adds. A conversation is
processed from its end, a block at a time, by lookup. Then it is traced from its start: each block is
expanded backward into the vectors behind its rows, and from a state a row takes the least edit that keeps to the
least cost. An edit decides the state after it, so that is the least list of all.

A conversation's rows come to one task in order, as a stream, once as symbols (a byte a row is held) and once as
texts, which go into the hash row by row; no conversation's texts are ever held. Both the list of edits and the
hash are one value that depends on all rows in sequence, so one conversation can't be dealt to several tasks; all
that can be is done before: symbols, and which rows repeat an earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what separates words, and what each edit costs
_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLOCK = 3
_BATCH = 512
# states: before the start, after s, after u, after a; a conversation may end before the start or after a
_START, _S, _U, _A = range(4)
_STATES = (_START, _S, _U, _A)
#: The state that an inserted or renamed row leads to, and its role.
_AHEAD = {_START: _U, _S: _U, _U: _A, _A: _U}
_ROLE = {_U: "user", _A: "assistant"}
#: Symbol 0 has to go; the others are 1 + 2 * initial (s, u, a, other) + cut off.
_SYMBOLS = 9


def _kept_in(symbol: int, state: int) -> int | None:
    """The state after a row that is kept, None where its role can't follow."""
    initial = (symbol - 1) // 2
    allowed = {(0, _START): _S, (1, _START): _U, (1, _S): _U, (1, _A): _U, (2, _U): _A}
    return allowed.get((initial, state)) if symbol else None


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in _STATES:
        costs = [min(costs[q], INSERT + costs[_AHEAD[q]]) for q in _STATES]
    return costs


def _row_costs(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Costs from each state on before a row, given those behind it."""
    extra = CUT_OFF * ((symbol - 1) % 2) if symbol else 0
    costs = []
    for q in _STATES:
        options = [DELETE + after[q]]
        if symbol:
            options.append(REROLE + extra + after[_AHEAD[q]])
            kept = _kept_in(symbol, q)
            if kept is not None:
                options.append(extra + after[kept])
        costs.append(min(options))
    return _with_inserts(costs)


def _row_edits(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least edits up to and with the one of a row, and the state behind it."""
    extra = CUT_OFF * ((symbol - 1) % 2) if symbol else 0
    before, edits = _row_costs(symbol, after), ""
    while True:
        ahead = _AHEAD[state]
        if before[state] == DELETE + after[state]:
            return edits + "D", state
        if before[state] == INSERT + before[ahead]:
            edits, state = edits + "I", ahead
            continue
        kept = _kept_in(symbol, state)
        if kept is not None and before[state] == extra + after[kept]:
            return edits + "K", kept
        return edits + "R", ahead


class Tables:
    """All vectors of costs to come, less their least, and what rows and blocks of rows make of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        infinite = 10**6
        end = _with_inserts([0, infinite, infinite, 0])
        self.vectors = [tuple(end)]
        number = {self.vectors[0]: 0}
        #: by vector * 9 + symbol: the vector before the row, what is added, and per state the edits
        self.before: list[int] = []
        self.added: list[int] = []
        self.edits: list[list[tuple[str, int]]] = []
        for vector in self.vectors:  # grows while it is gone through
            for symbol in range(_SYMBOLS):
                costs = _row_costs(symbol, vector)
                least = min(costs)
                normal = tuple(c - least for c in costs)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                self.before.append(number[normal])
                self.added.append(least)
                self.edits.append([_row_edits(symbol, vector, q) for q in _STATES])
        #: by vector, then the block's symbols as bytes
        self.blocks: list[dict[bytes, tuple[int, int]]] = []
        for vector in range(len(self.vectors)):
            table = {}
            for symbols in product(range(_SYMBOLS), repeat=block):
                table[bytes(symbols)] = self.back(vector, symbols)
            self.blocks.append(table)

    def back(self, vector: int, symbols) -> tuple[int, int]:
        """The vector before some rows, given the one behind them, and what they add."""
        total = 0
        for symbol in reversed(symbols):
            entry = vector * _SYMBOLS + symbol
            vector, total = self.before[entry], total + self.added[entry]
        return vector, total

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and least edits of a conversation's symbols."""
        head = len(symbols) % self.block
        starts = [0] * (head > 0) + list(range(head, len(symbols), self.block))
        ends = starts[1:] + [len(symbols)]
        vector, cost, behind = 0, 0, []
        for start, end in zip(reversed(starts), reversed(ends)):
            behind.append(vector)
            rows = symbols[start:end]
            vector, added = self.blocks[vector][rows] if len(rows) == self.block else self.back(vector, rows)
            cost += added
        cost += self.vectors[vector][_START]
        state, edits = _START, []
        for start, end in zip(starts, ends):
            # the vectors behind each of the block's rows, from its last back to its first
            vectors = [behind.pop()]
            for symbol in reversed(symbols[start + 1:end]):
                vectors.append(self.before[vectors[-1] * _SYMBOLS + symbol])
            for symbol in symbols[start:end]:
                some, state = self.edits[vectors.pop() * _SYMBOLS + symbol][state]
                edits.append(some)
        while state in (_S, _U):
            edits.append("I")
            state = _AHEAD[state]
        return cost, "".join(edits)


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


# --- rows --------------------------------------------------------------------------------------------

def last_character(text: Column) -> Column:
    """The last character that is no blank; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))


def symbol(role: Column, last: Column, repeated: Column) -> Column:
    initial = F.when(F.startswith(role, F.lit("s")), 0).when(F.startswith(role, F.lit("u")), 1).when(
        F.startswith(role, F.lit("a")), 2).otherwise(3)
    cut_off = (~last.isin(*_ENDS)).cast("int")
    return F.when((last == "") | repeated, 0).otherwise(1 + 2 * initial + cut_off)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the conversation, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn, null turns first, those of one turn by role and a hash of the text. A row is a
    `duplicate` if an earlier one of its conversation has the same role and text, unless it is `blank`;
    `truncated` if it is neither and its last character but blanks is not one of `.!?`. `illegal` counts
    neighbours whose initials are not su, ua or au; `gaps` turns that are missing between the least and
    the greatest (0 if all are null). `audit` has the initials of the cheapest edits in order. The hash is that of the repaired rows as `role:text`
    on a line each. Null roles and texts count as one space, null conversations as one conversation; other columns play
    no part. An empty table gives an empty result.
    """
    plain = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    narrow = plain.select("conv", "turn", "role", "same", last_character(F.col("text")).alias("last"))
    # where each content of a conversation comes first: minima are combined before they are shuffled
    first = narrow.groupBy(F.col("conv").alias("c"), F.col("same").alias("s")).agg(
        F.min(F.struct("turn")).getField("turn").alias("first"), F.count("*").alias("times")
    ).where("times > 1").select("c", "s", "first")
    marked = narrow.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    # the order within a turn is by content, so repeats in one turn stand together: only the first of the first turn counts
    later = F.col("s").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    symbols = marked.select(
        "conv", "turn", F.col("role").substr(1, 1).alias("initial"), "role", "same",
        symbol(F.col("role"), F.col("last"), later).cast("int").alias("symbol"), (F.col("last") == "").alias("blank"),
        (F.col("s").isNotNull() & ~later).alias("again"),
    )
    kind = plain.schema["conv"].dataType.simpleString()
    counts = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    in_order = ["conv", F.col("turn").asc_nulls_first(), "role", "same"]
    audits = symbols.repartition("conv").sortWithinPartitions(*in_order).select(
        "conv", "turn", "initial", "same", "symbol", "blank", "again"
    ).mapInArrow(_audited, f"conv {kind}, {counts}")
    # a conversation's edits come first, then its rows
    both = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(plain.schema["turn"].dataType).alias("turn"),
                         F.lit(None).cast("string").alias("role"), F.lit("").alias("same"), F.lit("").alias("text"),
                         F.struct("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("found"))
    found = both.schema["found"].dataType
    texts = plain.select("conv", F.lit(1).alias("kind"), "turn", "role", "same", "text", F.lit(None).cast(found).alias("found"))
    hashed = both.unionAll(texts).repartition("conv").sortWithinPartitions(
        "conv", "kind", F.col("turn").asc_nulls_first(), "role", "same"
    ).select("conv", "kind", "role", "text", "found").mapInArrow(
        _hashed, f"conv {kind}, found {found.simpleString()}, repaired_sha256 string"
    )
    return hashed.select(F.col("conv").alias(conv), "found.*", "repaired_sha256")


class _Conversation:
    """What is held of a conversation while its rows pass: a byte a row, and the last row."""

    def __init__(self):
        self.symbols = bytearray()
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.same = self.initial = None

    def add(self, turn, initial, same, symbol, blank, again):
        if self.rows and f"{self.initial}{initial}" not in ("su", "ua", "au"):
            self.illegal += 1
        if again and self.rows and turn == self.turn and same == self.same:
            symbol = 0
        self.rows += 1
        if blank:
            self.blank += 1
        elif symbol == 0:
            self.duplicate += 1
        elif symbol % 2 == 0:
            self.truncated += 1
        if turn is not None:
            if self.least is None:
                self.least = turn
            if self.turns == 0 or turn != self.turn:
                self.turns += 1
        self.turn, self.same, self.initial = turn, same, initial
        self.symbols.append(symbol)

    def found(self) -> tuple:
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        cost, audit = tables().solve(bytes(self.symbols))
        return (self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    now, held, done, kind = None, None, [], None

    def out() -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 7, pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        done.clear()
        return batch

    for batch in batches:
        kind = batch.column(0).type
        for conv, *row in zip(*[column.to_pylist() for column in batch.columns]):
            if held is None or conv != now:
                if held is not None:
                    done.append((now, *held.found()))
                now, held = conv, _Conversation()
                if len(done) >= _BATCH:
                    yield out()
            held.add(*row)
    if held is not None:
        done.append((now, *held.found()))
        yield out()


class _Repaired:
    """The hash of a repaired conversation, fed with its rows as they pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _AHEAD[self.state]
            self.line(_ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": _S, "u": _U, "a": _A}[role[0]]
            self.line(role, text)
        elif edit == "R":
            self.state = _AHEAD[self.state]
            self.line(_ROLE[self.state], text)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held, found, done, types = None, None, None, [], None

    def end() -> None:
        held.inserts()
        done.append((now, found, held.hash.hexdigest()))

    def out() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["conv", "found", "repaired_sha256"])

    for batch in batches:
        types = [batch.column(0).type, batch.column(4).type, pa.string()]
        for conv, kind, role, text, audit in zip(*[column.to_pylist() for column in batch.columns]):
            if kind == 0:
                if held is not None:
                    end()
                    if len(done) >= _BATCH:
                        yield out()
                now, found, held = conv, audit, _Repaired(audit["audit"])
            else:
                held.row(role, text)
    if held is not None:
        end()
        yield out()
