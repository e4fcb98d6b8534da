"""SentencePiece encoding and decoding, with giant documents cut into chunks.

Ids are those of the model's own encoder, and decoding gives the text back (a text that holds the
model's mark for spaces gets spaces there; that is the model's rule). Documents of up to `GIANT` code points are
encoded whole. Larger ones are cut into chunks, wherever that falls, and solved by a parallel scan:

A greedy pair encoding is the one path through a text's pieces on which each two neighbours, encoded
together, stay as they are. Whether a path may go on so depends on its last piece only. So a chunk
is a matrix from the pieces that may lie across its left edge to those across its right edge, over
max-plus with weight 0 where a path leads and minus infinity where none does. Matrices are
computed per chunk and multiplied in rounds: each `FAN` neighbours become one, then each `FAN` of
those, until at most `FAN` are left of a document. The way back goes through the same rounds: the states at the ends of
a product settle those between its factors, which leaves one piece at each edge,
and each chunk is traced back on its own between its two. No task holds more than `FAN` matrices of a document.
Where a space follows another character no piece goes across, so only the ends of a chunk need the matrix.

The model's file is read on the driver and broadcast (half a megabyte). It must be of the pair
encoding kind, without rewriting of texts beyond the mark for spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.base import settle

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 32_768
CHUNK = 8_192
#: Neighbouring matrices that one task multiplies.
FAN = 32
#: Texts that are encoded in one call, and chunks that a task turns into Python's objects at once.
BATCH = 128
FEW = 16
#: Pairs of pieces that a worker remembers.
REMEMBERED = 1 << 18
SPACE = "▁"
#: Last piece at a place where no piece goes across, whatever it was.
ANY = ""


class Pieces:
    """A model's pieces and the rule of which two may be neighbours."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank = None
        self.pairs: dict[tuple[str, str], bool] = {}

    def load(self) -> "Pieces":
        if self.rank is None:
            size = self.library.get_piece_size()
            self.ids = {
                self.library.id_to_piece(i): i for i in range(size)
                if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))
            }
            self.rank = {p: self.library.get_score(i) for p, i in self.ids.items()}
            self.longest = max(map(len, self.rank))
            self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return self

    def encode(self, text: str) -> list[str]:
        """Pieces of a short string: the best neighbours are joined, leftmost first, until none can be."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not scored:
                break
            i = min(scored)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        if left == ANY or (right[0] == SPACE and left[-1] != SPACE):
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self.encode(left + right) == [left, right]
        return known

    def at(self, text: str, start: int) -> Iterator[str]:
        """Pieces that may start at a place; a character without a piece is one."""
        for n in range(1, min(self.longest, len(text) - start) + 1):
            part = text[start:start + n]
            if n == 1 or part in self.rank:
                yield part

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.bytes[b] for b in p.encode("utf-8")]
        return out


def edges(pieces: Pieces, text: str, at: int) -> list[tuple[int, str]]:
    """Pieces that may lie across or end at a place: (code points beyond it, piece)."""
    if safe(text, at, at):
        return [(0, ANY)]
    found = []
    for start in range(max(0, at - pieces.longest), at):
        for p in pieces.at(text, start):
            if start + len(p) >= at:
                found.append((start + len(p) - at, p))
    return found


def safe(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The first and last place from begin to end that no piece goes across."""
    first = next((i for i in range(max(begin, 1), end + 1) if i < len(text) and text[i] == SPACE != text[i - 1]), None)
    if first is None:
        return None
    return first, next(i for i in range(end, first - 1, -1) if i < len(text) and text[i] == SPACE != text[i - 1])


def walk(pieces: Pieces, text: str, begin: int, end: int, states: dict[tuple[int, str], int]):
    """From sets of states (bits) at `begin` to those at `end`: states there, and where each came from.

    A state is (place, last piece). Steps keep to neighbours that may follow each other.
    """
    open_at: dict[int, dict[str, int]] = {}
    for (place, last), bits in states.items():
        open_at.setdefault(place, {})[last] = bits
    came: dict[tuple[int, str], list[tuple[int, str]]] = {}
    done: dict[tuple[int, str], int] = {}
    for place in range(begin, end + pieces.longest + 1):
        here = open_at.pop(place, None)
        if not here:
            continue
        if place >= end:
            for last, bits in here.items():
                done[place, last] = bits
            continue
        for part in pieces.at(text, place):
            for last, bits in here.items():
                if pieces.may_follow(last, part):
                    there = open_at.setdefault(place + len(part), {})
                    there[part] = there.get(part, 0) | bits
                    came.setdefault((place + len(part), part), []).append((place, last))
    return done, came


def matrix(pieces: Pieces, text: str, begin: int, end: int, first: bool, last: bool) -> tuple[list, list, list]:
    """Entries and exits of a chunk as (code points beyond the edge, piece), and the pairs a path leads between."""
    entries = [(0, ANY)] if first else edges(pieces, text, begin)
    bits = {(begin + over, p): 1 << i for i, (over, p) in enumerate(entries)}
    calm = safe(text, begin, end)
    if calm:
        done, _ = walk(pieces, text, begin, calm[0], bits)
        every = 0
        for b in done.values():
            every |= b
        bits = {(calm[1], ANY): every}
    done, _ = walk(pieces, text, calm[1] if calm else begin, end, bits)
    exits = [(place - end, p) for place, p in done if not last or place == end]
    pairs = [(i, j) for j, (over, p) in enumerate(exits) for i in range(len(entries)) if done[end + over, p] >> i & 1]
    return entries, exits, pairs


def trace(pieces: Pieces, text: str, begin: int, end: int, entry: tuple[int, str], exit_: tuple[int, str]) -> list[int]:
    """Ids of the pieces that start in a chunk, from its entry to its exit."""
    def leg(start: tuple[int, str], stop_at: int, stop: tuple[int, str] | None) -> list[str]:
        done, came = walk(pieces, text, min(start[0], stop_at), stop_at, {start: 1})
        state = stop or next(iter(done), None)
        out = []
        while state is not None and state != start:
            out.append(state[1])
            # one path leads here from one start
            state = next(iter(came.get(state, [])), None)
        return out[::-1]

    start, goal = (begin + entry[0], entry[1]), (end + exit_[0], exit_[1])
    calm = safe(text, begin, end)
    if not calm:
        return pieces.numbers(leg(start, end, goal))
    middle = text[calm[0]:calm[1]]
    body = pieces.library.encode(middle[1:].replace(SPACE, " ")) if len(middle) > 1 else []
    tail = leg((calm[1], ANY), end, goal) if goal != (calm[1], ANY) else []
    return pieces.numbers(leg(start, calm[0], None)) + body + pieces.numbers(tail)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: what they become in Python is many times as large."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(column: pa.Array) -> list[list[int] | None]:
    """Lists of numbers, taken from the array as a whole: `to_pylist` makes an object of each number first."""
    at = column.offsets.to_numpy()
    begin = int(at[0])
    numbers = column.values.slice(begin, int(at[-1]) - begin).to_numpy().tolist()
    return [numbers[a:b] if valid else None for a, b, valid in zip(at[:-1] - begin, at[1:] - begin, column.is_valid().to_pylist())]


def _whole(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Pieces(model.value).library
        for part in _slices(batches, BATCH):
            texts = part.column(1).to_pylist()
            ids = library.encode([t or "" for t in texts], num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([None if t is None else i for t, i in zip(texts, ids)], pa.list_(pa.int32()))],
                names=["row", "ids"],
            )
    return run


def _cut(model, chunk: int):
    """Rows (key, no, text, first, last, skip): each chunk with what lies around its edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Pieces(model.value).load().longest + 1
        names = ["key", "no", "text", "begin", "end", "first", "last"]
        for batch in batches:
            for key, value in zip(*(batch.column(i) for i in range(2))):
                text = SPACE + value.as_py().replace(" ", SPACE)
                rows = []
                for no, at in enumerate(range(0, len(text), chunk)):
                    left = max(0, at - around)
                    end = min(at + chunk, len(text))
                    rows.append((key.as_py(), no, text[left:end + around], at - left, end - left, at == 0, end == len(text)))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)
    return run


_STATE = "struct<over: int, piece: string>"
_STATES = pa.list_(pa.struct([("over", pa.int32()), ("piece", pa.string())]))


def _states(items: list[tuple[int, str]]) -> list[dict]:
    return [{"over": over, "piece": piece} for over, piece in items]


def _matrices(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value).load()
        for batch in _slices(batches, FEW):
            out = []
            for row in batch.to_pylist():
                entries, exits, pairs = matrix(pieces, row["text"], row["begin"], row["end"], row["first"], row["last"])
                out.append((row["key"], row["no"], _states(entries), _states(exits), [i for i, _ in pairs], [j for _, j in pairs]))
            kinds = [pa.int64(), pa.int64(), _STATES, _STATES, pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["key", "no", "entries", "exits", "i", "j"]
            )
    return run


def _state(s: dict) -> tuple[int, str]:
    return s["over"], s["piece"]


def _product(table: pa.Table) -> pa.Table:
    """The matrix of neighbours, one after another: entries of the first, exits of the last."""
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    entries = rows[0]["entries"]
    # for each state the entries (bits) that lead to it
    reached = {_state(s): 1 << i for i, s in enumerate(entries)}
    for row in rows:
        exits = [_state(s) for s in row["exits"]]
        after = dict.fromkeys(exits, 0)
        for i, j in zip(row["i"], row["j"]):
            after[exits[j]] |= reached.get(_state(row["entries"][i]), 0)
        reached = after
    pairs = [(i, j) for j, bits in enumerate(reached.values()) for i in range(len(entries)) if bits >> i & 1]
    ints = pa.list_(pa.int32())
    return pa.table({
        "key": pa.array([rows[0]["key"]], pa.int64()), "no": pa.array([rows[0]["block"]], pa.int64()),
        "entries": pa.array([entries], _STATES), "exits": pa.array([_states(list(reached))], _STATES),
        "i": pa.array([[i for i, _ in pairs]], ints), "j": pa.array([[j for _, j in pairs]], ints),
    })


def _between(table: pa.Table) -> pa.Table:
    """The states at each edge of neighbours, given those before the first and after the last.

    Those are null for a whole document, which begins with no piece across and ends with the one state reached.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    state = _state
    first = rows[0]
    reached = [{(0, ANY) if first["piece"] is None else (first["over"], first["piece"])}]
    for row in rows:
        reached.append({
            state(row["exits"][j]) for i, j in zip(row["i"], row["j"]) if state(row["entries"][i]) in reached[-1]
        })
    goal = next(iter(reached[-1])) if first["to_piece"] is None else (first["to_over"], first["to_piece"])
    found = []
    for row, before in zip(rows[::-1], reached[-2::-1]):
        entry = next(
            state(row["entries"][i]) for i, j in zip(row["i"], row["j"])
            if state(row["exits"][j]) == goal and state(row["entries"][i]) in before
        )
        found.append((row["key"], row["no"], *entry, *goal))
        goal = entry
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    return pa.table(
        [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=["key", "no", "over", "piece", "to_over", "to_piece"]
    )


def _edges(matrices: DataFrame, last: int, name: str) -> DataFrame:
    """(key, no, over, piece, to_over, to_piece): the states at both edges of each chunk.

    matrices: rows of `_matrices`; last: the greatest no of all documents.
    """
    rounds = [matrices]
    if last >= FAN:
        rounds = [settle(matrices, name)]
    while last >= FAN:
        blocks = rounds[-1].withColumn("block", F.expr(f"no div {FAN}"))
        rounds.append(settle(
            blocks.groupBy("key", "block").applyInArrow(
                _product, f"key long, no long, entries array<{_STATE}>, exits array<{_STATE}>, i array<int>, j array<int>"
            ),
            name,
        ))
        last //= FAN
    between = "key long, no long, over int, piece string, to_over int, to_piece string"
    ends = ["over", "piece", "to_over", "to_piece"]
    found = rounds.pop().select(
        "*", *[F.lit(None).cast("int" if "over" in e else "string").alias(e) for e in ends]
    ).groupBy("key").applyInArrow(_between, between)
    for below in rounds[::-1]:
        blocks = below.withColumn("block", F.expr(f"no div {FAN}"))
        found = settle(
            blocks.join(found.withColumnRenamed("no", "block"), ["key", "block"])
            .groupBy("key", "block").applyInArrow(_between, between),
            name,
        )
    return found


def _traces(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value).load()
        for batch in _slices(batches, FEW):
            rows = batch.to_pylist()
            ids = [
                trace(pieces, r["text"], r["begin"], r["end"], (r["over"], r["piece"]), (r["to_over"], r["to_piece"]))
                for r in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "no", "ids"]
            )
    return run


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Pieces(model.value).library
        for part in _slices(batches, BATCH):
            ids = _lists(part.column(1))
            texts = library.decode([i or [] for i in ids])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())], names=["row", "text"]
            )
    return run


def _broadcast(df: DataFrame, model: str):
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    docs: DataFrame, *, text: str = "text", keep: list[str], model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: the `keep` columns and ids, the model's piece ids of the whole text.

    A null text has null ids, an empty one an empty list; equal texts have equal ids; an empty table
    gives an empty result; a kept column named ids gives way. Texts of more than `giant` code points are solved in chunks of `chunk`
    (at least 64), with the same ids.
    """
    shared = _broadcast(docs, model)
    keep = [k for k in keep if k != "ids"]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    large = F.coalesce(F.length("text") > giant, F.lit(False))
    whole = rows.where(~large).mapInArrow(_whole(shared), f"row {kind}, ids array<int>")

    # texts told apart by 64 bits and their length; equal ones are solved once
    tall = rows.where(large).withColumn("key", F.xxhash64("text", F.length("text")))
    chunks = settle(
        tall.select("key", "text").dropDuplicates(["key"]).mapInArrow(
            _cut(shared, max(chunk, 64)), "key long, no long, text string, begin long, end long, first boolean, last boolean"
        ),
        "piece_chunks",
    )
    spread = chunks.repartition("key", "no")
    matrices = spread.mapInArrow(
        _matrices(shared), f"key long, no long, entries array<{_STATE}>, exits array<{_STATE}>, i array<int>, j array<int>"
    )
    solved = _edges(matrices, chunks.agg(F.max("no")).first()[0] or 0, "piece_matrices")
    traced = spread.join(solved, ["key", "no"]).mapInArrow(_traces(shared), "key long, no long, ids array<int>")
    joined = traced.groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda c: c["ids"])).alias("ids")
    )
    long_ones = tall.select("row", "key").join(joined, "key").select("row", "ids")
    return whole.unionAll(long_ones).select(*[F.col("row").getField(k).alias(k) for k in keep], "ids")


def decode(encoded: DataFrame, *, ids: str = "ids", keep: list[str], model: str = MODEL) -> DataFrame:
    """One row per row: the `keep` columns and text, what the ids stand for; null ids give a null text."""
    rows = encoded.select(F.struct(*keep).alias("row"), F.col(ids).alias("ids"))
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(_decoded(_broadcast(encoded, model)), f"row {kind}, text string")
    return done.select(*[F.col("row").getField(k).alias(k) for k in keep], "text")
