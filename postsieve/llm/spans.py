"""Places of a pattern's matches in a text, as column expressions.

Spark's functions tell where the first match is but not the others. Here matches are set between
two control characters, the text is split there, and running lengths over the pieces give every
start and end in code points. Running values are taken in slices, and texts are cut in blocks, so
that the work grows with the matches, not with their square.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
#: Values whose running total is taken in one go, and how often slices are sliced again.
SLICE, LEVELS = 128, 2
#: Code points of a block that a text is cut in before parts of it are taken.
BLOCK = 256
#: Beyond any place in a text.
_FAR = 2**31 - 2
SPACES = r"[\x20\x09-\x0D]+"
SPAN = "array<struct<start:int,end:int,match:string,spaces:int>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column, levels: int = LEVELS) -> Column:
    """For each value `op` over all values before it, and last over all of them; `op` is associative.

    An array grows by copying, so only arrays of `SLICE` values are grown step by step; the totals
    of the slices are run over in the same way.
    """
    def grown(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    if not levels:
        return grown(values)

    def sliced(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SLICE).cast("int"))
        return once(F.transform(starts, lambda i: grown(F.slice(xs, i * SLICE + 1, F.lit(SLICE)))), shifted)

    def shifted(parts: Column) -> Column:
        totals = running(F.transform(parts, lambda p: F.element_at(p, -1)), op, zero, levels - 1)
        return once(totals, lambda before: F.concat(
            F.flatten(F.zip_with(
                parts, F.slice(before, F.lit(1), F.size(parts)),
                lambda p, b: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: op(b, x)),
            )),
            F.array(F.element_at(before, -1)),
        ))

    return once(values, lambda xs: F.when(F.size(xs) <= SLICE, grown(xs)).otherwise(sliced(xs)))


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def _highest(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(-1))


def found(text: Column, pattern: str, gate: Column | None = None, *, spaces: bool = False) -> Column:
    """Array of (start, end, match, spaces) of all leftmost, non-overlapping matches, in order.

    The pattern must not match a control character below tab. `spaces`: count the runs of white
    space before each match, which must begin and end with other characters; the match then lies in
    or begins in that word of `words`, else the field is null. `gate`: where it is false or null
    there can be no match, and the text isn't searched. Null and empty texts have no matches.
    """
    plain = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    pieces = F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)

    # a piece is "match CLOSE what follows", only the first has no match; the places counted here
    # are one too far for each match before
    def placed(parts: Column) -> Column:
        n = F.size(parts) - 1
        runs = F.transform(parts, lambda p: F.size(F.split(p, SPACES, -1)) - 1) if spaces else F.array().cast("array<int>")
        starts = _sums(F.transform(parts, F.length))
        return once(F.struct(starts.alias("at"), (_sums(runs) if spaces else runs).alias("runs")), lambda s: F.transform(
            F.slice(parts, F.lit(2), n),
            lambda p, i: once(
                F.struct(F.substring_index(p, _CLOSE, 1).alias("match"), (F.element_at(s["at"], i + 2) - i).alias("start")),
                lambda m: F.struct(
                    m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), m["match"].alias("match"),
                    (F.element_at(s["runs"], i + 2) if spaces else F.lit(None).cast("int")).alias("spaces"),
                ),
            ),
        ))

    none = F.array().cast(SPAN)
    spans = once(pieces, lambda parts: F.when(F.size(parts) > 1, placed(parts)).otherwise(none))
    wanted = text.isNotNull() if gate is None else gate
    return F.coalesce(F.when(wanted, spans), none)


def words(text: Column) -> Column:
    """The words of a text; the first is empty where the text begins with white space."""
    return F.split(text, SPACES, -1)


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others`, by start; both are arrays of structs with start and end."""
    def kept(every: Column) -> Column:
        # the farthest end of the others before a span, and the nearest start of those after it
        ends = _highest(F.transform(every, lambda s: F.when(s["mine"], F.lit(-1)).otherwise(s["end"])))
        nexts = _highest(F.transform(F.reverse(every), lambda s: F.when(s["mine"], F.lit(-1)).otherwise(_FAR - s["start"])))
        return once(F.struct(ends.alias("e"), nexts.alias("n")), lambda r: F.transform(
            F.filter(
                F.transform(every, lambda s, i: F.struct(
                    s["mine"].alias("mine"), s["at"].alias("at"),
                    ((F.element_at(r["e"], i + 1) <= s["start"])
                     & (_FAR - F.element_at(r["n"], F.size(every) - i) >= s["end"])).alias("free"),
                )),
                lambda s: s["mine"] & s["free"],
            ),
            lambda s: F.element_at(spans, s["at"]),
        ))

    def places(xs: Column, mine: bool) -> Column:
        return F.transform(xs, lambda s, i: F.struct(
            s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), (i + 1).alias("at"),
        ))

    every = F.array_sort(F.concat(places(others, False), places(spans, True)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), once(every, kept)).otherwise(spans)


def joined(kinds: list[tuple[str, Column]]) -> Column:
    """"kind:start:end" of all spans, by start, then in the order of `kinds`, joined by commas."""
    def tagged(rank: int, name: str, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"),
                F.concat(F.lit(f"{name}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("text"),
            ),
        )

    every = F.concat(*[tagged(i, name, spans) for i, (name, spans) in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["text"]), ",")


def beside(text: Column, spans: Column) -> Column:
    """Array of (start, text) of what lies between spans, the text before the first and after the last included.

    Spans that overlap or touch count as one, so only the first and the last part can be empty.
    """
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def gaps(sorted_spans: Column) -> Column:
        # a part begins at the farthest end so far, where the next span begins beyond it
        return once(_highest(F.transform(sorted_spans, lambda s: s["end"])), lambda far: F.concat(
            F.filter(
                F.transform(sorted_spans, lambda s, i: F.struct(
                    F.greatest(F.element_at(far, i + 1), F.lit(0)).alias("start"), s["start"].alias("end"),
                    (F.element_at(far, i + 1) < s["start"]).alias("open"),
                )),
                lambda g: g["open"],
            ),
            F.array(F.struct(F.element_at(far, -1).alias("start"), F.length(text).alias("end"), F.lit(True).alias("open"))),
        ))

    def cut(blocks: Column, g: Column) -> Column:
        first, last = F.floor(g["start"] / BLOCK).cast("int"), F.floor(g["end"] / BLOCK).cast("int")
        a, b = F.coalesce(F.try_element_at(blocks, first + 1), F.lit("")), F.coalesce(F.try_element_at(blocks, last + 1), F.lit(""))
        return F.when(first == last, F.substring(a, g["start"] % BLOCK + 1, g["end"] - g["start"])).otherwise(F.concat(
            F.substring(a, g["start"] % BLOCK + 1, F.lit(BLOCK)),
            F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(b, F.lit(1), g["end"] % BLOCK),
        ))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return once(F.struct(blocks.alias("blocks"), once(ends, gaps).alias("gaps")), lambda r: F.transform(
        r["gaps"], lambda g: F.struct(g["start"].alias("start"), cut(r["blocks"], g).alias("text"))
    ))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by `mark`; spans that overlap or touch share one mark."""
    parts = F.transform(beside(text, spans), lambda p: p["text"])
    return F.when(F.size(spans) > 0, F.array_join(parts, mark)).otherwise(text)
