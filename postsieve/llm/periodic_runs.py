"""Runs of periodic words: Lyndon roots by Baier's grouping, extended through longest common extensions.

A run is a stretch of words with a period that no neighbouring word extends. Its roots are Lyndon words under one
of two opposite orders of the words, and each of them is the longest Lyndon word that starts where it does. So:

1. the first phase of Baier's suffix sorter, grouping, gives that longest Lyndon word for every place, once under
   an order of the words and once under the opposite one; nothing has to be sorted further;
2. every such word is a candidate root. How far its period reaches to the right and to the left are two longest
   common extensions, answered from names of blocks of 2^k words (equal names, equal blocks: exact, no hashes);
3. roots that reach far enough are the runs; roots of one run give it several times.

Before that, words that cannot lie in any run are set aside: a run repeats its root `times` times, so each of its
words stands in it that often. What is left falls into separate stretches, in which this is asked again. In
ordinary prose nothing is left.

A document is worked on in one task; the work is linear in its words but for the names (a logarithm more).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORTEST = 6
TIMES = 4
#: Documents that leave a task's Python in one batch.
_BATCH = 256
#: Rounds of setting words aside; more would only save work.
_ROUNDS = 50


def lyndon_lengths(ranks: Sequence[int], top: int) -> list[int]:
    """Length of the longest Lyndon word at each place of `ranks` (0 to `top`, every one occurring).

    Groups hold places whose suffixes begin alike, higher groups larger suffixes. The highest is finished first:
    the length its suffixes agree in is that of their longest Lyndon words. Each of its members is then appended
    to the unfinished place before it, which moves to a group of its own right above its old one.
    """
    group, length = list(ranks), [0] * len(ranks)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    size = [1] * (top + 1)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    left, done = list(range(-1, len(ranks) - 1)), bytearray(len(ranks))
    now = top
    while now >= 0:
        span, here = size[now], [p for p in members[now] if group[p] == now]
        members[now] = []
        for place in here:
            done[place], length[place] = 1, span
        # how often the finished word follows each unfinished place, places in ascending order
        follows: dict[int, int] = {}
        for place in here:
            at, before = place, left[place]
            while before >= 0 and done[before]:
                left[at], at, before = left[before], before, left[before]
            if before >= 0:
                follows[before] = follows.get(before, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for place, times in follows.items():
            moves.setdefault((-times, group[place]), []).append(place)
        for times, old in sorted(moves) if len(moves) > 1 else moves:
            new, higher = len(size), above[old]
            size.append(size[old] - times * span)
            members.append(moves[times, old])
            below.append(old)
            above.append(higher)
            above[old] = new
            below[higher] = new
            for place in moves[times, old]:
                group[place] = new
        now = below[now]
    return length


def _set_aside(ids: np.ndarray, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each) of the words that may lie in a run."""
    places, stretch = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for _ in range(_ROUNDS):
        if not len(places):
            break
        key = stretch * (int(ids.max()) + 1) + ids[places]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = (counts[which] >= times) & (np.bincount(stretch)[stretch] >= shortest)
        if keep.all():
            break
        places = places[keep]
        stretch = np.cumsum(np.diff(places, prepend=places[:1]) > 1)
    return places, stretch


def _block_names(ids: np.ndarray) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4 ... words: equal blocks, and only they, have equal names."""
    names = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while 2 ** len(names) <= len(ids):
        half = 2 ** (len(names) - 1)
        last = names[-1]
        pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
        names.append(np.unique(pairs, return_inverse=True)[1])
        names[-2] = last.astype(np.int32)
    names[-1] = names[-1].astype(np.int32)
    return names


def _reach(names: list[np.ndarray], at: np.ndarray, period: np.ndarray, back: bool) -> np.ndarray:
    """How many words from `at` on (or before it, with `back`) equal those a period later."""
    n, reach = len(names[0]), np.zeros(len(at), np.int64)
    for level in range(len(names) - 1, -1, -1):
        step, name = 2 ** level, names[level]
        start = at - reach - step if back else at + reach
        fits = np.flatnonzero((start >= 0) & (start + period + step <= n))
        same = name[start[fits]] == name[start[fits] + period[fits]]
        reach[fits[same]] += step
    return reach


def runs(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """All runs of a sequence of word numbers, as rows (start, length, period) by start, then period.

    Runs have at least `shortest` words and `times` (2 or more) periods.
    """
    nothing = np.zeros((0, 3), np.int64)
    if len(ids) < shortest:
        return nothing
    places, stretch = _set_aside(ids, shortest, times)
    if not len(places):
        return nothing
    # stretches one after another, each ended by a word of its own
    shift = np.arange(len(places)) + stretch
    text = np.full(len(places) + int(stretch[-1]), -1, np.int64)
    text[shift] = ids[places]
    place = np.zeros(len(text), np.int64)
    place[shift] = places
    ends = np.flatnonzero(text < 0)
    text[ends] = int(ids.max()) + 1 + np.arange(len(ends))
    known, text = np.unique(text, return_inverse=True)
    top = len(known) - 1
    names, found = None, [nothing]
    for order in (text, top - text):
        period = np.array(lyndon_lengths(order.tolist(), top), np.int64)
        at = np.arange(len(text))
        # the first root of a run is followed by times - 1 more words of its period at least
        fits = at + (times - 1) * period <= len(text)
        at, period = at[fits], period[fits]
        for k in range(1, times - 1):
            same = text[at] == text[at + k * period]
            at, period = at[same], period[same]
        if not len(at):
            continue
        if names is None:
            names = _block_names(text)
        right, left = _reach(names, at, period, False), _reach(names, at, period, True)
        long = right + left + period
        good = long >= np.maximum(times * period, shortest)
        found.append(np.stack([(at - left)[good], long[good], period[good]], axis=1))
    unique = np.unique(np.concatenate(found), axis=0)
    unique[:, 0] = place[unique[:, 0]]
    return unique[np.lexsort((unique[:, 2], unique[:, 0]))]


def find(docs: DataFrame, keep: Sequence[str] = (), text: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """`keep` columns with `n_words`, `runs` (an array of start, length, period in words, by start and period) and
    `collapsed`: the words joined by one space, without those that repeat (all but a run's first period).

    Words are what blanks and the controls from tab to carriage return separate. A null or empty text has no words, no runs and an empty
    `collapsed`. Every row is answered for itself: repeated rows and null ids stay as they are, and columns that
    are not kept, whatever their names, play no part. No shuffle.
    """
    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType(
        [docs.schema[name] for name in keep]
        + [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    )
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    kept = list(keep)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(first, _BATCH)
                counts, lists, texts = [], [], []
                for value in batch.column(len(kept)).cast(pa.binary()):
                    words = (value.as_py() or b"").split()  # bytes are split at the six ASCII blanks
                    numbers: dict[bytes, int] = {}
                    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
                    rows = runs(ids, shortest, times)
                    if len(rows):
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                        np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    counts.append(len(ids))
                    lists.append([{"start": s, "length": n, "period": p} for s, n, p in rows.tolist()])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(kept))]
                    + [pa.array(counts, pa.int64()), pa.array(lists, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=[*kept, "n_words", "runs", "collapsed"],
                )

    return docs.select(*kept, docs[text].alias("_text")).mapInArrow(found, schema)
