"""A byte-level convolutional network that scores the quality of texts.

Filters of `TAPS` bytes run over the whole text; their responses are averaged over chunks of two
halves, each half shared with the next chunk; a small layer looks at each chunk; the strongest
response over all chunks, of each unit, is combined into one probability. All of it is numpy in
batches of whole texts inside tasks, with tables of a filter's response to each byte in place of products.

It is fitted on the driver, by backward passes through the winning chunks, on a bounded sample of
labelled rows: at most `TRAIN_ROWS` of each label, those of least hash, with texts of at most
`TRAIN_BYTES`. Scores are computed where the texts are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAPS = 6
FILTERS = 16
UNITS = 16
HALF = 128
TRAIN_ROWS = 1_000
TRAIN_BYTES = 65_536
EPOCHS = 8
BATCH = 64
RATE = 0.01
#: Every FOLDS-th id by its checksum is held out.
FOLDS = 5
THRESHOLD = 0.3
#: Bytes of which gradients are taken at once, and that are scored at once.
BLOCK = 1 << 18
SCORED = 1 << 16


def held_out(ident: Column) -> Column:
    """Whether an id belongs to the fold that nothing is learned from (a null id doesn't)."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded to halves, one after another: bytes, whether each is text, bytes of text in each half, halves per text."""
    halves = np.array([-(-(len(t) + TAPS - 1) // HALF) if t else 0 for t in texts])
    data = np.zeros(int(halves.sum()) * HALF + TAPS - 1, np.uint8)
    real = np.zeros(int(halves.sum()) * HALF, bool)
    at = 0
    for text, n in zip(texts, halves):
        data[at:at + len(text)] = np.frombuffer(text, np.uint8)
        real[at:at + len(text)] = True
        at += n * HALF
    return data, real, real.reshape(-1, HALF).sum(1), halves


class Net:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "byte": rng.normal(0, 0.3, (TAPS, 256, FILTERS)), "bias": np.zeros(FILTERS),
            "unit": rng.normal(0, 0.5, (FILTERS, UNITS)), "low": rng.normal(0, 0.1, UNITS),
            "out": rng.normal(0, 0.3, UNITS), "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def chunks(self, data, real, filled, halves):
        """Mean response of each chunk, its bytes, and the text and first half of each chunk."""
        n = len(real)
        response = self.p["byte"][0][data[:n]] + self.p["bias"]
        for j in range(1, TAPS):
            response += self.p["byte"][j][data[j:n + j]]
        np.maximum(response, 0, out=response)
        response[~real] = 0
        sums = response.reshape(-1, HALF, FILTERS).sum(1)
        many = np.maximum(halves - 1, np.minimum(halves, 1))
        of = np.repeat(np.arange(len(halves)), many)
        begin = np.cumsum(halves) - halves
        first = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        second = np.minimum(first + 1, np.repeat(begin + halves - 1, many))
        two = (second > first)[:, None]
        size = filled[first] + np.where(second > first, filled[second], 0)
        mean = (sums[first] + np.where(two, sums[second], 0)) / size[:, None]
        return mean, size, of, first, second

    def pooled(self, mean, of, n_texts):
        """The strongest response of each unit over a text's chunks, and the chunk it comes from (-1: none)."""
        z = np.maximum(mean @ self.p["unit"] + self.p["low"], 0)
        top, won = np.zeros((n_texts, UNITS), np.float32), np.full((n_texts, UNITS), -1)
        if len(of):
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            best = np.maximum.reduceat(z, begin, axis=0)
            top[of[begin]] = best
            hit = (z == np.repeat(best, np.diff(np.append(begin, len(of))), axis=0)) & (z > 0)
            rows, units = np.nonzero(hit)
            won[of[rows], units] = rows
        return top, won

    def scores(self, texts: list[bytes]) -> np.ndarray:
        data, real, filled, halves = layout(texts)
        mean, _, of, _, _ = self.chunks(data, real, filled, halves)
        top, _ = self.pooled(mean, of, len(texts))
        return 1 / (1 + np.exp(-(top @ self.p["out"] + self.p["base"]).astype(np.float64)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, of_texts: int | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss of some texts, or of their share in that of `of_texts`."""
        data, real, filled, halves = layout(texts)
        mean, size, of, first, second = self.chunks(data, real, filled, halves)
        top, won = self.pooled(mean, of, len(texts))
        score = 1 / (1 + np.exp(-(top @ self.p["out"] + self.p["base"])))
        error = ((score - labels) / (of_texts or len(texts))).astype(np.float32)
        g = {"out": top.T @ error, "base": error.sum(keepdims=True)}
        # only chunks that won a unit pass anything back
        rows, units = np.nonzero(won >= 0)
        used, where = np.unique(won[rows, units], return_inverse=True)
        back = np.zeros((len(used), UNITS), np.float32)
        np.add.at(back, (where, units), error[rows] * self.p["out"][units])
        g["unit"], g["low"] = mean[used].T @ back, back.sum(0)
        per_byte = (back @ self.p["unit"].T) / size[used][:, None]
        both = np.concatenate([first[used], second[used][second[used] > first[used]]])
        owner = np.concatenate([np.arange(len(used)), np.flatnonzero(second[used] > first[used])])
        at = (both[:, None] * HALF + np.arange(HALF)).ravel()
        owner = np.repeat(owner, HALF)
        at, owner = at[real[at]], owner[real[at]]
        response = self.p["bias"] + sum(self.p["byte"][j][data[at + j]] for j in range(TAPS))
        flow = np.where(response > 0, per_byte[owner], 0)
        g["bias"] = flow.sum(0)
        g["byte"] = np.zeros_like(self.p["byte"])
        for j in range(TAPS):
            order = np.argsort(data[at + j], kind="stable")
            values, begin = np.unique(data[at + j][order], return_index=True)
            if len(values):
                g["byte"][j][values] = np.add.reduceat(flow[order], begin, axis=0)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> "Net":
        """Adam over shuffled batches; the same rows in the same order give the same net."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        batches = -(-len(texts) // BATCH)
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(texts), BATCH):
                rows = order[i:i + BATCH]
                step += 1
                rate = RATE * (1 - (step - 1) / (epochs * batches))
                for k, g in self._batch(texts, labels, rows).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


    def _batch(self, texts: list[bytes], labels: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a batch, `BLOCK` bytes at a time, so that long texts don't add up in memory."""
        total: dict[str, np.ndarray] = {}
        part = np.cumsum([len(texts[r]) for r in rows]) // BLOCK
        for p in np.unique(part):
            some = rows[part == p]
            for k, g in self.gradients([texts[r] for r in some], labels[some], len(rows)).items():
                total[k] = total[k] + g if k in total else g
        return total


def train(
    docs: DataFrame, labels: DataFrame, *, ident: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, epochs: int = EPOCHS,
) -> Net:
    """A net fitted on at most `max_rows` rows of each label, as many of either if both have enough.

    Rows of the held-out fold, with null ids, texts or labels, labels other than 0 and 1, or texts
    over `max_bytes` aren't used. Of documents with one id, one is used: the text of least hash.
    Without rows the net stays as it began.
    """
    rows = labels.select(F.col(ident).alias("_id"), F.col(label).alias("_label")).where(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))
    ).distinct()
    picked = None
    for value in (0, 1):
        part = rows.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
        picked = part if picked is None else picked.unionAll(part)
    # at most 2 * max_rows ids
    body = docs.select(F.col(ident).alias("_doc"), F.col(text).cast("binary").alias("_text"))
    sample = body.where(F.length("_text").between(1, max_bytes)).join(
        F.broadcast(picked), F.col("_doc") == F.col("_id")
    ).groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text"))
    got = sorted(((r["_id"], bytes(r["_text"]), r["_label"]) for r in sample.collect()), key=lambda r: r[:2])
    net = Net()
    if got:
        net.fit([t for _, t, _ in got], np.array([y for _, _, y in got], np.float32), epochs)
    return net


def _score(params):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = Net()
        net.p = params.value
        for column in columns:
            out, held, size = [], [], 0
            for text in column:
                held.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                size += len(held[-1])
                if size >= SCORED:
                    out.append(net.scores(held))
                    held, size = [], 0
            if held:
                out.append(net.scores(held))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)


def score(docs: DataFrame, net: Net, *, text: str = "text", keep: list[str]) -> DataFrame:
    """One row per document: the `keep` columns and score, the probability of label 1.

    Nothing but the text is looked at, and nothing else goes to Python. Null and empty texts get the score of a text
    without chunks; equal texts get equal scores up to the order of sums; an empty table gives an empty result.
    """
    scored = _score(docs.sparkSession.sparkContext.broadcast(net.p))
    return docs.select(*keep, scored(F.col(text).cast("binary")).alias("score"))


def keep_good(docs: DataFrame, net: Net, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of `docs` whose score is at least `threshold`."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    scored = score(packed, net, text="_text", keep=["_row"])
    return scored.where(F.col("score") >= threshold).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
