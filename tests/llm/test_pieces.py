import random

import pyarrow as pa
import sentencepiece

from postsieve.llm import pieces
from tests.llm.helpers import documents, empty, frame


def odd():
    r = random.Random(1)
    texts = [
        None, "", " ", "a", "▁ ▁▁x" * 90, "a" * 900, " " * 700, "x  y   z    " * 80, "\n" * 300, "日本語テキスト" * 60,
        "\U0001f600é" * 150, "".join(r.choice("thequickbrown") for _ in range(1500)), "".join(r.choice("ab \n.") for _ in range(1500)),
        "();\r\n" * 200, "same text", "same text", "x" * 250 + " " * 250,
    ]
    return documents()[:40] + [(-1 - i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "a" * 900)]


def test_ids_are_the_librarys_and_texts_come_back(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = odd()
    want = sorted(((i, t, None if t is None else library.encode(t)) for i, t in rows), key=str)
    for giant, chunk in ((pieces.GIANT, pieces.CHUNK), (200, 64), (0, 101)):
        df = pieces.encode(frame(spark, rows), keep=["doc_id", "text"], giant=giant, chunk=chunk)
        got = sorted(((r["doc_id"], r["text"], r["ids"]) for r in df.collect()), key=str)
        assert got == want
    back = pieces.decode(df, keep=["doc_id"]).collect()
    assert len(back) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(None if t is None else t.replace(pieces.SPACE, " "))
    assert all(r["text"] in texts[r["doc_id"]] for r in back)


def test_matrices_are_multiplied_in_rounds(spark, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(2)
    words = " ".join("".join(r.choice("etaoin shrdlu") for _ in range(r.randint(1, 30))) for _ in range(2_000))
    # no place in it that no piece goes across
    solid = "".join(r.choice("abcdefgh") for _ in range(9_000))
    rows = [(0, words), (1, solid), (2, "short one"), (3, "a" * 5_000), (4, None), (5, words)]
    want = sorted(((i, None if t is None else library.encode(t)) for i, t in rows), key=str)
    groups = []
    edges = pieces._edges
    monkeypatch.setattr(pieces, "_edges", lambda m, last, name: groups.append(last) or edges(m, last, name))
    for fan in (2, 8):
        monkeypatch.setattr(pieces, "FAN", fan)
        got = pieces.encode(frame(spark, rows), keep=["doc_id"], giant=100, chunk=64).collect()
        assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    assert min(groups) > 400


def test_a_product_of_products_is_the_product_of_all():
    library = pieces.Pieces(open(pieces.MODEL, "rb").read()).load()
    text = pieces.SPACE + "".join(random.Random(3).choice("abcde") for _ in range(640))
    rows = []
    for no, at in enumerate(range(0, len(text), 64)):
        end = min(at + 64, len(text))
        entries, exits, pairs = pieces.matrix(library, text, at, end, at == 0, end == len(text))
        rows.append({"key": 1, "no": no, "block": no // 3, "entries": pieces._states(entries), "exits": pieces._states(exits),
                     "i": [i for i, _ in pairs], "j": [j for _, j in pairs]})

    def product(some, block):
        out = pieces._product(pa.Table.from_pylist([dict(r, block=block) for r in some])).to_pylist()[0]
        leads = {(tuple(out["entries"][i].values()), tuple(out["exits"][j].values())) for i, j in zip(out["i"], out["j"])}
        return out, leads

    whole, leads = product(rows, 0)
    assert leads
    parts = [product(rows[at:at + 3], n)[0] for n, at in enumerate(range(0, len(rows), 3))]
    assert product(parts, 0)[1] == leads
    left = rows[0]
    for row in rows[1:]:
        left = product([left, row], 0)[0] | {"no": -1}
    assert product([left], 0)[1] == leads


def test_empty(spark):
    encoded = pieces.encode(empty(spark), keep=["doc_id"])
    assert encoded.count() == 0 and pieces.decode(encoded, keep=["doc_id"]).count() == 0


def test_lists_of_a_slice_and_few_rows_at_once():
    rows = [[1, 2], None, [], [3], [4, 5, 6], None, [7]]
    column = pa.array(rows, pa.list_(pa.int32()))
    for begin in range(8):
        for n in range(8 - begin):
            assert pieces._lists(column.slice(begin, n)) == rows[begin:begin + n]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40))], names=["x"])
    assert [p.num_rows for p in pieces._slices([batch, batch.slice(0, 0)], pieces.FEW)] == [16, 16, 8]
