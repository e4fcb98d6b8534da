import hashlib
import heapq
import random
import re
import zlib
from itertools import product

from pyspark.sql import functions as F

from postsieve.llm import conversation_repair as C
from postsieve.llm import queries
from tests.compare import duck

_SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text) rows in order -> the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(_SPACE)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows, kinds):
    """Least (cost, edits, repaired rows) by search over all edits, cheapest and least first."""
    queue, done = [(0, "", 0, "", [])], set()
    goal = re.compile(r"(s?(ua)+)?")
    while True:
        cost, edits, at, tail, made = heapq.heappop(queue)
        if at == len(rows) and goal.fullmatch("".join(r[:1] for r, _ in made)):
            return cost, edits, made
        if (at, tail, cost) in done:
            continue
        done.add((at, tail, cost))

        def push(more, edit, step, row=None):
            roles = tail + (row[0][:1] if row else "")
            # what matters of the roles so far: a legal beginning, by its end
            if row and (not re.fullmatch(r"s?(ua)*u?", roles if len(roles) < 3 else roles)):
                return
            short = re.sub(r"(ua)+(?=ua|u?$)", "ua", roles)
            heapq.heappush(queue, (cost + more, edits + edit, at + step, short, made + [row] if row else made))

        push(3, "I", 0, ("user", ""))
        push(3, "I", 0, ("assistant", ""))
        if at < len(rows):
            (role, text), kind = rows[at], kinds[at]
            push(4, "D", 1)
            if kind not in ("blank", "duplicate"):
                extra = 3 if kind == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    push(extra, "K", 1, (role, text))
                push(extra + 3, "R", 1, ("user", text))
                push(extra + 3, "R", 1, ("assistant", text))


def expected(rows, original):
    """Answers per conversation of (conv, turn, role, text) rows in order."""
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in original}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    for conv, items in convs.items():
        body = [(role, text) for _, role, text in items]
        kinds = faults(body)
        cost, audit, made = cheapest(body, kinds)
        turns = [t for t, _, _ in items if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(body, body[1:])]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def order(row):
    conv, turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return sorted(out, key=order)


def test_tables_agree_with_a_search():
    r, symbols = random.Random(2), range(9)
    roles = {1: "s", 2: "s", 3: "u", 4: "u", 5: "a", 6: "a", 7: "x", 8: "x"}
    small = [bytes(s) for n in range(4) for s in product(symbols, repeat=n)]
    large = [bytes(r.choice([0, 1, 3, 3, 4, 5, 5, 6, 7, 8]) for _ in range(r.randint(4, 9))) for _ in range(300)]
    for sequence in small + large:
        rows = [(roles.get(s, "u"), "") for s in sequence]
        kinds = ["blank" if s == 0 else "truncated" if s % 2 == 0 else "" for s in sequence]
        want = cheapest(rows, kinds)[:2]
        for block in (1, 3, 4):
            assert C.tables(block).solve(sequence) == want, sequence


def test_few_vectors_and_linear_time():
    assert len(C.tables().vectors) < 60
    cost, audit = C.tables().solve(bytes([3, 5, 0, 8]) * 100_000)
    assert len(audit) >= 400_000 and cost > 0


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return df.selectExpr("*", "1 AS conv", "2 AS symbol", "3 AS kind", "'x' AS same", "4 AS found", "5 AS n_rows", "6 AS c", "7 AS s")


def test_odd_rows(spark):
    r = random.Random(4)
    texts = ["Yes.", "No", "", "  ", None, "What?", "é!", "So it is.\n ", "a ", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)) for c in [None, *range(60)] for _ in range(r.randint(1, 7))]
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", "Fine.") for t in range(40)] + [(71, 1, "user", "Same.")] * 5
    rows += [(72, None, "user", None)]
    got = {x["conv_id"]: x for x in C.repair(_frame(spark, rows)).collect()}
    plain = [(c, t, " " if ro is None else ro, " " if x is None else x) for c, t, ro, x in rows]
    want = expected(sorted(plain, key=order), [])
    assert got.keys() == want.keys()
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    for conv, answer in want.items():
        assert tuple(got[conv][c] for c in columns) == answer, conv
    assert C.repair(_frame(spark, rows).where(F.lit(False))).collect() == []


def test_one_conversation_with_most_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Row {t % 900}.") for t in range(6000)]
    rows += [(c, 0, "user", "Hi.") for c in range(2, 30)]
    got = {x["conv_id"]: x for x in C.repair(_frame(spark, rows)).collect()}
    assert got[1]["duplicate"] == 5100 and got[1]["n_rows"] == 6000 and got[1]["cost"] == 4 * 5100
    assert got[1]["audit"] == "K" * 900 + "D" * 5100
    assert all(got[c]["audit"] == "KI" for c in range(2, 30))


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = duck(sf).sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
        want = expected(damaged(rows), {c for c, *_ in rows})
        got = queries.queries()["op12_conversation_repair"](spark, sf)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert {x[0]: tuple(x)[1:] for x in got.collect()} == want
        assert sum(w[5] for w in want.values()) > 0
