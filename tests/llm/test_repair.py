"""Conversation repair against a plain forward table over all edits, and damage and counts written out row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sylvastack.llm import queries, repair

COLUMNS = [("conv_id", "bigint"), *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
NOTHING = hashlib.sha256().hexdigest()


def plain_best(rows):
    """(cost, audit, repaired) of rows (role, text, fault): the best so far for each string of roles' last letter, row by row."""

    def state_after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    def inserts(best):
        for _ in range(3):  # more than two in a row never help
            for s, (cost, audit, out) in list(best.items()):
                role = "assistant" if s == "u" else "user"
                add(best, role[0], (cost + 3, audit + "I", out + [f"{role}:"]))
        return best

    def add(best, s, x):
        if s is not None and (s not in best or x[:2] < best[s][:2]):
            best[s] = x

    best = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        now = {}
        for s, (cost, audit, out) in best.items():
            add(now, s, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            add(now, state_after(s, role[:1]), (cost + more, audit + "K", out + [f"{role}:{text}"]))
            to = "assistant" if s == "u" else "user"
            add(now, to[0], (cost + more + 3, audit + "R", out + [f"{to}:{text}"]))
        best = inserts(now)
    return min(best[s] for s in ("", "a") if s in best)


def plain_report(conversation):
    """All columns of one conversation (turn, role, text) before damage, with its id in front of each row."""
    rows = []
    for conv, turn, role, text in conversation:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        rows += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return plain_counts(rows)


def plain_counts(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, faulty = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    of = [f for _, _, f in faulty]
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(faulty, faulty[1:]))
    cost, audit, repaired = plain_best(faulty)
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in repaired))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, of.count("blank"), of.count("duplicate"), of.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def shape_rows(shape):
    """Rows with these codes as the plain table takes them."""
    return [({"s": "system", "u": "user", "a": "assistant", "?": "tool"}[repair.INITIALS[c // 4]], str(i), repair.FAULTS[c % 4]) for i, c in enumerate(shape)]


def test_every_short_shape():
    for n in range(4):
        for shape in itertools.product(range(16), repeat=n):
            assert repair.audit_of(bytes(shape)) == plain_best(shape_rows(shape))[:2], shape


@pytest.mark.parametrize("codes", [range(16), (0, 4, 8), (4, 8, 12), (1, 5, 9, 12), (4,), (0, 6)])
def test_longer_shapes_and_blocks(codes, monkeypatch):
    draw = random.Random(1)
    shapes = [bytes(draw.choices(list(codes), k=draw.randint(4, 90))) for _ in range(60)]
    want = [plain_best(shape_rows(s))[:2] for s in shapes]
    assert [repair._blockwise(s) for s in shapes] == want
    for size in (1, 2, 7):
        monkeypatch.setattr(repair, "BLOCK", size)
        assert [repair._blockwise(s) for s in shapes] == want


def test_edits_give_the_pattern():
    shape = bytes([4, 4, 8, 2, 0, 13])
    cost, audit = repair.audit_of(shape)
    rows = [row for row, _, _ in repair.applied(audit, shape) if row is not None]
    assert rows == list(range(6)) and cost == plain_best(shape_rows(shape))[0]


def read(spark, data):
    by = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        by.setdefault(r.conv_id, []).append(tuple(r))
    return by


def test_query_on_the_whole_table(spark, data):
    found = queries.QUERIES["op12_repair"](spark, data)
    assert found.dtypes == COLUMNS
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {conv: plain_report(rows) for conv, rows in read(spark, data).items()}


TEXTS = ["Yes.", "yes. \n", "No", "", " \t", None, "a!", "Yes."]


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """Null ids, turns, roles and texts, repeated rows, equal turns, other roles, a long text, and columns with clashing names."""
    from pyspark.sql import functions as F

    draw = random.Random(2)
    rows = [(draw.choice([None, 1, 2, 3, 4, 5, 6]), draw.choice([None, *range(9)]), draw.choice(["user", "assistant", "system", "tool", "", None, "User"]), draw.choice(TEXTS)) for _ in range(150)]
    rows += rows[:20] + [(7, 0, "user", "word " * 50_000)] + [(i, 0, "user", "Hello?") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.withColumns({c: F.lit("clash") for c in ("id", "pos", "code", "at", "edit", "audit", "rows", "hit")})


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3}, {"long_bytes": 40}, {"long_rows": 0}])
def test_odd_rows_on_both_ways(spark, odd_conversations, limits):
    rows, df = odd_conversations
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = {r[0]: tuple(r)[1:] for r in repair.report(repair.damaged(df), "id", absent_col="absent", **limits).collect()}
    assert got == {conv: plain_report(x) for conv, x in by.items()}
    assert (0, 0, 0, 0, 0, 0, "", NOTHING) in got.values()  # all rows of some conversation are dropped


def test_edits_are_the_repaired_conversation(spark, odd_conversations):
    rows, df = odd_conversations
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, *(" " if x is None else x for x in (role, text))))
    got = {}
    for r in repair.edits(df).orderBy("at").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == set(by)
    for conv, x in by.items():
        want = plain_counts(x)
        assert "".join(r.edit for r in got[conv]) == want[6]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got[conv] if r.edit != "D").encode()).hexdigest() == want[7]


def test_the_sql_gives_the_same_rows(data, odd_conversations):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create table conversations as select * from read_parquet('{data}/conversations.parquet')")
    by = {}
    for r in con.sql("select conv_id, turn, role, text from conversations").fetchall() + [(None if i is None else i + 10**6, *rest) for i, *rest in odd_conversations[0]]:
        by.setdefault(r[0], []).append(r)
    con.executemany("insert into conversations (conv_id, turn, role, text) values (?, ?, ?, ?)", [r for rows in by.values() for r in rows if r[0] is None or r[0] >= 10**6])
    assert {r[0]: r[1:] for r in con.sql(repair.oracle()).fetchall()} == {conv: plain_report(rows) for conv, rows in by.items()}


def test_empty_table(spark, odd_conversations):
    df = odd_conversations[1].where("false")
    assert repair.report(df).collect() == [] and repair.edits(df).collect() == []
    assert repair.report(df).columns == ["id", *(c for c, _ in COLUMNS[1:])]
