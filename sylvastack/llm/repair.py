"""Repair of conversation structure: the cheapest edits that give roles ``(system? (user assistant)+)?``, by bidirectional search.

A node of the edit lattice is (rows passed, state of the role pattern); an edge is one edit: K keeps a row, R gives it the
role that the pattern asks for, D deletes it, I inserts a row without text. Each state asks for one role at most, so an audit,
the edits' initials in order, names one path only, and no cheapest audit is the beginning of another. Two heaps, from the
first node and from the last ones, settle nodes until no cheaper or equally cheap path can be left; the answer is the least
audit over all edges where both sides meet at the least cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialize

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What an undeleted truncated row adds.
TRUNCATED = 3
#: Rows of a conversation that one search spans; longer ones are searched block by block, with the costs from each block's end known.
BLOCK = 1_024
#: A conversation of more rows, or of more bytes of text, takes the way that never holds its texts.
LONG_ROWS, LONG_BYTES = 65_536, 1 << 26
#: A row's code is 4 * place of its role's initial in here + place of its fault in FAULTS.
INITIALS, FAULTS = "sua?", ("", "truncated", "blank", "duplicate")

#: The pattern: state 0 nothing yet, 1 after system, 2 after user, 3 after assistant; by state the role asked for and the state after it.
_ASKED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_ENDS = (0, 3)
_INSERTS = [(s, "I", INSERT, t) for s, (_, t) in _ASKED.items()]


def _edits(code: int) -> list[tuple[int, str, int, int]]:
    """(state before, edit, cost, state after) of a row."""
    initial, fault = INITIALS[code // 4], FAULTS[code % 4]
    out = [(s, "D", DELETE, s) for s in _ASKED]
    if fault in ("blank", "duplicate"):
        return out
    more = TRUNCATED if fault else 0
    for s, (role, t) in _ASKED.items():
        out.append((s, "R", REROLE + more, t))
        if role[0] == initial:
            out.append((s, "K", KEEP + more, t))
    return out + ([(0, "K", KEEP + more, 1)] if initial == "s" else [])


def _by(edges: list[tuple[int, str, int, int]], place: int) -> list[list[tuple[str, int, int]]]:
    """(edit, cost, state at the other end) by the state at this end, edits in ASCII order."""
    return [sorted((e, w, (t, s)[place]) for s, e, w, t in edges if (s, t)[place] == at) for at in _ASKED]


_ONWARD, _BACK = ([_by(_edits(code), place) for code in range(16)] for place in (0, 1))
_INSERT_ONWARD, _INSERT_BACK = _by(_INSERTS, 0), _by(_INSERTS, 1)

Node = tuple[int, int]


def _edges(shape: bytes, last: bool) -> tuple[Callable, Callable]:
    """Edges from and to a node. Inserts stand before a row; behind the last row only in the last block."""
    n = len(shape)

    def onward(i: int, s: int) -> Iterator[tuple[str, int, Node]]:
        if i < n:
            yield from ((e, w, (i + 1, t)) for e, w, t in _ONWARD[shape[i]][s])
        if i < n or last:
            yield from ((e, w, (i, t)) for e, w, t in _INSERT_ONWARD[s])

    def back(i: int, t: int) -> Iterator[tuple[int, Node]]:
        if i:
            yield from ((w, (i - 1, s)) for _, w, s in _BACK[shape[i - 1]][t])
        if i < n or last:
            yield from ((w, (i, s)) for _, w, s in _INSERT_BACK[t])

    return onward, back


def _cheapest(shape: bytes, start: int, exits: dict[int, int], last: bool) -> tuple[int, str, int]:
    """(cost, least audit, last state) from ``start`` before the first row to an exit behind the last, each of which adds its own cost."""
    n, (onward, back) = len(shape), _edges(shape, last)
    ahead: dict[Node, tuple[int, str]] = {}
    behind: dict[Node, int] = {}
    forward, reverse = [(0, "", (0, start))], []
    best = inf

    def settle_ahead(cost: int, audit: str, node: Node) -> float:
        ahead[node] = cost, audit
        least = cost + behind.get(node, inf)
        for e, w, to in onward(*node):
            least = min(least, cost + w + behind.get(to, inf))
            if to not in ahead:
                heappush(forward, (cost + w, audit + e, to))
        return least

    def settle_behind(cost: int, node: Node) -> float:
        behind[node] = cost
        least = cost + ahead[node][0] if node in ahead else inf
        for w, of in back(*node):
            if of in ahead:
                least = min(least, ahead[of][0] + w + cost)
            if of not in behind:
                heappush(reverse, (cost + w, of))
        return least

    for state, cost in exits.items():  # no path goes on from them, so they are settled
        best = min(best, settle_behind(cost, (n, state)))
    best = min(best, settle_ahead(*heappop(forward)))
    while (forward or reverse) and (forward[0][0] if forward else inf) + (reverse[0][0] if reverse else inf) <= best:
        if forward and (not reverse or forward[0][0] <= reverse[0][0]):
            cost, audit, node = heappop(forward)
            if node not in ahead:
                best = min(best, settle_ahead(cost, audit, node))
        else:
            cost, node = heappop(reverse)
            if node not in behind:
                best = min(best, settle_behind(cost, node))

    @lru_cache(maxsize=None)
    def rest(node: Node) -> tuple[str, int]:
        """The least audit from a settled node on, and the state in which it ends."""
        audit = []
        while True:
            step = next(((e, to) for e, w, to in sorted(onward(*node)) if to in behind and w + behind[to] == behind[node]), None)
            if step is None:
                return "".join(audit), node[1]
            audit.append(step[0])
            node = step[1]

    found = []
    for node, (cost, audit) in ahead.items():
        if cost + behind.get(node, inf) == best:
            more, end = rest(node)
            found.append((audit + more, end))
        for e, w, to in onward(*node):
            if cost + w + behind.get(to, inf) == best:
                more, end = rest(to)
                found.append((audit + e + more, end))
    audit, end = min(found)
    return int(best), audit, end


def _costs_before(shape: bytes, exits: dict[int, int], last: bool) -> dict[int, int]:
    """The least cost from each state before the first row to the exits, with theirs."""
    back, settled = _edges(shape, last)[1], {}
    heap = [(c, (len(shape), s)) for s, c in exits.items()]
    heapify(heap)
    while heap:
        cost, node = heappop(heap)
        if node not in settled:
            settled[node] = cost
            for w, of in back(*node):
                if of not in settled:
                    heappush(heap, (cost + w, of))
    return {s: c for (i, s), c in settled.items() if i == 0}


def audit_of(shape: bytes) -> tuple[int, str]:
    """(cost, audit): the cheapest edits of rows with these codes, of equally cheap ones the least in ASCII order."""
    return _short(shape) if len(shape) <= 64 else _blockwise(shape)


def _blockwise(shape: bytes) -> tuple[int, str]:
    blocks = [shape[i : i + BLOCK] for i in range(0, len(shape), BLOCK)] or [b""]
    exits = [dict.fromkeys(_ENDS, 0)]
    for k in range(len(blocks) - 1, 0, -1):
        exits.append(_costs_before(blocks[k], exits[-1], k == len(blocks) - 1))
    state, total, parts = 0, None, []
    for k, block in enumerate(blocks):
        cost, audit, state = _cheapest(block, state, exits[len(blocks) - 1 - k], k == len(blocks) - 1)
        total = cost if total is None else total
        parts.append(audit)
    return total, "".join(parts)


_short = lru_cache(maxsize=1 << 14)(_blockwise)


def applied(audit: str, shape: bytes) -> Iterator[tuple[int | None, str, str | None]]:
    """(row, edit, role) in order: row is null for an insert, role for what is deleted or kept."""
    state, at = 0, 0
    for edit in audit:
        asked, after = _ASKED[state]
        if edit == "I":
            yield None, edit, asked
            state = after
            continue
        yield at, edit, asked if edit == "R" else None
        if edit == "K":
            state = 1 if state == 0 and INITIALS[shape[at] // 4] == "s" else after
        elif edit == "R":
            state = after
        at += 1


def _counts(shape: bytes) -> list[int]:
    """Rows that are blank, duplicate, truncated, and neighbours whose roles may not follow each other."""
    roles = [INITIALS[c // 4] for c in shape]
    of = [FAULTS[c % 4] for c in shape]
    return [of.count("blank"), of.count("duplicate"), of.count("truncated"), sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))]


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, (1 << 63) - 1)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, absent): rows damaged by the CRC-32 of ``conv:turn`` modulo 20; null parts of it, roles and texts count as one space.

    0 drops the row (absent is true), 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 sets the role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"), (F.crc32(F.concat_ws(":", part(conv_col), part(turn_col))) % 20).alias("hit"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("absent"), twice.alias("_copy")).drop("_copy")


def _coded(rows: DataFrame) -> DataFrame:
    """``rows`` with a code each, as far as the row alone shows it: duplicates are found later."""
    seen = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) * F.when(F.col("role") == "", 0).otherwise(1), F.lit(0)), F.lit(4)) - 1
    fault = F.when(seen == "", FAULTS.index("blank")).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), 0).otherwise(FAULTS.index("truncated"))
    return rows.withColumn("code", (initial * 4 + fault).cast("int"))


def _given(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent_col: str | None) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    absent = F.coalesce(F.col(absent_col), F.lit(False)) if absent_col else F.lit(False)
    return rows.select(F.col(conv_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"), absent.alias("absent"))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _table(kind: pa.DataType, lines: list[tuple]) -> pa.RecordBatch:
    id_, *counts, audit, sha = zip(*lines)
    names = [x.split()[0] for x in _REPORT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(id_, kind), *(pa.array(c, pa.int64()) for c in counts), pa.array(audit, pa.string()), pa.array(sha, pa.string())], ["id", *names])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, turn, role, text, absent, code) sorted by id, turn, role and text -> one line a conversation, which is held whole."""
    kind = None

    def kinds() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("id").type
            yield batch

    lines: list[tuple] = []
    for id_, group in groupby(_rows(kinds()), key=lambda r: r[0]):
        seen, turns, shape, parts = set(), set(), bytearray(), []
        for _, turn, role, text, absent, code in group:
            if absent:
                continue
            fault = code % 4
            if fault != FAULTS.index("blank"):
                if (role, text) in seen:
                    fault = FAULTS.index("duplicate")
                seen.add((role, text))
            shape.append(code - code % 4 + fault)
            parts.append((role, text))
            if turn is not None:
                turns.add(turn)
        cost, audit = audit_of(bytes(shape))
        digest = hashlib.sha256()
        between = ""
        for at, edit, role in applied(audit, bytes(shape)):
            if edit != "D":
                digest.update(f"{between}{role or parts[at][0]}:{'' if at is None else parts[at][1]}".encode("utf-8", "surrogatepass"))
                between = "\n"
        lines.append((id_, _gaps(min(turns, default=None), max(turns, default=None), len(turns)), *_counts(shape), cost, audit, digest.hexdigest()))
        if len(lines) == 1_000:
            yield _table(kind, lines)
            lines = []
    if lines:
        yield _table(kind, lines)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, pos, code) sorted by id and pos -> (id, codes): one byte a row."""
    for id_, group in groupby(_rows(batches), key=lambda r: r[0]):
        yield id_, bytes(r[2] for r in group)


def _numbered(rows: DataFrame) -> DataFrame:
    """Present rows with their place in the conversation and their final code, duplicates included; no conversation is held."""
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    placed = materialize(_coded(rows.where("not absent")).withColumn("pos", F.row_number().over(order)))
    again = F.row_number().over(Window.partitionBy("id", "role", "text").orderBy("pos")) > 1
    blank, duplicate = FAULTS.index("blank"), FAULTS.index("duplicate")
    return materialize(placed.withColumn("code", F.when(again & (F.col("code") % 4 != blank), F.col("code") - F.col("code") % 4 + duplicate).otherwise(F.col("code"))))


def _edit_rows(numbered: DataFrame) -> DataFrame:
    kind = numbered.schema["id"].dataType.simpleString()
    arrow = numbered.select("id").limit(0).toArrow().schema.field("id").type

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, shape in _shapes(batches):
            held = []
            for at, (row, edit, role) in enumerate(applied(audit_of(shape)[1], shape)):
                held.append((at, None if row is None else row + 1, edit, role))
                if len(held) == 10_000:
                    yield table(id_, held)
                    held = []
            if held:
                yield table(id_, held)

    def table(id_, held: list[tuple]) -> pa.RecordBatch:
        at, pos, edit, role = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([id_] * len(held), arrow), pa.array(at, pa.int64()), pa.array(pos, pa.int32()), pa.array(edit), pa.array(role, pa.string())], ["id", "at", "pos", "edit", "new_role"])

    narrow = numbered.select("id", "pos", "code").repartition("id").sortWithinPartitions("id", "pos")
    plans = materialize(narrow.mapInArrow(plan, f"id {kind}, at long, pos int, edit string, new_role string"))
    texts = numbered.select(F.col("id").alias("_id"), F.col("pos").alias("_pos"), "turn", "role", "text")
    both = plans.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("pos") == F.col("_pos")), "left")
    return both.select("id", "at", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """(id, at, edit, turn, role, text): the repair of every conversation, edit by edit; all rows but those with edit D are the repaired conversation, in order of ``at``.

    A conversation may have any number of rows: its texts are never held together, one byte a row and its audit are. Terms as in ``report``.
    """
    return _edit_rows(_numbered(_given(rows, conv_col, turn_col, role_col, text_col, absent_col)))


def _long_reports(rows: DataFrame) -> DataFrame:
    numbered, kind = _numbered(rows), rows.schema["id"].dataType.simpleString()
    arrow = rows.select("id").limit(0).toArrow().schema.field("id").type

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, shape in _shapes(batches):
            yield _table(arrow, [(id_, 0, *_counts(shape), *audit_of(shape), None)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, group in groupby(_rows(batches), key=lambda r: r[0]):
            digest, between = hashlib.sha256(), ""
            for _, _, role, text in group:
                digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            yield pa.RecordBatch.from_arrays([pa.array([id_], arrow), pa.array([digest.hexdigest()])], ["id", "sha"])

    shapes = numbered.select("id", "pos", "code").repartition("id").sortWithinPartitions("id", "pos").mapInArrow(counted, f"id {kind}, {_REPORT}")
    kept = _edit_rows(numbered).where("edit <> 'D'").select("id", "at", "role", "text")
    shas = kept.repartition("id").sortWithinPartitions("id", "at").mapInArrow(hashed, f"id {kind}, sha string")
    turns = rows.where("not absent").groupBy("id", "turn").agg(F.lit(1)).groupBy("id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("g"))
    every = rows.select("id").distinct()
    for i, x in enumerate((shapes, shas, turns)):
        x = x.withColumnRenamed("id", f"_{i}")
        every = every.join(x, F.col("id").eqNullSafe(F.col(f"_{i}")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    counts = [zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.select("id", F.coalesce("g", F.lit(0).cast("long")).alias("gaps"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation.

    A conversation's rows are taken by turn, null turns first, equal turns by role and text. A row's first fault counts:
    blank (nothing but spaces), duplicate (role and text of an earlier row), truncated (the last sign but spaces is not
    ``.``, ``!`` or ``?``). Null roles and texts count as one space; rows with a null conv form one conversation. gaps:
    turns missing between the first and the last; illegal: neighbours whose initials are not su, ua or au. Rows where
    ``absent_col`` is true only name their conversation; one with no other row has zeros, an empty audit and the hash of
    nothing. Empty table: empty result. Other columns are not read.

    Conversations meet in one shuffle. One of more than ``long_rows`` rows or ``long_bytes`` bytes of text is not held
    by a task: windows find its order and duplicates, its audit comes from one byte a row, and its hash from a stream.
    """
    given = _given(rows, conv_col, turn_col, role_col, text_col, absent_col)
    kind = given.schema["id"].dataType.simpleString()
    sizes = given.groupBy(F.col("id").alias("_long")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("_long"))
    short, rest = given, None
    if not long.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_long"))
        short, rest = given.join(long, same, "left_anti"), _long_reports(materialize(given.join(long, same, "left_semi")))
    sorted_ = _coded(short).repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    found = sorted_.mapInArrow(_reports, f"id {kind}, {_REPORT}")
    return found if rest is None else found.unionByName(rest)


def oracle() -> str:
    """DuckDB SQL for ``report`` of ``damaged`` conversations: the best edits so far, row by row, for each state of the pattern."""
    inserts = [(0, "", 0, 0, []), (0, "I", 3, 2, ["user:"]), (0, "II", 6, 3, ["user:", "assistant:"]), (1, "", 0, 1, []), (1, "I", 3, 2, ["user:"]), (1, "II", 6, 3, ["user:", "assistant:"]), (2, "", 0, 2, []), (2, "I", 3, 3, ["assistant:"]), (3, "", 0, 3, []), (3, "I", 3, 2, ["user:"])]
    lines = ", ".join(f"({s}, '{letters}', {cost}, {t}, {rows}::varchar[])" for s, letters, cost, t, rows in inserts)
    return f"""with recursive crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) tab from (select unnest(range(256)) i)),
      base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 hit from conversations, crc),
      harm as (select conv_id, turn, case hit when 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from (select *, unnest(case hit when 3 then [1, 2] else [1] end) from base where hit <> 0)),
      seq as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) seen from harm),
      faulty as (select *, substr(role, 1, 1) ini, case when seen = '' then 'b' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd' when right(seen, 1) not in ('.', '!', '?') then 't' else '' end fault from seq),
      ins(s, letters, cost, t, made) as (values {lines}),
      best(conv_id, pos, s, x) as (select distinct conv_id, 0::bigint, 0, {{'cost': 0, 'audit': '', 'out': []::varchar[]}} from faulty
        union all select conv_id, pos, s, arg_min({{'cost': cost, 'audit': audit, 'out': made}}, {{'cost': cost, 'audit': audit}}) from (
          select b.conv_id, f.pos, case e.edit when 'D' then i.t when 'R' then case i.t when 2 then 3 else 2 end else case f.ini when 's' then 1 when 'u' then 2 else 3 end end s,
            b.x.cost + i.cost + case e.edit when 'D' then 4 when 'R' then 3 else 0 end + case when e.edit <> 'D' and f.fault = 't' then 3 else 0 end cost, b.x.audit || i.letters || e.edit audit,
            b.x.out || i.made || case e.edit when 'D' then [] when 'R' then [case i.t when 2 then 'assistant:' else 'user:' end || f.text] else [f.role || ':' || f.text] end made
          from best b join ins i on i.s = b.s join faulty f on f.conv_id is not distinct from b.conv_id and f.pos = b.pos + 1 join (values ('D'), ('K'), ('R')) e(edit)
            on e.edit = 'D' or f.fault not in ('b', 'd') and (e.edit = 'R' or (i.t = 2 and f.ini = 'a') or (i.t <> 2 and f.ini = 'u') or (i.t = 0 and f.ini = 's'))) q group by 1, 2, 3),
      counts as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated,
        count(*) filter (before || ini not in ('su', 'ua', 'au')) illegal from (select *, lag(ini) over (partition by conv_id order by pos) before from faulty) group by 1),
      ends as (select b.conv_id, arg_min({{'cost': b.x.cost + i.cost, 'audit': b.x.audit || i.letters, 'out': b.x.out || i.made}}, {{'cost': b.x.cost + i.cost, 'audit': b.x.audit || i.letters}}) y
        from best b join counts c on c.conv_id is not distinct from b.conv_id and c.n = b.pos join ins i on i.s = b.s where i.t in (0, 3) group by 1)
      select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
        coalesce(y.cost, 0)::bigint as cost, coalesce(y.audit, '') audit, sha256(coalesce(array_to_string(y.out, chr(10)), '')) repaired_sha256
      from (select distinct conv_id from conversations) a left join counts c on a.conv_id is not distinct from c.conv_id left join ends e on a.conv_id is not distinct from e.conv_id"""
