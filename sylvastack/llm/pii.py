"""Personal data: pattern spans, and spans of a character BiLSTM-CRF whose overlapping windows are reconciled over the whole text."""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tagger import PAD, Tagger, encode
from .workspace import materialize

#: Kinds of the base patterns, and all kinds: the tagger finds secrets too.
KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
#: Places of a window that is read, and that neighbours share at least; places of a window that the tagger learns from.
WINDOW, STRIDE, TAUGHT = 192, 48, 96
#: Windows that are sent to the tagger at once, if not more are of one text.
TOGETHER = 4_000
#: Characters of a written address at most.
LONGEST = 120

# The patterns of the base, written so that no text makes them look at a character more than a few times.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_DOT = re.compile(r"(?<![A-Za-z])dot(?![A-Za-z])", re.I)
_NOT_DIGIT = re.compile(r"[^0-9]+")
# Forms that only the tagger's labels and checks know.
_SECRET = re.compile(r"""(?i)(?:token|secret|key|passw(?:or)?d)["']?\s{0,3}[:=]\s{0,3}["']([A-Za-z0-9+/_=-]{16,})["']""")
_AT_SIGN = re.compile(r"(?i)\s{0,2}[\[({<]\s?at\s?[\])}>]\s{0,2}|\s{1,2}at\s{1,2}|\s{0,2}@\s{0,2}")
_DOT_SIGN = re.compile(r"(?i)\s{0,2}[\[({<]\s?(?:dot|\.)\s?[\])}>]\s{0,2}|\s{1,2}dot\s{1,2}|\s{0,2}\.\s{0,2}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WRITTEN_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:{_AT_SIGN.pattern[4:]})[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT_SIGN.pattern[4:]})[A-Za-z0-9-]{{2,63}}){{1,5}}", re.I)
_HEX = "0123456789abcdef"
# What a text must have where a span can pass ``_plausible``: digits with no letters but those of dot between them, digits in
# a word, and an at sign or the word with a host's first dot after it.
_AT_WORD = re.compile(r"[aA][tT](?=[\s\])}>])")
_HOST_AFTER = re.compile(rf"(?i)\s?[\])}}>]?\s{{0,2}}[a-z0-9-]++(?:{_DOT_SIGN.pattern[4:]})[a-z0-9-]")
_NUMBERS = re.compile(r"[0-9](?:[^A-CE-NP-SU-Za-ce-np-su-z]*[0-9])?")
_NUMBER = re.compile(r"[0-9]+")
_WORD_FROM_DIGIT = re.compile(r"[0-9]\S*")
_LETTER = re.compile(r"[A-Za-z]")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind; each kind leftmost and non-overlapping, failing matches dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at) if start < at else None
        if host:
            done = host.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _window_starts(text: str) -> list[int]:
    """Starts of all windows of a text; together they hold each of its places, and neighbours share ``STRIDE`` of them."""
    step = WINDOW - STRIDE
    return list(range(0, max(0, -(-(len(text) - WINDOW) // step)) * step + 1, step)) if text else []


def _marked_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an at sign or the word dot; the tagger learns from those, as others teach it little."""
    last = max(0, -(-(len(text) - TAUGHT) // STRIDE))
    found: set[int] = set()
    for mark in (_MARK, _DOT):
        pos = 0
        while m := mark.search(text, pos):
            at = m.start()
            high = min(last, at // STRIDE)
            found.update(range(max(0, -(-(at - TAUGHT + 1) // STRIDE)), high + 1))
            pos = max(at + 1, high * STRIDE + TAUGHT if high == last else (high + 1) * STRIDE)
    return [w * STRIDE for w in sorted(found)]


def _cut(classes: np.ndarray, starts: list[int], size: int = WINDOW) -> np.ndarray:
    """The windows at ``starts``, padded at the text's end."""
    padded = np.concatenate([classes, np.full(size, PAD, np.uint8)])
    return padded[np.array(starts)[:, None] + np.arange(size)]


def _labels(spans: list[Span], starts: list[int]) -> np.ndarray:
    """Tags of the windows: 1 + 2 * kind where a span begins, one more inside it; the first kind wins where spans overlap."""
    out = np.zeros((len(starts), TAUGHT), np.int8)
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        for row, at in enumerate(starts):
            lo, hi = max(start, at), min(end, at + TAUGHT)
            if lo < hi:
                out[row, lo - at : hi - at] = 2 + 2 * kind
                if lo == start:
                    out[row, lo - at] = 1 + 2 * kind
    return out


def taught_spans(text: str) -> list[Span]:
    """What the tagger learns from: base spans, numbers of a card's length whatever their checksum, and quoted secrets."""
    out = base_spans(text)
    taken = [(s, e) for s, _, e in out]
    more = [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(_NOT_DIGIT.sub("", m[0])) <= 19]
    more += [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    return sorted(out + [x for x in more if not any(x[0] < e and s < x[2] for s, e in taken)])


def _varied(piece: str, kind: int, rng: random.Random) -> str:
    """The same datum as people write it to be read by people, in forms that the base patterns miss."""
    if kind == 0:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" AT ", " DOT "), (" @ ", "."), (" [at] ", "."), ("(at)", "."), ("@", "[.]")])
        local, host = piece.split("@")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return rng.choice(["[.]", "(.)", " . ", "[dot]", " dot ", "_", ". "]).join(piece.split("."))
    digits = _NOT_DIGIT.sub("", piece)
    if kind == 2:
        return rng.choice([".", "/", "_", "  ", " - ", "--"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        head, area, mid, tail = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        form = rng.choice(["00{h} {a} {m} {t}", "({a}) {m}-{t}", "{h}-{a}-{m}-{t}", "{a}.{m}.{t}", "{a}/{m}-{t}", "00{h}-{a}-{m}{t}", "0{a} {m} {t}", "{a}-{m}-{t}"])
        return form.format(h=head or "1", a=area, m=mid, t=tail)
    letters = rng.choice([_HEX, _HEX.upper(), string.ascii_letters + string.digits])
    size = rng.choice([20, 24, 32, 40, 48])
    return rng.choice(["", "", "sk_live_", "ghp_", "key-"]) + "".join(rng.choices(letters, k=size))


def varied_text(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The text with its spans in other forms, and where they are now; a secret also loses or changes the name in front of it."""
    parts, out, done, at = [], [], 0, 0
    for start, kind, end in spans:
        if start < done:
            continue
        piece = _varied(text[start:end], kind, rng)
        gap = text[done:start]
        if kind == 4 and rng.random() < 0.7:
            gap = re.sub(r"[A-Za-z]+([\"']?\s*[:=]\s*[\"']?)$", lambda m: rng.choice(["api_key = ", "auth: ", "Bearer ", "pwd=", "", m[0]]), gap)
        parts += [gap, piece]
        at += len(gap)
        out.append((at, kind, at + len(piece)))
        at += len(piece)
        done = end
    return "".join(parts) + text[done:], out


def _plausible(piece: str, kind: int) -> bool:
    """Whether a piece is a datum of its kind once its separators are read as people read them."""
    numbers = [x for x in _NOT_DIGIT.split(piece) if x]
    digits, letters = "".join(numbers), re.sub(r"[^A-Za-z]+", "", piece)
    if kind == 0:
        return len(piece) <= LONGEST and bool(_EMAIL.fullmatch(_DOT_SIGN.sub(".", _AT_SIGN.sub("@", piece, count=1))))
    if kind == 1:
        gaps = {x.strip() for x in re.split(r"[0-9]+", piece)[1:-1]}
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and len(gaps) == 1 and letters.lower() in ("", "dotdotdot")
    if kind == 4:
        return len(piece) >= 16 and bool(digits and letters) and not re.search(r"\s", piece)
    if letters or len(piece) > 2 * len(digits) + 4:
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15 and (len(numbers) >= 3 or piece[0] in "+(") and not _luhn(digits if len(digits) >= 12 else "1")


def _snapped(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    """A piece that cuts a run of digits, or of letters and digits where its kind has both, takes it whole; blanks and closing signs at its ends go. An address takes the written address that it touches."""
    if kind == 0:
        low = max(0, start - 24)
        for m in _WRITTEN_EMAIL.finditer(text, low, min(len(text), end + 24)):
            if m.start() < end and start < m.end():
                return m.span()
    inside = str.isdigit if 1 <= kind <= 3 else str.isalnum
    while start > 0 and inside(text[start - 1]) and inside(text[start]):
        start -= 1
    while end < len(text) and inside(text[end]) and inside(text[end - 1]):
        end += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in ".,;:!?\"'"):
        end -= 1
    while start < end and (text[start].isspace() or text[start] in ".,;:!?\"'"):
        start += 1
    return start, end


def _stretches(text: str) -> list[tuple[int, int]]:
    """Stretches (start, end) of a text one of which each piece shares a place with that ``_snapped`` and ``_plausible`` can let pass.

    An address has its at sign, then a host and a dot; four numbers, or nine digits, have no letters but those of dot between
    them, and the piece has a digit before it is snapped; a secret lies in a word with a digit and a letter.
    """
    at, out = text.find("@"), []
    while at >= 0:
        if _HOST_AFTER.match(text, at + 1):
            out.append((max(0, at - LONGEST + 1), at + LONGEST))
        at = text.find("@", at + 1)
    for m in _AT_WORD.finditer(text):
        at = m.start()
        if at and (text[at - 1] in "[({<" or text[at - 1].isspace()) and _HOST_AFTER.match(text, at + 2):
            out.append((max(0, at - LONGEST + 1), at + LONGEST))
    if not _DIGIT.search(text):
        return out
    for m in _NUMBERS.finditer(text):
        runs = _NUMBER.findall(m[0])
        if len(runs) >= 4 or sum(map(len, runs)) >= 9:
            start, end = m.span()
            while start > 0 and text[start - 1].isdigit():
                start -= 1
            while end < len(text) and text[end].isdigit():
                end += 1
            out.append((start, end))
    for m in _WORD_FROM_DIGIT.finditer(text):
        start, end = m.span()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        if end - start >= 16 and _LETTER.search(text, start, end):
            out.append((start, end))
    return out


def _deciding(text: str, windows: int) -> np.ndarray:
    """Which windows hold a place of a stretch: no other one can give a span, unless its pieces go on in one of these."""
    out, step = np.zeros(windows, bool), WINDOW - STRIDE
    for start, end in _stretches(text):
        out[max(0, (start - WINDOW) // step + 1) : (end - 1) // step + 1] = True
    return out


def reconcile(text: str, starts: list[int], tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of all windows of a text as one set: pieces of a kind that overlap or that a window's edge cuts are joined, base spans come first.

    A piece at an inner edge counts only together with the neighbour's piece that goes on there. Of spans that overlap
    the longer stays, then the earlier; spans that touch a base span go.
    """
    pieces: list[list] = []
    for at, row in zip(starts, tags):
        inside = np.flatnonzero(row)
        if not len(inside):
            continue
        kind = (row[inside] - 1) // 2
        begin = (row[inside] % 2 == 1) | np.r_[True, (np.diff(inside) > 1) | (np.diff(kind) != 0)]
        first = np.flatnonzero(begin)
        for lo, hi in zip(first, np.r_[first[1:], len(inside)]):
            a, b = int(inside[lo]), int(inside[hi - 1]) + 1
            end = min(at + b, len(text))
            if a + at < end:
                pieces.append([at + a, end, int(kind[lo]), a == 0 and at > 0, b == WINDOW and at + WINDOW < len(text)])
    pieces.sort()
    joined: list[list] = []
    for p in pieces:
        old = next((q for q in reversed(joined) if q[2] == p[2] and p[0] <= q[1] and (p[0] < q[1] or q[4] or p[3])), None)
        if old:
            if p[1] > old[1]:
                old[1], old[4] = p[1], p[4]
            elif p[1] == old[1]:
                old[4] = old[4] and p[4]
        else:
            joined.append(p)
    taken = [(s, e) for s, _, e in base]
    kept: list[Span] = []
    whole = [[*_snapped(text, *p[:3]), *p[2:]] for p in joined]
    for start, end, kind, cut_left, cut_right in sorted(whole, key=lambda p: (p[0] - p[1], p[0], p[2])):
        if start >= end or cut_left or cut_right or not _plausible(text[start:end], kind) or any(start < e and s < end for s, e in taken):
            continue
        taken.append((start, end))
        kept.append((start, kind, end))
    return kept


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4_000, span_windows: int = 700, varied_windows: int = 900, other_windows: int = 400) -> Tagger | None:
    """A tagger from labelled spans of a bounded sample, as they stand and in varied forms; None where the sample holds no span.

    The sample is ``sample_docs`` documents with the least hashes of their ids, one row for each id, and of their windows at most
    ``span_windows`` with spans as they stand, ``varied_windows`` with varied ones, and ``other_windows`` without.
    """
    ids = docs.select(F.col(id_col).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(sample_docs)
    kept = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids), "i")  # at most sample_docs ids
    sample = kept.groupBy("i").agg(F.min("text").alias("text")).select("text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, sort = [], [], []

            def add(text: str, spans: list[Span], with_spans: int) -> None:
                if starts := _marked_starts(text):
                    y = _labels(spans, starts)
                    xs.extend(r.tobytes() for r in _cut(encode(text), starts, TAUGHT))
                    ys.extend(r.tobytes() for r in y)
                    sort.extend(np.where(y.any(axis=1), with_spans, 0).tolist())

            for text in batch.column(0).to_pylist():
                spans = taught_spans(text)
                add(text, spans, 1)
                if spans:
                    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                    for _ in range(4):
                        add(*varied_text(text, spans, rng), 2)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary()), pa.array(sort, pa.int32())], ["x", "y", "sort"])

    cut = materialize(sample.mapInArrow(windows, "x binary, y binary, sort int"))
    rows = []
    for sort, bound in enumerate((other_windows, span_windows, varied_windows)):
        rows += cut.where(F.col("sort") == sort).dropDuplicates(["x", "y"]).orderBy(F.xxhash64("x"), "x", "y").limit(bound).collect()
    if not any(r.sort for r in rows):
        return None
    x = np.stack([np.frombuffer(bytes(r.x), np.uint8) for r in rows])
    y = np.stack([np.frombuffer(bytes(r.y), np.int8) for r in rows])
    return Tagger(1 + 2 * len(NAMES)).train(x, y)


def _spans_of(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text, as if all its windows were tagged; windows of several texts are decoded together.

    Windows whose pieces cannot pass ``_plausible`` are not sent, unless a neighbour that was sent has tags on the places
    that both share or at their edge, as pieces join there.
    """
    out: list[tuple[list[Span], list[Span]]] = [(base_spans(x), []) for x in texts]
    if tagger is None:
        return out
    held, owners, step = 0, [], WINDOW - STRIDE

    def work() -> None:
        sent = [(k, np.flatnonzero(wanted)) for k, (_, _, wanted, _) in enumerate(owners)]
        while sent:
            tags = tagger.decode(np.concatenate([_cut(owners[k][1], rows * step) for k, rows in sent]))
            low, high, some = tags[:, : STRIDE + 1].any(axis=1), tags[:, step - 1 :].any(axis=1), tags.any(axis=1)
            at, before, sent = 0, sent, []
            for k, rows in before:
                _, _, wanted, found = owners[k]
                here = slice(at, at + len(rows))
                found += zip((rows[some[here]] * step).tolist(), tags[here][some[here]])
                near = np.concatenate([rows[low[here]] - 1, rows[high[here]] + 1])
                near = np.unique(near[(near >= 0) & (near < len(wanted))])
                if len(near := near[~wanted[near]]):
                    wanted[near] = True
                    sent.append((k, near))
                at += len(rows)
        for i, _, _, found in owners:
            if found:
                starts, tags = zip(*sorted(found, key=lambda f: f[0]))
                out[i] = (out[i][0], sorted(reconcile(texts[i], list(starts), np.stack(tags), out[i][0])))

    for i, text in enumerate(texts):
        wanted = _deciding(text, len(_window_starts(text)))
        if wanted.any():
            owners.append((i, encode(text), wanted, []))
            held += int(wanted.sum())
        if held >= TOGETHER:
            work()
            held, owners = 0, []
    if held:
        work()
    return out


def find_spans(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> Column:
    """Column struct(base, added): arrays of struct(start, kind, end) in code points, end exclusive, by start, then kind as in ``NAMES``.

    Null texts count as empty and have no spans. Texts are read whole, however long. Without a tagger nothing is added.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("base array<struct<start:long,kind:string,end:long>>, added array<struct<start:long,kind:string,end:long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        name = lambda rows: [{"start": s, "kind": NAMES[k], "end": e} for s, k, e in rows]
        for column in batches:
            rows = [(name(a), name(b)) for a, b in _spans_of([x or "" for x in column], sent.value)]
            yield pd.DataFrame(rows, columns=["base", "added"])

    return spans.asNondeterministic()(F.col(text_col))  # else Spark repeats the search below a filter on its result


def cover(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its first span's kind in angle brackets."""
    parts, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            parts += [text[done:start], f"<{NAMES[kind]}>"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def redacted(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> Column:
    """The text with all its spans covered, found and replaced in one pass; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            found = _spans_of([x or "" for x in column], sent.value)
            yield pd.Series([x if not (a or b) else cover(x, a + b) for x, (a, b) in zip(column, found)], dtype=object)

    return run.asNondeterministic()(F.col(text_col))  # once, though the length is taken too


def in_order(spans: Column) -> Column:
    """Spans as text kind:start:end, by start, then kind as listed, comma-joined."""
    rank = F.array(*(F.lit(k) for k in NAMES))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
