"""Quality classification by co-training: a text view and a page-metadata view teach each other, then calibrated views are combined."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

#: Bound of the labelled sample: the labelled documents with the least hashes of their ids.
FIT_LABELLED = 12_000
TEXT_BUCKETS, META_BUCKETS = 1 << 18, 1 << 10
#: A bucket of the text view has a weight only if so many sampled documents hold it.
LEAST_DOCS = 5
ROUNDS = 3
#: A view labels every document without a label at this confidence. About so many of each class, dealt out evenly over
#: all that it labels, join the rows that the other view is fitted on in a round.
SURE, HANDED = 0.95, 400
#: One labelled document in so many is kept for calibration.
CALIBRATION = 4

_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_DIGITS, _CAPITALS = b"0123456789", bytes(range(65, 91))


def text_features(text: str) -> np.ndarray:
    """Buckets of the content: each lower-cased word without its edge signs, each word's closing signs, and repetition."""
    words = text.encode("utf-8", "surrogatepass").split()
    found = {w.lower().strip(_SYMBOLS) for w in words}
    out = {zlib.crc32(w) % TEXT_BUCKETS for w in found if w}
    tails = [w[len(w.rstrip(_SYMBOLS)) :] for w in words]
    for tail in set(tails) - {b""}:
        share = tails.count(tail) / len(words)
        out.add(zlib.crc32(b"\0tail" + tail + bytes([min(9, int(share * 10))])) % TEXT_BUCKETS)
    if words:
        again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out.add(zlib.crc32(b"\0again" + bytes([int(again * 10)])) % TEXT_BUCKETS)
        fresh = len(found) / len(words)
        out.add(zlib.crc32(b"\0fresh" + bytes([int(fresh * 10)])) % TEXT_BUCKETS)
    return np.array(sorted(out), np.int64)


def meta_features(text: str, meta: tuple) -> np.ndarray:
    """Buckets of what a page says about itself and how it is laid out: its columns, its size, lines, and shares of character kinds."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    lines = data.count(b"\n") + 1
    share = lambda kinds: len(data) - len(data.translate(None, kinds))
    keys = [f"{i}={value}" for i, value in enumerate(meta)]
    keys += [f"size{int(2 * log1p(len(data)))}", f"line{int(2 * log1p(n / lines))}", f"blank{int(50 * share(b' ') / n)}"]
    keys += [f"{name}{min(20, int(100 * share(kinds) / n))}" for name, kinds in (("digit", _DIGITS), ("capital", _CAPITALS), ("sign", _SYMBOLS))]
    return np.array(sorted({zlib.crc32(k.encode()) % META_BUCKETS for k in keys}), np.int64)


@dataclass
class Sparse:
    """Rows of present buckets."""

    at: np.ndarray
    first: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[np.ndarray], size: int) -> "Sparse":
        counts = [len(r) for r in rows]
        return cls(np.concatenate([*rows, np.zeros(0, np.int64)]), np.r_[0, np.cumsum(counts, dtype=np.int64)], size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0.0, np.cumsum(w[self.at])][self.first])

    def rows(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.at[self.first[i] : self.first[i + 1]] for i in which]

    def take(self, which: np.ndarray) -> "Sparse":
        return Sparse.of(self.rows(which), self.size)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on present buckets, by full-batch Adam with weight decay."""

    size: int
    w: np.ndarray = field(init=False)
    b: float = 0.0

    def __post_init__(self) -> None:
        self.w = np.zeros(self.size)

    def fit(self, x: Sparse, y: np.ndarray, steps: int = 80, rate: float = 0.1, decay: float = 0.002) -> "Logistic":
        counts = np.bincount(x.at, minlength=self.size)
        used = counts >= min(LEAST_DOCS, max(1, len(y) // 20))
        keep = used[x.at]
        row = np.repeat(np.arange(len(y)), np.diff(x.first))[keep]
        at = x.at[keep]
        columns, local = np.unique(at, return_inverse=True)
        w, b = self.w[columns], self.b or float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for k in range(1, steps + 1):
            wrong = _sigmoid(np.bincount(row, weights=w[local], minlength=len(y)) + b) - y
            g = np.r_[np.bincount(local, weights=wrong[row], minlength=len(w)) / len(y) + decay * w * 0.1, wrong.mean()]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.w = np.zeros(self.size)
        self.w[columns], self.b = w, float(b)
        return self

    def logit(self, x: Sparse) -> np.ndarray:
        return x.dot(self.w) + self.b


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a small logistic regression on the columns of ``z`` and a constant: Newton steps with a ridge."""
    x = np.hstack([z, np.ones((len(z), 1))])
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - t) + 1e-3 * w)
    return w


@dataclass
class CoTrained:
    """One target: both views, their calibration, and the weights that combine them."""

    text: Logistic
    meta: Logistic
    text_scale: np.ndarray
    meta_scale: np.ndarray
    joint: np.ndarray
    constant: float | None = None

    def scores(self, text: Sparse, meta: Sparse) -> np.ndarray:
        """Columns: probability by the text view, by the metadata view, and combined."""
        if self.constant is not None:
            return np.full((len(text.first) - 1, 3), self.constant)
        a, b = (_sigmoid(np.clip(v.logit(x), -20, 20) * s[0] + s[1]) for v, x, s in ((self.text, text, self.text_scale), (self.meta, meta, self.meta_scale)))
        logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        return np.stack([a, b, _sigmoid(np.stack([logit(a), logit(b)], axis=1) @ self.joint[:2] + self.joint[2])], axis=1)


#: What one view hands to the other: (key of a row, its features in the other view, label).
Handed = list[tuple[int, np.ndarray, int]]


def surest_in(text: Sparse, meta: Sparse, handed: int) -> Callable[[int, Logistic, Logistic], tuple[Handed, Handed]]:
    """``surest`` of ``co_train`` for rows in memory."""

    def surest(k: int, by_text: Logistic, by_meta: Logistic) -> tuple[Handed, Handed]:
        deal = np.random.default_rng(k).permutation(len(text.first) - 1)
        out: tuple[Handed, Handed] = ([], [])
        for to, own, p in ((0, text, _sigmoid(by_meta.logit(meta))), (1, meta, _sigmoid(by_text.logit(text)))):
            for label, sure in ((1, p >= SURE), (0, p <= 1 - SURE)):
                at = deal[sure[deal]][:handed]
                out[to].extend((int(j), x, label) for j, x in zip(at, own.rows(at)))
        return out

    return surest


def co_train(text: Sparse, meta: Sparse, y: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED, surest: Callable[[int, Logistic, Logistic], tuple[Handed, Handed]] | None = None) -> CoTrained:
    """``y``: 1, 0, or -1 where a row has no label. In each round a view's confident pseudo-labels join the other view's rows.

    ``surest(round, text view, metadata view)`` gives what the text view and what the metadata view get; by default out of
    the rows without a label. The first label that a view gets for a row stays. With one class only, or without labels,
    every score is the share of ones (0.5 without labels).
    """
    known = np.flatnonzero(y >= 0)
    if len(known) < 8 or len(set(y[known])) < 2:
        mean = float(y[known].mean()) if len(known) else 0.5
        return CoTrained(Logistic(TEXT_BUCKETS), Logistic(META_BUCKETS), np.zeros(2), np.zeros(2), np.zeros(3), mean)
    check = np.zeros(len(y), bool)
    for label in (0, 1):
        check[np.flatnonzero(y == label)[::CALIBRATION]] = True
    train, check, pool = np.flatnonzero((y >= 0) & ~check), np.flatnonzero(check), np.flatnonzero(y < 0)
    surest = surest or surest_in(text.take(pool), meta.take(pool), handed)
    views = [(text, Logistic(text.size)), (meta, Logistic(meta.size))]
    given: list[dict[int, tuple[np.ndarray, int]]] = [{}, {}]
    for k in range(rounds + 1):
        for (x, model), extra in zip(views, given):
            rows, labels = zip(*extra.values()) if extra else ((), ())
            model.fit(Sparse.of([*x.rows(train), *rows], x.size), np.r_[y[train], np.array(labels, np.int64)].astype(float), steps=80 if k == 0 else 30)
        if k == rounds:
            break
        for extra, got in zip(given, surest(k, views[0][1], views[1][1])):
            for key, row, label in got:
                extra.setdefault(key, (row, label))
    target = y[check].astype(float)
    raw = [np.clip(model.logit(x.take(check)), -20, 20) for x, model in views]
    scales = [_platt(z[:, None], target) for z in raw]
    logits = np.stack([z * s[0] + s[1] for z, s in zip(raw, scales)], axis=1)
    return CoTrained(views[0][1], views[1][1], *scales, _platt(logits, target))


_META = ("lang", "source")
_VIEWS = (("text", TEXT_BUCKETS), ("meta", META_BUCKETS))


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, meta): the buckets of both views of each row, from its whole text. Null texts are empty ones, null metadata is a value of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, *meta = (part.column(i).to_pylist() for i in range(1, 2 + len(_META)))
                texts = [x or "" for x in texts]
                made = ([text_features(x) for x in texts], [meta_features(x, m) for x, m in zip(texts, zip(*meta))])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x.astype(np.int32) for x in v], pa.list_(pa.int32())) for v in made)], ["doc_id", "text", "meta"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_META).mapInArrow(run, f"doc_id {kind}, text array<int>, meta array<int>")


def _sparse(batch: pa.RecordBatch | pa.Table, view: str, size: int) -> Sparse:
    column = batch[view]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return Sparse(column.flatten().to_numpy().astype(np.int64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(), dtype=np.int64)], size)


def _written(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The written table of ``featured``, with a number for each row and a key for equal features."""
    return materialize(featured(docs, id_col, text_col).withColumns({"row": F.monotonically_increasing_id(), "key": F.xxhash64("text", "meta")}))


def _surest_of(rows: DataFrame, marked: DataFrame, handed: int) -> Callable[[int, Logistic, Logistic], tuple[Handed, Handed]]:
    """``surest`` of ``co_train`` over all ``rows`` whose id is not ``marked``: both views score each of them in Spark.

    Rows of equal features count once. What comes to the driver is about 4 x ``handed`` rows, whatever the corpus: a view's
    labels are thinned by a hash to that share of their number.
    """

    def surest(k: int, by_text: Logistic, by_meta: Logistic) -> tuple[Handed, Handed]:
        sent = rows.sparkSession.sparkContext.broadcast((by_text, by_meta))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = [_sigmoid(m.logit(_sparse(batch, *v))) for m, v in zip(sent.value, _VIEWS)]
                label = [np.where(x >= SURE, 1, np.where(x <= 1 - SURE, 0, -1)) for x in p]
                made = pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "row", "key")), *map(pa.array, label)], ["doc_id", "row", "key", "by_text", "by_meta"])
                yield made.filter(pa.array((label[0] >= 0) | (label[1] >= 0)))

        schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, key long, by_text long, by_meta long"
        scored = rows.where("doc_id is not null").select("doc_id", "row", "key", "text", "meta").mapInArrow(run, schema)
        sure = scored.join(marked, "doc_id", "left_anti").groupBy("key").agg(F.min("row").alias("row"), F.any_value("by_text").alias("by_text"), F.any_value("by_meta").alias("by_meta"))
        sure = materialize(sure)
        chance = F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
        picked = F.lit(False)
        for view in ("by_text", "by_meta"):
            for label, n in sure.where(F.col(view) >= 0).groupBy(view).count().collect():  # two rows
                picked = picked | ((F.col(view) == label) & (chance < handed / n))
        rare = sure.where(picked).select("row", "by_text", "by_meta", chance.alias("chance"))
        got = rows.select("row", "key", "text", "meta").join(F.broadcast(rare), "row").toArrow().sort_by("key")  # about 4 x handed rows
        keys, text, meta = got["key"].to_pylist(), *(_sparse(got, *v) for v in _VIEWS)
        out: tuple[Handed, Handed] = ([], [])
        for to, own, labels in ((0, text, got["by_meta"].to_pylist()), (1, meta, got["by_text"].to_pylist())):
            out[to].extend((key, x, label) for key, x, label in zip(keys, own.rows(range(len(keys))), labels) if label >= 0)
        return out

    return surest


def _fit_rows(rows: DataFrame, labels: DataFrame, targets: tuple[str, ...], id_col: str, labelled: int, handed: int, rounds: int) -> dict[str, CoTrained]:
    marks = materialize(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(*(F.min(t).cast("int").alias(t) for t in targets)))
    ids = rows.select("doc_id").where("doc_id is not null").distinct()
    chosen = materialize(marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("key", "row")).alias("x"), *(F.any_value(t).alias(t) for t in targets))
    one = materialize(one.select(F.col("x.row").alias("row"), *targets))  # at most ``labelled`` narrow rows, one for each id
    found = rows.select("doc_id", "row", "text", "meta").join(F.broadcast(one), "row").toArrow().sort_by("doc_id")
    text, meta = (_sparse(found, *v) for v in _VIEWS)
    models = {}
    for t in targets:
        y = np.array([-1 if v is None else int(v > 0) for v in found[t].to_pylist()], np.int64)
        models[t] = co_train(text, meta, y, rounds, handed, _surest_of(rows, marks.where(F.col(t).isNotNull()).select("doc_id"), handed))
    return models


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", labelled: int = FIT_LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> dict[str, CoTrained]:
    """A model for each target column of ``labels``, co-trained on at most ``labelled`` labelled documents and on all others.

    In each round both views score every document without a label for the target; see ``HANDED`` for what they hand on.
    Repeated labels of an id: the least value of the row counts; of repeated ids one row is read. Null labels are none.
    Null ids take no part in fitting.
    """
    return _fit_rows(_written(docs, id_col, text_col), labels, targets, id_col, labelled, handed, rounds)


def _classified(rows: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(models)
    names = [f"{t}_{v}" for t in models for v in ("text", "meta", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                text, meta = (_sparse(part, *v) for v in _VIEWS)
                columns = [c for m in sent.value.values() for c in m.scores(text, meta).T]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "meta").mapInArrow(run, f"doc_id {kind}" + "".join(f", {c} double" for c in names))


def classify(docs: DataFrame, models: dict[str, CoTrained], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, and for each target t: t_text, t_meta, t_score): probabilities for every row, repeated rows included.

    Null texts are scored as empty ones, null metadata as a value of its own. Texts are read whole.
    """
    return _classified(featured(docs, id_col, text_col), models)


def fit_and_classify(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", labelled: int = FIT_LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> DataFrame:
    """``classify`` of all rows by ``fit`` on them; features are made once for both."""
    rows = _written(docs, id_col, text_col)
    return _classified(rows, _fit_rows(rows, labels, targets, id_col, labelled, handed, rounds))
