"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions, smoothed scores."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

#: Words with a class of their own choice, whose counts travel with the model; the words beyond meet their counts in a join,
#: where none of them can be hot, and have the class of all such words with the same last two bytes.
FREQUENT = 50_000
SUFFIX_UNITS = 256
#: The most frequent words, and bundles of the others, first exchange classes one by one. Then each other word chooses in rounds.
SEEDS = 1_000
CLASSES = 32
#: Passes of the exchange over the seeds; it ends earlier when none moves.
EXCHANGES = 12
#: Rounds in which each frequent word that is no seed, and each suffix unit, takes its best class.
ROUNDS = 1
SMOOTHING = 0.1
#: Distinct words or pairs that a task counts before it hands them on.
FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end token is not in the list."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _suffix_unit(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIX_UNITS


class Vocabulary:
    """The frequent words with their counts, and the unit of every word: 0 is the end of a text, then the frequent words, then the suffixes."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.ids = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.suffix = np.array([_suffix_unit(w) for w in words], np.int64)
        self.units = 1 + len(words) + SUFFIX_UNITS

    def bundled(self, seeds: int) -> np.ndarray:
        """For each unit its place among the end, the seeds, and the suffixes of all other words."""
        own = np.arange(len(self.suffix))
        return np.r_[0, np.where(own < seeds, 1 + own, 1 + seeds + self.suffix), 1 + seeds + np.arange(SUFFIX_UNITS)]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Id of each word, -1 for the others; unit of each word; the other words in order."""
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        units = ids + 1
        missing = np.flatnonzero(ids < 0)
        rare = [words[i] for i in missing.tolist()]
        if rare:
            units[missing] = 1 + len(self.ids) + np.fromiter(map(_suffix_unit, rare), np.int64, len(rare))
        return ids, units, rare


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = EXCHANGES) -> np.ndarray:
    """The class of each unit: units move one by one to the class that raises the likelihood of the class bigrams most.

    ``pairs`` counts (unit, next unit). Unit 0, the end of a text, stays alone in class 0. Units start dealt out in turn
    by frequency; ties go to the lower class.
    """
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    of = np.zeros(len(pairs), np.int64)
    order = [u for u in np.argsort(-total, kind="stable") if u]
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[of]
    grid = member.T @ pairs @ member
    for _ in range(passes):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            to = np.bincount(of, weights=pairs[u], minlength=classes)
            fro = np.bincount(of, weights=pairs[:, u], minlength=classes)
            own, was = pairs[u, u], of[u]
            to[was] -= own
            fro[was] -= own

            def shift(g: int, sign: int) -> None:
                grid[g, :] += sign * to
                grid[:, g] += sign * fro
                grid[g, g] += sign * own

            shift(was, -1)
            before = _xlogx(grid)
            out = (_xlogx(grid + to) - before).sum(axis=1) + (_xlogx(grid.T + fro) - before.T).sum(axis=1)
            d = np.diagonal(grid)
            out += _xlogx(d + to + fro + own) - _xlogx(d + to) - _xlogx(d + fro) + _xlogx(d)
            rows, cols = grid.sum(axis=1), grid.sum(axis=0)
            out -= _xlogx(rows + pairs[u].sum()) - _xlogx(rows) + _xlogx(cols + pairs[:, u].sum()) - _xlogx(cols)
            out[0] = -np.inf
            best = int(out.argmax())
            if out[best] <= out[was] + 1e-9:
                best = was
            shift(best, 1)
            of[u] = best
            moved += best != was
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """A fitted model; ``rare_counts`` is the table (word, n) of all training words, which scoring joins."""

    vocabulary: Vocabulary
    class_of: np.ndarray
    log_next: np.ndarray
    log_floor: np.ndarray
    train_tokens: int
    train_texts: int
    distinct: int
    rare_counts: DataFrame


def _line(column: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """The units of all rows in one line, each row closed by an end; rows are texts, or units that were looked up before."""
    if pa.types.is_list(column.type):
        flat, sizes = column.flatten().to_numpy().astype(np.int64), column.value_lengths().to_numpy()
    else:
        rows = [tokens(x.as_py()) for x in column]
        flat, sizes = vocabulary.look_up(list(chain.from_iterable(rows)))[1], np.fromiter(map(len, rows), np.int64, len(rows))
    line = np.zeros(len(flat) + len(sizes), np.int64)
    inside = np.ones(len(line), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    line[inside] = flat
    return line


def _in_tasks(docs: DataFrame, vocabulary: Vocabulary, fold: np.ndarray, cells: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray]:
    """A function for ``mapInArrow`` tasks: batches of rows to sums over ``cells`` cells; ``keys`` gives those of a line by its units and their folds."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        (known, to), sums, part, held = sent.value, np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                line = _line(batch.column(0).slice(lo, 200), known)
                part.append(keys(line, to[line]))
                held += len(part[-1])
                if held > 2_000_000:
                    sums += np.bincount(np.concatenate(part), minlength=cells)
                    part, held = [], 0
        return sums + np.bincount(np.concatenate(part), minlength=cells) if part else sums

    return run


def _pairs(docs: DataFrame, col: str, vocabulary: Vocabulary, fold: np.ndarray) -> np.ndarray:
    """Counts of (a, b) for neighbours in all rows of ``col`` (texts, or units), units folded by ``fold``; at most the square of its size comes to the driver, whatever the corpus."""
    size = int(fold.max()) + 1

    def keys(line: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.r_[0, at[:-1]] * size + at

    summed = _in_tasks(docs, vocabulary, fold, size * size, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(batches)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])

    found = docs.select(col).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(size * size)
    pairs[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return pairs.reshape(size, size)


def _neighbours(docs: DataFrame, col: str, vocabulary: Vocabulary, class_of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit how often each class stands before and after it; units x 2 x classes sums come to the driver, whatever the corpus."""
    wide = 2 * classes

    def keys(line: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = np.flatnonzero(line)  # an end stands after each, so each has a neighbour on both sides
        own = line[word] * wide
        return np.r_[own + np.r_[0, at][word], own + classes + at[word + 1]]

    summed = _in_tasks(docs, vocabulary, class_of, vocabulary.units * wide, keys)
    names = [f"c{k}" for k in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(batches).reshape(-1, wide)
        at = np.flatnonzero(sums.any(axis=1))
        for lo in range(0, len(at), 5_000):
            part = at[lo : lo + 5_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.ascontiguousarray(c)) for c in sums[part].T)], ["unit", *names])

    schema = "unit long" + "".join(f", {c} long" for c in names)
    found = docs.select(col).mapInArrow(run, schema).groupBy("unit").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    sums = np.zeros((vocabulary.units, wide))
    sums[found["unit"].to_numpy()] = np.stack([found[c].to_numpy() for c in names], axis=1)
    return sums[:, :classes], sums[:, classes:]


def choose(class_of: np.ndarray, before: np.ndarray, after: np.ndarray, still: np.ndarray) -> np.ndarray:
    """The class of each unit after one round: all choose at once the class that raises the likelihood most, ``still`` ones stay.

    ``before`` and ``after`` count the classes beside each unit. A unit's own counts are taken out of the class that it
    is in. Class 0 is the end's alone; units that do not occur stay.
    """
    classes = before.shape[1]
    grid = np.zeros((classes, classes))
    np.add.at(grid, class_of, after)
    grid[0] = np.bincount(class_of, weights=before[:, 0], minlength=classes)
    n, half = after.sum(axis=1), 0.5
    log, rows, cols = np.log(grid + half), grid.sum(axis=1), grid.sum(axis=0)
    mass = lambda x: np.log(np.maximum(x, 0) + half * classes)
    gain = after @ log.T + before @ log - n[:, None] * (mass(rows) + mass(cols))
    left = lambda x: np.log(np.maximum(x, 0) + half)
    own = (after * left(grid[class_of] - after)).sum(axis=1) + (before * left(grid.T[class_of] - before)).sum(axis=1)
    own -= n * (mass(rows[class_of] - n) + mass(cols[class_of] - n))
    gain[:, 0] = -np.inf
    gain[np.arange(len(gain)), class_of] = own
    best = gain.argmax(axis=1)
    moves = ~still & (n > 0) & (gain[np.arange(len(gain)), best] > own + 1e-9)
    return np.where(moves, best, class_of)


def vocabulary_of(docs: DataFrame, text_col: str, frequent: int) -> tuple[DataFrame, Vocabulary]:
    """The written counts of all words, and the ``frequent`` most frequent ones of them."""
    counts = materialize(word_counts(docs, text_col))
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    return counts, Vocabulary([bytes(x.word) for x in top], [x.n for x in top])


def look_up_all(docs: DataFrame, vocabulary: Vocabulary, text_col: str, *keep: str) -> DataFrame:
    """(kept columns, units, rare, times, row): the written table of each text's units in order, and how often it has each word that is not frequent.

    Every later pass reads this table, so a text is cut into words once for the counts and once here.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, units, words, times = batch.slice(lo, 200), [], [], []
                for text in part.column(0):
                    _, own, rare = sent.value.look_up(tokens(text.as_py()))
                    seen = Counter(rare)
                    units.append(own.astype(np.int32))
                    words.append(list(seen))
                    times.append(list(seen.values()))
                made = [pa.array(units, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], [*keep, "units", "rare", "times"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    found = docs.select(text_col, *keep).mapInArrow(run, f"{kinds}units array<int>, rare array<binary>, times array<long>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()))


def _fit_units(rows: DataFrame, counts: DataFrame, vocabulary: Vocabulary, seeds: int, classes: int, rounds: int) -> ClassModel:
    """The model of looked-up ``rows``, whose words have ``counts``."""
    last = F.col("word").substr(F.greatest(F.lit(1), F.length("word") - 1), F.lit(2))
    suffix = (F.crc32(last) % SUFFIX_UNITS).alias("unit")
    by_unit = counts.groupBy(suffix).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # at most SUFFIX_UNITS rows
    own = len(vocabulary.ids)
    bundled = vocabulary.bundled(seeds)
    of = exchange(_pairs(rows, "units", vocabulary, bundled), classes)[bundled]
    still = np.arange(vocabulary.units) <= min(seeds, own)
    for _ in range(rounds):
        of = choose(of, *_neighbours(rows, "units", vocabulary, of, classes), still)
    found = _pairs(rows, "units", vocabulary, of)
    grid = np.zeros((classes, classes))
    grid[: len(found), : len(found)] = found
    distinct = np.r_[0, np.ones(own), -np.bincount(vocabulary.suffix, minlength=SUFFIX_UNITS)]
    for x in by_unit:
        distinct[1 + own + x.unit] += x.v
    kinds_in = np.bincount(of, weights=distinct, minlength=classes)
    texts, words = int(grid[0].sum()), sum(x.n for x in by_unit)
    size = grid.sum(axis=0)
    once = (size + SMOOTHING) / (size.sum() + SMOOTHING * classes)
    seen, kinds = grid.sum(axis=1, keepdims=True), (grid > 0).sum(axis=1, keepdims=True)
    follow = np.where(seen > 0, (grid + kinds * once) / np.maximum(seen + kinds, 1), once)
    floor = np.log10(size + SMOOTHING * (kinds_in + 1))
    floor[0] = 0.0  # an end has its class to itself: its emission is certain, see score
    return ClassModel(vocabulary, of, np.log10(follow), floor, words + texts, texts, sum(x.v for x in by_unit) + (texts > 0), counts)


def _score_units(rows: DataFrame, model: ClassModel, id_col: str) -> DataFrame:
    """The scores of looked-up ``rows``; see ``score``."""
    light = (model.vocabulary, model.class_of, model.log_next, model.log_floor)
    sent = rows.sparkSession.sparkContext.broadcast(light)
    n, v, ends = model.train_tokens, model.distinct, model.train_texts
    log_base = float(np.log10(n + SMOOTHING * (v + 1)))
    end_base = float(np.log10(ends + SMOOTHING)) - log_base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, class_of, log_next, log_floor = sent.value
        log_count = np.zeros(vocabulary.units)
        log_count[1 : 1 + len(vocabulary.counts)] = np.log10(vocabulary.counts + SMOOTHING)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                line, sizes = _line(part["units"], vocabulary), part["units"].value_lengths().to_numpy().astype(np.int64)
                row, at = np.repeat(np.arange(len(sizes)), sizes + 1), class_of[line]
                of_row = lambda x: np.bincount(row, weights=x, minlength=len(sizes))  # noqa: E731, B023
                frequent = of_row(log_count[line])
                path = of_row(log_next[np.r_[0, at[:-1]], at] - log_floor[at])
                known = of_row((line > 0) & (line <= len(vocabulary.counts))).astype(np.int64) + (ends > 0)
                columns = (sizes + 1, known, frequent - sizes * log_base + end_base, frequent + path)
                yield pa.RecordBatch.from_arrays([part["row"], part[id_col], *map(pa.array, columns)], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    schema = f"row long, doc_id {rows.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    scored = rows.select("row", id_col, "units").mapInArrow(run, schema)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(model.rare_counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    added = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + SMOOTHING)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    out = out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fit(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT, seeds: int = SEEDS, classes: int = CLASSES, rounds: int = ROUNDS) -> ClassModel:
    """Learn from every row of ``docs``: null and empty texts are an end alone. Without rows every probability falls back to smoothing.

    The ``seeds`` most frequent words exchange classes one by one; in each round all ``frequent`` words but these, and the
    suffixes of the words beyond, choose a class by the classes beside them in all texts.

    Emissions: (n(word) + 0.1) / (n(class) + 0.1 (distinct words of the class + 1)), so each class keeps a share for a
    word not seen. Transitions: Witten-Bell mixture of class bigram and class unigram, the latter add-0.1.
    """
    counts, vocabulary = vocabulary_of(docs, text_col, frequent)
    return _fit_units(look_up_all(docs, vocabulary, text_col), counts, vocabulary, seeds, classes, rounds)


def score(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity): one row for each input row, repeated rows included.

    base_score is the add-0.1 unigram, score the class model's log10 probability of the whole text with its end. Words
    outside the frequent ones are looked up by a join of (row, word, times); their counts are too even for a hot key.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    return _score_units(look_up_all(texts, model.vocabulary, "text", "doc_id"), model, "doc_id")


def fit_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, seeds: int = SEEDS, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """``fit`` on the rows where ``learn`` is true, and ``score`` of all rows; texts are looked up once for both."""
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), learn.alias("learn"))
    counts, vocabulary = vocabulary_of(texts.where("learn"), "text", frequent)
    rows = look_up_all(texts, vocabulary, "text", "doc_id", "learn")
    model = _fit_units(rows.where("learn"), counts, vocabulary, seeds, classes, rounds)
    return model, _score_units(rows, model, "doc_id")
