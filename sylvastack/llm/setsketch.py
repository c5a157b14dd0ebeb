"""Near-duplicates by SetSketch registers: banded registers find candidates, a joint likelihood rules out, full sets decide.

Register i of a set is the least of its elements' exponential draws i, on a scale of powers of b close to 1, truncated to 16
bits. Registers of a union are the larger ones of its parts. Two sets of similarity J have each register equal with a
probability of about J, so sets at the threshold share one of the bands nearly always (see ``fit_bands``). How often one
set's register is above, below or equal to the other's has a likelihood in J alone, as the sizes are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .neardup import BITS, SLOTS, _words, prefix_keys, shingle_set
from .workspace import cleaned, in_files, materialize

#: Scale of the registers: base, rate and largest value.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Registers of a band, and how likely a pair right at the threshold may be to share no band.
WIDTH, MISSED = 5, 1e-6
#: A pair goes unchecked only if the best similarity is so many times likelier (as a logarithm) than the threshold: over five standard deviations.
RULED_OUT = 15.0
#: Texts of a bucket that are compared with all others of it in one round; the next one takes so many times more.
MORE_LEADS = 16
#: A bucket of more texts that one round leaves open is dealt out by the rare shingles of its sets.
BUCKET = 16
#: Low bits of registers that travel with a row, and how likely a pair at the threshold may differ in more of them than is let through.
BITS_KEPT, BITS_MISSED = 128, 1e-7
_ROUND = 256


def fit_bands(similarity: float, width: int = WIDTH, missed: float = MISSED) -> int:
    """Bands of ``width`` registers, so many that a pair at ``similarity`` shares none of them with a probability of ``missed`` at most."""
    return ceil(log(missed) / log(1 - similarity**width))


def _draws(registers: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2021)
    return rng.integers(0, 1 << 63, registers, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, registers, np.uint64) * np.uint64(2)


def sketch(hashes: np.ndarray, registers: int) -> np.ndarray:
    """Registers of a set of 64-bit hashes; of an empty one all zero."""
    factor, shift = _draws(registers)
    least = np.full(registers, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _ROUND):
        least = np.minimum(least, (hashes[at : at + _ROUND, None] * factor + shift).min(axis=0))
    if not len(hashes):
        return np.zeros(registers, np.uint16)
    # The least of uniform numbers turns into the least of exponential ones, as the one grows with the other.
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(draw, 1e-300)) / log(BASE)), 0, LARGEST).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(above: np.ndarray, below: np.ndarray, equal: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of ``similarity``, for sets of sizes ``na`` and ``nb`` whose registers compare so often in each way."""
    u = na / (na + nb)
    v = 1 - u
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log(BASE)
    more, less = chance(u - v * similarity), chance(v - u * similarity)
    term = lambda n, p: np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0)
    return term(above, more) + term(below, less) + term(equal, 1 - more - less)


def open_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float, grid: int = 64) -> np.ndarray:
    """Whether the registers (a row each) leave it open that two sets reach ``similarity``: false only where a lower one is likelier by ``RULED_OUT``."""
    above, below, equal = (x.sum(axis=1).astype(np.float64) for x in (a > b, a < b, a == b))
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    best = np.full(len(above), -np.inf)
    for share in np.linspace(0, 1, grid):
        best = np.maximum(best, log_likelihood(above, below, equal, na, nb, share * np.minimum(most, similarity)))
    there = log_likelihood(above, below, equal, na, nb, np.minimum(most, similarity))
    return (most >= similarity - 1e-9) & (there >= best - RULED_OUT)


def low_bits(registers: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers with the lowest bit of the first registers of each row: equal registers agree, others by chance."""
    bits = np.zeros((len(registers), BITS_KEPT), np.uint8)
    kept = registers[:, :BITS_KEPT] & 1
    bits[:, : kept.shape[1]] = kept
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)


def most_unlike(registers: int, similarity: float) -> int:
    """In how many low bits two sets at ``similarity`` can differ: more have a probability of ``BITS_MISSED`` at most."""
    n, p = min(registers, BITS_KEPT), (1 - similarity) / 2
    tail = 0.0
    for k in range(n, -1, -1):
        tail += comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > BITS_MISSED:
            return k
    return 0


def _node(hashes: np.ndarray) -> bytes:
    """A set's key in joins: a 128-bit digest of all its hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


@cleaned
def set_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """(id, n, component): for every row its number of distinct shingles and the smallest id that it reaches over links.

    Sets are linked if 100 times their common shingles are at least ``percent`` times their union; every link is confirmed
    on full sets. Fewer words than ``shingle``: one shingle of them all. Null, empty and blank texts have an empty set,
    are linked with nothing and are their own component. Rows that repeat an id each give a row and are told apart by
    their sets. Null ids take part; component is null only where no id of the group is known. Empty table: empty
    result. Other columns are not read.

    Equal sets are one node from the start. A bucket of one band compares its nodes with a lead, then with 16 times as
    many in each round, until every pair of it was looked at or is in one component. A bucket of over ``BUCKET`` nodes that
    is still open after the first round is dealt out by the first shingles of its sets, rare ones first, so many that no
    pair at the threshold is without a common one; so texts that share a frequent passage only do not meet again.
    """
    spark, similarity = docs.sparkSession, percent / 100
    bands = fit_bands(similarity, width)
    registers = bands * width
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("spot", F.xxhash64("id", "text"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                nodes, sizes, made = [], [], []
                for text in part["text"]:
                    hashes = shingle_set(_words(text.as_py()), shingle)
                    sizes.append(len(hashes))
                    nodes.append(_node(hashes) if len(hashes) else None)
                    made.append(sketch(hashes, registers).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([part["id"], part["spot"], _binary(nodes), pa.array(sizes, pa.int64()), _binary(made)], ["id", "spot", "node", "n", "registers"])

    table = materialize(rows.mapInArrow(sketches, f"id {kind}, spot long, node binary, n long, registers binary"))
    nodes = materialize(table.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("spot").alias("spot"), F.any_value("n").alias("n"), F.any_value("registers").alias("registers")))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                keys = [xxhash.xxh3_64_intdigest(x[at * width * 2 : (at + 1) * width * 2], at) for x in part["registers"].to_pylist() for at in range(bands)]
                each = pa.array(np.repeat(np.arange(part.num_rows), bands))
                bits = low_bits(np.frombuffer(b"".join(part["registers"].to_pylist()), np.uint16).reshape(-1, registers))
                low = [pa.array(bits[:, i]).take(each) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), part["node"].take(each), part["n"].take(each), *low], ["key", "node", "n", "low0", "low1"])

    def bucketed(keyed: DataFrame) -> DataFrame:
        """Rows whose key has at least two of them. The counts are written, so that AQE can split a hot key of the join."""
        counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1))
        return keyed.join(counts, "key")

    live = materialize(bucketed(nodes.select("node", "n", "registers").mapInArrow(banded, "key long, node binary, n long, low0 long, low1 long")))
    # A text that meets many others is more often the one that they were copied from, so it leads first.
    degrees = materialize(live.groupBy("node").agg(F.sum("size").alias("degree")))
    live = materialize(live.drop("size").join(degrees, "node").withColumns({"root": F.col("node"), "pos": F.lit(0)}))

    marks = nodes.join(degrees.select("node"), "node", "left_semi").select(F.col("spot").bitwiseAND(F.lit(BITS - 1)).alias("at"))
    marks = marks.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)  # of fixed size; where it is full, more texts are looked at
    bitmap[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["spot"].to_numpy() & (BITS - 1)
            batch = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))
            for lo in range(0, batch.num_rows, 500):
                made = [shingle_set(_words(x.as_py()), shingle) for x in batch["text"].slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([_binary([_node(x) for x in made]), pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))], ["node", "set"])

    met = rows.select("text", "spot").mapInArrow(full_sets, "node binary, set array<long>")
    sets = materialize(met.join(degrees.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    # How many nodes and sets a join reads, which its tasks are counted by.
    distinct, held = nodes.count(), sets.count()

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4_096):
                part = batch.slice(lo, 4_096)
                a, b = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint16).reshape(-1, registers) for c in ("ra", "rb"))
                yield part.select(["a", "b"]).filter(pa.array(open_pairs(a, b, part["na"].to_numpy(), part["nb"].to_numpy(), similarity)))

    def linked(pairs: DataFrame, rows: int) -> DataFrame:
        """Those of ``rows`` pairs (a, b) that are links."""
        of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("registers").alias("r" + x))
        left = materialize(in_files(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(likely, "a binary, b binary"), max(rows, distinct), 4_096))
        if left.isEmpty():
            return left
        both = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        return materialize(in_files(both.where(common * 100 >= (F.size("s") + F.size("t") - common) * percent).select("a", "b"), max(rows, held), 1_024))

    def dealt_again(hot: DataFrame) -> DataFrame:
        """The nodes of hot buckets by the first shingles of their sets, in order of how many of those nodes have a shingle's slot."""
        facts = ("n", "low0", "low1", "degree", "root")
        own = materialize(hot.groupBy("node").agg(*(F.any_value(c).alias(c) for c in facts)))
        slots = sets.join(own.select("node"), "node", "left_semi").select(F.explode("set").alias("x")).groupBy(F.pmod("x", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
        counts = slots.where("n > 1").select("slot", F.log2("n").cast("tinyint").alias("level")).toArrow()  # at most SLOTS rows
        often = np.zeros(SLOTS, np.int8)
        often[counts["slot"].to_numpy()] = counts["level"].to_numpy()
        told = spark.sparkContext.broadcast(often)

        def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    keys = [prefix_keys(np.array(x, np.int64).view(np.uint64), similarity, told.value) for x in part["set"].to_pylist()]
                    each = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in keys]))
                    place = np.concatenate([*(np.arange(len(x)) for x in keys), np.zeros(0, np.int64)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(place), *(part[c].take(each) for c in ("node", *facts))], ["key", "pos", "node", *facts])

        keyed = own.join(sets, "node").mapInArrow(firsts, "key long, pos int, node binary, n long, low0 long, low1 long, degree long, root binary")
        return bucketed(materialize(keyed)).drop("size")

    roots, tries, rows = None, 1, live.count()
    # Sizes, and places in the order of shingles, bound what two sets can have in common (at their first common key); so do their low bits, all but surely.
    both_ = F.col("n") + F.col("x.n")
    able = (F.least("n", "x.n") * 100 >= F.greatest("n", "x.n") * percent) & (F.least(F.col("n") - F.col("pos"), F.col("x.n") - F.col("x.pos")) * (100 + percent) >= both_ * percent)
    able &= F.bit_count(F.col("low0").bitwiseXOR(F.col("x.low0"))) + F.bit_count(F.col("low1").bitwiseXOR(F.col("x.low1"))) <= most_unlike(registers, similarity)
    while rows:
        unsettled = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("left")).where("low < high").select("key", "left")
        live = live.join(materialize(in_files(unsettled, rows)), "key")
        if tries == MORE_LEADS:
            live = materialize(in_files(live, rows))
            hot = live.where(F.col("left") > BUCKET)
            if not hot.isEmpty():
                live = live.where(F.col("left") <= BUCKET).drop("left").unionByName(dealt_again(hot).select(*(c for c in live.columns if c != "left")))
        live = materialize(in_files(live.drop("left"), rows) if tries != MORE_LEADS else live.drop("left"))
        rows = live.count()
        if not rows:
            break
        chosen = F.max(F.struct("degree", "node", "n", "pos", "low0", "low1", "root")).alias("x")
        leads = materialize(in_files(live.groupBy("key", F.pmod(F.xxhash64("node", F.lit(tries)), F.lit(tries)).alias("share")).agg(chosen).select("key", "x"), rows))
        pairs = live.join(leads, "key").where((F.col("root") != F.col("x.root")) & able)
        pairs = materialize(in_files(pairs.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct(), rows * tries))
        live = materialize(in_files(live.join(leads.select("key", F.col("x.node").alias("node")), ["key", "node"], "left_anti"), rows))
        tries *= MORE_LEADS
        tried = pairs.count()
        found = linked(pairs, tried) if tried else pairs
        if not found.isEmpty():
            every = found if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
            roots = connected_components(every, "a", "b")
            live = materialize(in_files(live.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), rows))

    member = nodes.select("node", "least")
    member = materialize(member.withColumn("root", F.col("node")) if roots is None else member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = materialize(member.groupBy("root").agg(F.min("least").alias("component")))  # written, so that a large group can be split
    of_node = materialize(member.join(best, "root").select("node", "component"))
    every = table.select("id", "n", "node").join(of_node, "node", "left")
    return every.select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
