"""Near-duplicates by Jaccard similarity of word shingles: SimHash anchors find the close texts, prefix keys all others.

SimHash fingerprints within 3 bits link what is nearly equal, and miss pairs at a similarity of 0.8, short texts above all. So
a text also shows the first ``n - ceil(0.8 n) + 1`` of its ``n`` distinct shingles in one fixed order, rare ones first: two
texts of similarity 0.8 have 0.8 n shingles in common, so no such pair is without a common key. The order comes from a sample
of texts; it decides how large the buckets of a key are, never which pairs are found. Candidates that the parity bits of their
sets cannot rule out are checked by the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import SEED, links, majority
from .workspace import cleaned, materialize

#: One text of so many is read for the order of shingles, which are counted in so many slots.
SAMPLED, SLOTS = 64, 1 << 22
#: Size of the bitmap of texts to check; a full one only means that more texts are looked at.
BITS = 1 << 24
#: Leads that a bucket tries in a round grow by this factor.
MORE_LEADS = 4
_EDGE = 1e-9


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles in order of the hash; fewer words than ``shingle``: one shingle of them all; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def prefix_keys(hashes: np.ndarray, similarity: float = 0.8, often: np.ndarray | None = None) -> np.ndarray:
    """The first shingles in the order of (how often their slot was sampled, hash), so many that two texts of ``similarity`` share one."""
    n = len(hashes)
    shown = n - ceil(similarity * n - _EDGE) + 1 if n else 0
    if often is not None:
        hashes = hashes[np.argsort(often[(hashes % np.uint64(len(often))).astype(np.int64)], kind="stable")]
    return hashes[:shown].view(np.int64)


def parity_bits(hashes: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the hashes is i modulo the number of bits, a power of two of at least 64 and at least as many as hashes."""
    size = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of hashes that only one of two sets has: each flips one bit. Longer bits fold onto shorter ones."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _node(words: list[bytes]) -> int:
    """A text's key in joins: half of the 128-bit digest of its words."""
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True)


def _often(rows: DataFrame, shingle: int) -> np.ndarray:
    """By slot, 0 or the rounded binary logarithm of how often the sampled texts have its shingles, as far as more than once."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = [shingle_set(_words(x.as_py()), shingle) % np.uint64(SLOTS) for x in batch.column(0).slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).astype(np.int32))], ["slot"])

    sample = rows.where(F.pmod("text_key", F.lit(SAMPLED)) == 0).select("text")
    counts = sample.mapInArrow(slots, "slot int").groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot", F.log2("n").cast("tinyint").alias("level")).toArrow()
    often = np.zeros(SLOTS, np.int8)
    often[counts["slot"].to_numpy()] = counts["level"].to_numpy()
    return often


@cleaned
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, id_key, text_key, copies, group, lead): one row for each distinct id and text, with the smallest id of its group.

    Texts are equal if their words are, in A-Z lower case; null, empty and blank texts are equal. Groups are the
    components over pairs whose distinct shingles have at least ``similarity`` in common. lead: true for one row of a
    group, that with the smallest id, of equal ids the smallest text_key; null ids come last. id_key and text_key are
    hashes of the id and of the text as it stands, never null; copies: how many rows of ``docs`` have both.

    Equal texts are merged before any pair is made. A bucket compares its texts with some of them, then with more, until
    each pair of it was compared or is in one component already. Empty table: empty result. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"id_key": F.xxhash64("id"), "text_key": F.xxhash64("text")})
    often = context.broadcast(_often(rows, shingle))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                nodes, sizes, fps, keys, parity = [], [], [], [], []
                for text in part["text"]:
                    words = _words(text.as_py())
                    hashes = shingle_set(words, shingle)
                    nodes.append(_node(words))
                    sizes.append(len(hashes))
                    fps.append(majority(hashes))
                    keys.append(prefix_keys(hashes, similarity, often.value))
                    parity.append(parity_bits(hashes))
                made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(parity, pa.binary())]
                yield pa.RecordBatch.from_arrays([part["id"], part["id_key"], part["text_key"], *made], ["id", "id_key", "text_key", "node", "n", "fp", "keys", "parity"])

    table = materialize(rows.mapInArrow(prints, f"id {kind}, id_key long, text_key long, node long, n int, fp long, keys array<long>, parity binary"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "id_key")
    texts = materialize(table.groupBy("node").agg(F.min(first).alias("rep"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.any_value("parity").alias("parity")))
    keyed = texts.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    # Written, so that the joins below are dealt out for themselves and AQE can split a hot key or hub.
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    live = materialize(keyed.join(shared, "key"))
    # A text that meets many others is more often the one that they were copied from, so it leads first.
    degrees = materialize(live.groupBy("node").agg(F.sum("size").alias("degree")))
    live = materialize(live.drop("size").join(degrees, "node").withColumn("root", F.col("node")))

    spot = F.xxhash64("id_key", "text_key").bitwiseAND(F.lit(BITS - 1))

    def sets_of(nodes: DataFrame) -> DataFrame:
        involved = materialize(nodes.join(texts.select("node", "rep.id_key", "rep.text_key"), "node"))
        marks = involved.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
        bitmap = np.zeros(BITS // 64, np.int64)
        bitmap[marks["word"].to_numpy()] = marks["bits"].to_numpy()
        sent = context.broadcast(bitmap)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch["spot"].to_numpy()
                batch = batch.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    words = [_words(x.as_py()) for x in part["text"]]
                    made = [pa.array(list(map(_node, words)), pa.int64()), pa.array([shingle_set(w, shingle).view(np.int64) for w in words], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([part["id_key"], part["text_key"], *made], ["id_key", "text_key", "node", "set"])

        # The bitmap spares most texts; the join settles the rest, so whole texts are never shuffled.
        marked = rows.select("text", "id_key", "text_key", spot.alias("spot")).mapInArrow(sets, "id_key long, text_key long, node long, set array<long>")
        return materialize(marked.join(involved, ["id_key", "text_key", "node"], "left_semi").groupBy("node").agg(F.any_value("set").alias("set")))

    bound = (1 - similarity) / (1 + similarity)

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [least_apart(x, y) for x, y in zip(batch["pa"].to_pylist(), batch["pb"].to_pylist())]
            sizes = batch["na"].to_numpy().astype(np.int64) + batch["nb"].to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= bound * sizes + _EDGE))

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of ``similarity``; sets are made only for those that the parity bits leave open."""
        of = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("parity").alias("p" + x))
        left = materialize(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(open_pairs, "a long, b long"))
        if left.isEmpty():
            return left
        held = sets_of(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct())
        both = left.join(held.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
        common = F.size(F.array_intersect("s", "t"))
        return materialize(both.where(common >= F.lit(similarity) * (F.size("s") + F.size("t") - common)).select("a", "b"))

    roots = None

    def join_up(found: DataFrame, live: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Components with the links found, and ``live`` with the roots in them."""
        if found.isEmpty():
            return roots, live
        every = found if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        now = connected_components(every, "a", "b")
        return now, materialize(live.drop("root").join(now, "node", "left").withColumn("root", F.coalesce("root", "node")))

    # Fingerprints within 3 bits: each text of a fingerprint with its first, and the firsts of linked fingerprints.
    of_fp = materialize(texts.groupBy("fp").agg(F.min("node").alias("least")))
    same = texts.join(of_fp, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(of_fp.select("fp")).join(of_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    roots, live = join_up(compared(materialize(same.unionByName(near).distinct())), live)

    tries, least = 1, F.least("n", "x.n")
    # Sizes and places in the order bound what two texts can have in common; the bound holds at the first common key.
    able = (least >= F.greatest("n", "x.n") * similarity - _EDGE) & (F.least(F.col("n") - F.col("pos"), F.col("x.n") - F.col("x.pos")) >= (F.col("n") + F.col("x.n")) * (similarity / (1 + similarity)) - _EDGE)
    while True:
        unsettled = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        live = materialize(live.join(materialize(unsettled), "key", "left_semi"))
        if live.isEmpty():
            break
        chosen = F.max(F.struct("degree", "node", "n", "pos", "root")).alias("x")
        leads = materialize(live.groupBy("key", F.pmod(F.xxhash64("node", F.lit(tries)), F.lit(tries)).alias("share")).agg(chosen).select("key", "x"))
        pairs = live.join(leads, "key").where((F.col("root") != F.col("x.root")) & able)
        pairs = materialize(pairs.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct())
        live = materialize(live.join(leads.select("key", F.col("x.node").alias("node")), ["key", "node"], "left_anti"))
        if not pairs.isEmpty():
            roots, live = join_up(compared(pairs), live)
        tries *= MORE_LEADS

    member = texts.select("node", "rep")
    member = materialize(member.withColumn("root", F.col("node")) if roots is None else member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = materialize(member.groupBy("root").agg(F.min("rep").alias("best")))  # written, so that a large group can be split
    grouped = materialize(member.join(best, "root").select("node", "best"))
    copies = table.groupBy("id_key", "text_key", "node").agg(F.any_value("id").alias("id"), F.count("*").alias("copies"))
    lead = (F.col("id_key") == F.col("best.id_key")) & (F.col("text_key") == F.col("best.text_key"))
    return copies.join(grouped, "node").select("id", "id_key", "text_key", "copies", F.col("best.id").alias("group"), lead.alias("lead"))
