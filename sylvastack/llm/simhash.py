"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints at distance 3 or less differ in at most one bit of their upper or of their lower half. The
anchors of a half are the words of the (31, 26) Hamming code on 31 of its bits: a covering code of radius 1, so every
half lies within 1 of exactly one anchor. A fingerprint is replicated to every anchor within the radius plus 1, at
most 16 for each half; then a linked pair meets at the anchor next to either of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import cleaned, materialize

SEED = 42
#: A bucket of more rows is dealt out again by blocks of bits, one of which a linked pair shares.
BUCKET_ROWS = 4096


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint. Null, empty or blank text: 0; fewer words than ``shingle``: the whole sequence is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The signed number whose bits are set where they are in over half the hashes; without hashes 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): one row for each input row, repeated ids included."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(x, shingle) for x in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def _xor_table() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the changes that turn a half into each anchor within 2 of it, and whether the anchor is within 1."""
    bit = lambda i: 1 << (i - 1)
    masks = [[0] * 16] + [[bit(s)] + [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)]
    return np.array(masks, np.int64), np.array([1] + [16] * 31)


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (anchor, fp, home): a row for each anchor within radius 1 plus 1 of either half; home: within the radius."""
    masks, count = _xor_table()
    places = np.arange(1, 32)
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 1 << 16):
            part = fps[at : at + (1 << 16)]
            for half in (0, 1):
                word = (part >> (32 * half)) & 0x7FFFFFFF
                syndrome = np.bitwise_xor.reduce(np.where((word[:, None] >> (places - 1)) & 1, places, 0), axis=1)
                keep = np.arange(16) < count[syndrome][:, None]
                rows, which = np.nonzero(keep)
                anchor = (word[rows] ^ masks[syndrome[rows], which]) | (half << 31)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[rows]), pa.array(which == 0)], ["anchor", "fp", "home"])


def _forest(fps: np.ndarray, home: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Pairs within ``distance`` that span the components of one bucket, by breadth-first search over the rows not reached yet; never all pairs."""
    left, right = [], []
    open_fp, open_home = fps.view(np.uint64).copy(), home.copy()
    while len(open_fp) > 1:
        todo = [(open_fp[0], open_home[0])]
        open_fp, open_home = open_fp[1:], open_home[1:]
        while todo and len(open_fp):
            x, at_home = todo.pop()
            near = (np.bitwise_count(open_fp ^ x) <= distance) & (open_home | at_home)
            if near.any():
                reached = open_fp[near]
                left += [int(x.view(np.int64))] * len(reached)
                right += reached.view(np.int64).tolist()
                todo += zip(reached, open_home[near])
                open_fp, open_home = open_fp[~near], open_home[~near]
    return left, right


def compare_sorted(distance: int, limit: int | None):
    """For rows sorted by ``key``: the links a - b of each bucket, or each row again (a its fingerprint, b null) of one over ``limit`` rows.

    A bucket of over ``limit`` rows is handed on batch by batch, so it is never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one key, the last seen
        hot = None

        def again(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part["fp"], pa.nulls(part.num_rows, pa.int64()), part["key"], part["home"], part["rest"], part["width"]], _OUT)

        def bucket(left: list[int], right: list[int], fps: np.ndarray, home: np.ndarray) -> None:
            if len(fps) > 1 and home.any():
                x, y = _forest(fps, home, distance)
                left += x
                right += y

        def linked(left: list[int], right: list[int]) -> pa.RecordBatch:
            none = pa.nulls(len(left), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), none, pa.nulls(len(left), pa.bool_()), none, pa.nulls(len(left), pa.int32())], _OUT)

        def release() -> Iterator[pa.RecordBatch]:
            left, right = [], []
            if held:
                bucket(left, right, *(np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in held]) for c in ("fp", "home")))
                held.clear()
            yield linked(left, right)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["key"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            fps, home = batch["fp"].to_numpy(), batch["home"].to_numpy(zero_copy_only=False)
            if held and held[0]["key"][0].as_py() != keys[0]:
                yield from release()
            left, right = [], []
            for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                inner = 0 < i < len(edges) - 2
                if hot is not None and keys[lo] == hot:
                    yield again(batch.slice(lo, hi - lo))
                elif inner and not (limit and hi - lo > limit):
                    bucket(left, right, fps[lo:hi], home[lo:hi])
                else:
                    if held and held[0]["key"][0].as_py() != keys[lo]:
                        yield from release()
                    held.append(batch.slice(lo, hi - lo))
                    if limit and sum(x.num_rows for x in held) > limit:
                        hot = int(keys[lo])
                        yield from map(again, held)
                        held.clear()
            yield linked(left, right)
        yield from release()

    return run


_OUT = ["a", "b", "key", "home", "rest", "width"]
_LINKS = "a long, b long, key long, home boolean, rest long, width int"


def links(distinct_fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): pairs of fingerprints within ``distance`` (3 or less) that give the same components as all such pairs.

    Exact at every bucket size. The rows of an anchor agree on one half up to 3 bits, so a bucket of over ``BUCKET_ROWS``
    rows is dealt out by the other half: in four blocks of its bits, one of which a linked pair shares, since it differs
    in 3 bits at most. A block's bucket that is still too large is dealt out by the bits that are left, and so on. Where
    3 bits or less are left, a bucket holds at most 8 x 994 fingerprints.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the anchors cover distances up to 3")
    other = F.expr(f"shiftrightunsigned(fp, if((shiftright(key, 31) & 1) = 0, 32, 0)) & {0xFFFFFFFF}")
    dealt = distinct_fps.mapInArrow(anchors, "key long, fp long, home boolean").withColumns({"rest": other, "width": F.lit(32)})
    found = None
    width = 32
    while True:
        sorted_ = dealt.repartition("key").sortWithinPartitions("key")
        step = materialize(sorted_.mapInArrow(compare_sorted(distance, BUCKET_ROWS if width > 3 else None), _LINKS))
        pairs = step.where("b is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        hot = step.where("b is null").select(F.col("a").alias("fp"), "home", "key", "rest", "width")
        if width <= 3 or hot.isEmpty():
            return found
        # Block i of the remaining bits: its value joins the key, the bits around it are what remains.
        blocks = hot.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
        blocks = blocks.withColumn("size", F.expr("width div 4 + int(i < width % 4)")).withColumn("at", F.expr("int(i * (width div 4) + least(i, width % 4))"))
        value = F.expr("shiftright(rest, at) & (shiftleft(1L, int(size)) - 1)")
        rest = F.expr("shiftleft(shiftright(rest, int(at + size)), at) | (rest & (shiftleft(1L, at) - 1))")
        dealt = blocks.select(F.xxhash64("key", "i", value).alias("key"), "fp", "home", rest.alias("rest"), F.expr("int(width - size)").alias("width"))
        width -= width // 4


@cleaned
def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fp, component): fingerprint and group of every row; component: the smallest id reachable over links.

    Null text counts as empty; texts without words have fingerprint 0 and link like any other. Rows that repeat an id
    each give a row. Null ids take part and come out null unless a smaller id is in the group. Empty table: empty
    result. Other columns of ``docs`` are not read. Exact copies meet as one distinct fingerprint, never as pairs.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected_components(links(nodes.select("fp"), distance), "a", "b")
    joined = materialize(labels.join(nodes, F.col("node") == F.col("fp")).select("root", "fp", "least"))
    best = materialize(joined.groupBy("root").agg(F.min("least").alias("component")))  # written, so that a large component can be split
    linked = joined.select("root", "fp").join(best, "root").select("fp", F.col("component").alias("linked"))
    # Written first, so that both sides of the last join are dealt out for it alone and AQE can split a hot fingerprint.
    of_fp = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component")))
    return prints.join(of_fp, "fp", "left").select("id", "fp", "component")
