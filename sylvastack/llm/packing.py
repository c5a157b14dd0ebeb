"""Packing of tokenised documents into fixed-length sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .workspace import materialize

#: Distinct space-led chunks that a worker remembers; the table is emptied when it is full.
REMEMBERED = 300_000
#: Characters of text that are looked up together.
TOGETHER = 4_000_000
_TOKENIZERS: dict[str, "_Chunked"] = {}
_SPACES = re.compile(r" \s")


class _Chunked:
    """Byte-level BPE by chunks that start at a single space, where the pattern always starts a token; repeated chunks are looked up.

    The chunks not known yet are encoded as one string: only a chunk's first token starts with a space, so the ids part
    again. The tokens that the file adds to its vocabulary are found before all else, as the file's own tokenizer does.
    """

    def __init__(self, name: str) -> None:
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            rules = json.load(f)
        self.added = {x["content"]: x["id"] for x in rules["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in rules["added_tokens"]):
            raise ValueError("an added token that takes in what stands around it")
        byte_of = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}  # these bytes stand for themselves
        byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(byte_of.values())))}
        ranks = {bytes(map(byte_of.__getitem__, k)): v for k, v in rules["model"]["vocab"].items() if k not in self.added}
        self.bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.led = np.zeros(max(ranks.values()) + 1, bool)
        self.led[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()

    def _whole(self, text: str) -> bool:
        """Whether a token can cross a space: where white space follows or the text ends there; or an added token may stand in the text."""
        return bool(_SPACES.search(text)) or text.endswith(" ") or any(x in text for x in self.added)

    def _learn(self, chunks: list[str]) -> None:
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(chunks)), np.uint32)
        cuts = np.flatnonzero(self.led[ids]) * 4
        if len(cuts) != len(chunks):
            raise RuntimeError("a chunk's token does not start at its space")
        data = ids.tobytes()
        self.known.update(zip(chunks, map(data.__getitem__, map(slice, cuts.tolist(), [*cuts[1:].tolist(), len(data)]))))

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        chunked = [None if self._whole(x) else x.split(" ") for x in texts]
        new = set().union(*(x[1:] for x in chunked if x)).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*(x[1:] for x in chunked if x))
            self._learn(list(new))
        find = self.known.__getitem__
        return [self._plain(text) if x is None else self._plain(x[0]) + b"".join(map(find, x[1:])) for text, x in zip(texts, chunked)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, with_ids: bool = False, with_row: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids][, row]): each document's ids and one end id, cut every ``capacity`` ids.

    ``tokenizer`` names a file of the installed public tokenizers, with a vocabulary and the tokens added to it: their
    strings in a text become their ids. ids: the piece's ids. row: a number that the pieces of one row share; it holds
    only in what is written from this table.
    """

    def cut(keys: list[int], texts: list[str | None], rows: list[int], coder: _Chunked, end: bytes) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(7)]
        for key, row, ids in zip(keys, rows, coder.packed([x or "" for x in texts])):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                for column, value in zip(columns, (key, start, len(part) // 4, zlib.crc32(part), total, part, row)):
                    column.append(value)
        arrays = [pa.array(x, pa.int64()) for x in columns[:5]]
        if with_ids:
            flat = np.frombuffer(b"".join(columns[5]), "<i4")
            arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(columns[2])].astype(np.int32)), pa.array(flat)))
        if with_row:
            arrays.append(pa.array(columns[6], pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["row"] * with_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, _Chunked(tokenizer))
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                yield cut(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 1, 2)), coder, end)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", row long" * with_row
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.monotonically_increasing_id()).mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs): lengths longest first, each into the shortest packs that it fits, as often as there is room.

    Works on counts of packs with the same pattern, so the effort depends on ``capacity`` and not on the number of pieces.
    """
    by_room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError("a length must lie between 1 and the capacity")
        left, made = histogram[length], defaultdict(Counter)
        for room in range(capacity, length - 1, -1):
            while left and by_room.get(room):
                pattern, packs = by_room[room].popitem()
                used = min(packs, left)
                if packs > used:
                    by_room[room][pattern] += packs - used
                by_room[room - length][(*pattern, length)] += used  # met again further down, if there is room for more
                left -= used
        fits = capacity // length
        if left >= fits and (full := left // fits):
            made[capacity - fits * length][(length,) * fits] += full
            left -= full * fits
        if left:
            made[capacity - left * length][(length,) * left] += 1
        for room, patterns in made.items():
            by_room[room].update(patterns)
    return [item for room in sorted(by_room) for item in sorted(by_room[room].items(), reverse=True)]


def _slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, places in a pack, offset of the first place).

    A pack's equal lengths lie side by side and take consecutive ranks.
    """
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, count in packs:
        offset = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, taken[length], taken[length] + count * times, sequence, times, offset))
            taken[length] += count * times
            offset += length * times
        sequence += count
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, salt_rows: int = 200_000) -> DataFrame:
    """``pieces`` with (sequence_id, offset): every piece in one sequence of at most ``capacity`` ids, gapless from offset 0.

    Only the histogram of lengths, at most ``capacity`` rows, comes to the driver. Ranks within a length are counted by
    (length, salt), at most about ``salt_rows`` pieces each and 64 salts where there are pieces for them, so a length that a
    third of all pieces have, such as full ones, is spread by its count. The salt is a hash of the row's atomic columns.

    Needs doc_id, start and length; null ids are ranked first; repeated rows are pieces of their own. Empty: empty.
    """
    spark = pieces.sparkSession
    histogram = {x.length: x["count"] for x in pieces.groupBy("length").count().collect()}
    lengths = spark.createDataFrame([(k, max(-(-n // salt_rows), min(64, -(-n // 50)))) for k, n in histogram.items()], "length long, _salts int")
    slots = spark.createDataFrame(_slots(pack_histogram(histogram, capacity)), "length long, lo long, hi long, first_sequence long, times long, first_offset long")
    plain = [f.name for f in pieces.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    # Bounded by the capacity: one row for each length, and a few slots for each.
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("_salt", F.pmod(F.xxhash64(*plain), F.col("_salts")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("_at", F.row_number().over(order) - 1).join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_at") + F.col("_first"))
    at = F.col("_rank") - F.col("lo")
    placed = ranked.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return placed.select(
        *(F.col(f"p.{c}") for c in pieces.columns),
        (F.col("first_sequence") + F.floor(at / F.col("times"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(at, F.col("times")) * F.col("p.length")).alias("offset"),
    )


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False, with_row: bool = False) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens[, ids][, row], sequence_id, offset.

    Null and empty texts give one piece that holds the end id. A long text is cut into full sequences and one rest.
    Equal texts and repeated ids give pieces of their own; row tells them apart. Empty table: empty result. Other
    columns are not read.
    """
    return pack(materialize(token_pieces(docs, id_col, text_col, capacity, tokenizer, with_ids=with_ids, with_row=with_row)), capacity)
