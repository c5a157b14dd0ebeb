import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sylvastack.llm.packing import _Chunked, pack, pack_histogram, packed_documents

CODER = _Chunked("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t  aB1é日'!.s<|>", max_size=30))
def test_chunks_give_the_tokenizer_s_ids(text):
    assert CODER.packed([text])[0] == plain_ids(text).tobytes()


def test_added_tokens_have_the_ids_of_the_file():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y ", "a <|endoftext| > b", "é<|endoftext|>\n"]
    assert [50256 in plain_ids(t) for t in texts] == [True, True, True, False, True]
    assert CODER.packed(texts) == [plain_ids(t).tobytes() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_packs_hold_the_histogram(histogram):
    packs = pack_histogram(histogram, 64)
    held = Counter()
    for pattern, n in packs:
        assert n > 0 and sum(pattern) <= 64
        for length in pattern:
            held[length] += n
    assert held == Counter(histogram)


def test_a_pack_takes_a_length_as_often_as_it_has_room():
    packs = pack_histogram({600: 10, 100: 40}, 1024)
    assert sum(n for _, n in packs) == 10 and all(sorted(p) == [100] * 4 + [600] for p, _ in packs)


def test_little_padding():
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 1024, 20_000).tolist())
    packs = pack_histogram(histogram, 1024)
    assert sum(k * n for k, n in histogram.items()) / (1024 * sum(n for _, n in packs)) > 0.99


def whole(rows, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.append(plain_ids(texts[r.doc_id]), 0).astype("<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    return pieces, sequences


def test_documents_round_trip(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    pieces, sequences = whole(packed_documents(documents).collect(), texts)
    for i, parts in pieces.items():
        assert sum(n for _, n in parts) == len(plain_ids(texts[i])) + 1 and len(set(parts)) == len(parts)
    assert set(pieces) == set(texts)


def test_a_hot_length_is_spread_and_stays_gapless(spark):
    from pyspark.sql import functions as F

    pieces = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 64).otherwise(F.col("id") % 64 + 1).cast("long").alias("length"))
    rows = pack(pieces, 64, salt_rows=50).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 4_000 and sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_edges(odd, none):
    rows = packed_documents(odd, with_ids=True, with_row=True).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    pieces, _ = whole(rows, texts)
    assert pieces[1] == pieces[2] == [(0, 1)] and len(pieces[5]) == 2 and len(pieces[None]) == 1
    assert all(len(r.ids) == r.length and r.ids[-1] == 0 for r in rows if r.start + r.length == r.doc_tokens)
    assert len({r.row for r in rows}) == 11 and len({(r.row, r.start) for r in rows}) == len(rows)
    assert packed_documents(none).collect() == []
