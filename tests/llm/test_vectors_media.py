"""Nearest neighbours and telephony media."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from sylvastack.llm import postings, telephony


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def plain_nearest(rows, queries, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_and_scores(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, np.array(r.embedding, np.float32)) for r in vectors.collect()]
    want = plain_nearest(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in postings.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    x = {i: v.astype(np.float64) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(x[q] @ x[i] - s) < 1e-9 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and q not in {i for _, i, _ in found}
    assert np.mean([len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_exact_where_all_lists_open_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 4) + np.array([0.5, 0, 0, 0])) for i in range(60)] + [(100 + i, np.array([1.5, 1, 1, 1])) for i in range(45)]
    bad = [(200, None), (201, [0, 0, 0, 0]), (202, [1, None, 1, 1]), (203, [1, float("nan"), 1, 1]), (204, [1, float("inf"), 0, 0]), (None, [1, 1, 1, 1])]
    df = frame(spark, rows + bad + rows[:3])
    want = plain_nearest(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in postings.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def table(kind, n, rng):
    if kind == "clustered":
        return rng.standard_normal((40, 32))[rng.integers(0, 40, n)] * 3 + rng.standard_normal((n, 32)) * 0.5
    x = rng.standard_normal((n, 32))
    return x if kind == "isotropic" else x * np.exp(rng.standard_normal((n, 1)))


@pytest.mark.parametrize("kind, most", [("clustered", 0.3), ("isotropic", 0.95), ("uneven", 0.6)])
def test_recall_and_share_of_opened_rows(spark, kind, most):
    rng = np.random.default_rng(6)
    x = table(kind, 6_000, rng).astype(np.float32)
    rows = list(enumerate(x))
    df = frame(spark, rows)
    want = plain_nearest(rows, range(0, 6_000, 20))
    got = {}
    for r in postings.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want])
    index = postings.ListIndex.fit(x.astype(np.float64), len(x), float(np.linalg.norm(x.astype(np.float64), axis=1).max()))
    index.sizes[:] = np.bincount(index.homes(x.astype(np.float64))[1], minlength=len(index.centres))
    opened = np.mean([index.sizes[index.open_lists(x[q].astype(np.float64), 84)].sum() / index.sizes.sum() for q in range(0, 6_000, 20)])
    print(kind, recall, opened)
    assert recall >= 0.9 and opened <= most


def test_few_vectors(spark):
    df = frame(spark, [(0, [1, 2]), (1, [2, 1]), (2, [-1, 0])])
    got = [(r.query_id, r.rank, r.vec_id) for r in postings.nearest(df, df.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert postings.nearest(df.where("vec_id = 0")).collect() == []
    assert postings.nearest(df.where("false")).collect() == []


def test_lists_are_dealt_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(postings, "PART_ROWS", 7)
    monkeypatch.setattr(postings, "PART_QUERIES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).astype(np.float32)) for i in range(120)]
    df = frame(spark, rows)
    want = plain_nearest(rows, [i for i, _ in rows])
    got = {}
    for r in postings.nearest(df, ratio=100.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in f] for q, f in want.items()}


def test_the_graph_reaches_every_list():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((300, 8)), rng.standard_normal((300, 8)) + 30])
    index = postings.ListIndex.fit(x, 600, float(np.linalg.norm(x, axis=1).max()))
    index.sizes[:] = 1
    assert sorted(index.open_lists(x[0], 10**9)) == list(range(len(index.centres)))
    index.ratio = dict.fromkeys(index.ratio, 1e9)
    assert sorted(index.open_lists(x[0], 0)) == list(range(len(index.centres)))
    assert np.bincount(index.homes(x)[1], minlength=len(index.centres)).max() < 600


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + telephony.INDEX_CHANGE[code & 7]))
            out.append(value)
    return out


def test_decoders_equal_plain_ones():
    data = np.random.default_rng(4).integers(0, 256, (5, telephony.BLOCK)).astype(np.uint8)
    assert telephony.decode_adpcm(data).tolist() == [plain_adpcm(bytes(b)) for b in data]
    # published points of the two laws
    assert [int(telephony.MULAW_TABLE[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0xF0)] == [-32124, 0, 32124, 0, 120]
    assert [int(telephony.ALAW_TABLE[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]


def test_wav_round_trip():
    payload = bytes(range(256)) * 9
    for codec in (telephony.MULAW, telephony.ALAW, telephony.ADPCM):
        assert telephony.read_wav(telephony.wav(payload, codec)) == telephony.Wav(codec, 1, 16000, telephony.BLOCK if codec == telephony.ADPCM else 1, payload)
    for broken in (b"", b"RIFF", telephony.wav(payload)[:-5]):
        try:
            telephony.read_wav(broken)
            raise AssertionError("a broken file was read")
        except ValueError:
            pass


def file(codec, channels, align, payload, rate=8000):
    """A WAV file with the least that a reader needs."""
    fmt = struct.pack("<HHIIHH", codec, channels, rate, rate * align, align, 4 if codec == telephony.ADPCM else 8)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_files_of_any_length_align_and_channels(spark):
    rng = np.random.default_rng(5)
    data = lambda n: bytes(rng.integers(0, 256, n).astype(np.uint8))
    blocks = [data(256) for _ in range(3)]
    left, right = data(4 + 24), data(4 + 24)
    both = left[:4] + right[:4] + b"".join(x[i : i + 4] for i in range(4, 28, 4) for x in (left, right))
    mean = [(a + b) / 2 for a, b in zip(plain_adpcm(left), plain_adpcm(right))]
    odd, pair = data(101), data(7)
    law = lambda table, raw: [int(table[b]) for b in raw]
    cases = [
        (file(telephony.MULAW, 1, 1, odd), law(telephony.MULAW_TABLE, odd)),
        (file(telephony.ALAW, 2, 2, pair), [int((int(telephony.ALAW_TABLE[pair[i]]) + int(telephony.ALAW_TABLE[pair[i + 1]])) / 2) for i in (0, 2, 4)]),
        (file(telephony.ADPCM, 1, 256, b"".join(blocks)), [v for b in blocks for v in plain_adpcm(b)]),
        (file(telephony.ADPCM, 1, 256, blocks[0] + blocks[1][:31]), plain_adpcm(blocks[0]) + plain_adpcm(blocks[1][:31])),
        (file(telephony.ADPCM, 1, 256, blocks[0] + blocks[1][:3]), plain_adpcm(blocks[0])),
        (file(telephony.ADPCM, 2, 56, both), [int(x) for x in mean]),
        (file(telephony.MULAW, 1, 1, b""), []),
        (None, None),
    ]
    media = spark.createDataFrame([(i, 0, m) for i, (m, _) in enumerate(cases)], "id long, n_bytes long, media binary")
    got = {r.id: r for r in telephony.decode_media(media, target_rate=8000).collect()}
    for i, (_, samples) in enumerate(cases):
        assert got[i].pcm == (None if samples is None else np.array(samples, "<i2").tobytes())


def plain_measures(x):
    return f"{max(map(abs, x))}/{round((sum(v * v for v in x) / len(x)) ** 0.5)}/{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"


def test_the_query_s_features_equal_plain_ones(spark, data):
    from sylvastack.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = QUERIES["op8_telephony"](spark, data)
    assert found.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "bigint", "string", "bigint", "bigint", "string", "string"]
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:40]:
        raw = (texts[i] or "").encode()
        raw += b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        mulaw, alaw = ([int(t[b]) for b in raw] for t in (telephony.MULAW_TABLE, telephony.ALAW_TABLE))
        adpcm = [v for lo in range(0, len(raw), 576) for v in plain_adpcm(raw[lo : lo + 576])]
        crc = zlib.crc32(b"".join(struct.pack("<h", v) for v in mulaw[::2]))
        assert rows[i].feature == f"{crc:08x};mulaw:{plain_measures(mulaw)};alaw:{plain_measures(alaw)};adpcm:{plain_measures(adpcm)}"


def test_resampling():
    x = np.array([0, 100, 50], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, 75, 50, 50]
    assert telephony.resample(x, 8000, 8000) is x and len(telephony.resample(x[:0], 8000, 16000)) == 0


def test_texts_as_media(odd, none):
    rows = telephony.text_media(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == 11
    for r in rows:
        data = (texts[r.id] or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        media = telephony.wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert len(r.pcm) == len(payload)
    one = {r.feature for r in rows if r.id in (1, 2)}
    assert len(one) == 1
    assert telephony.text_media(none).collect() == []


def test_clusters_far_apart_are_found_from_any_entry(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((600, 32))[rng.integers(0, 600, 8_000)] * 3 + rng.standard_normal((8_000, 32)) * 0.05).astype(np.float32)
    rows = list(enumerate(x))
    df = frame(spark, rows)
    want = plain_nearest(rows, range(0, 8_000, 20))
    got = {}
    for r in postings.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got.get(q, set()) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_queries_meet_a_number_of_shards_that_does_not_grow_with_the_lists():
    for n in (4_000, 16_000):
        x = np.random.default_rng(8).standard_normal((n, 16))
        index = postings.ListIndex.fit(x, n, float(np.linalg.norm(x, axis=1).max()))
        index.sizes[:] = np.bincount(index.homes(x)[1], minlength=len(index.centres))
        held = np.bincount(index.shards(131_072), weights=index.sizes)
        assert len(held) <= postings.SHARDS and held.max() < 3 * held.mean()
