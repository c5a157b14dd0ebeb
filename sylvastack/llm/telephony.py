"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, expanded by tables and resampled to linear PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

ALAW, MULAW, ADPCM = 6, 7, 17
#: Bytes of an ADPCM block; payloads are padded to whole blocks, so each of the codecs can hold them.
BLOCK = 576
#: Rate that text files declare, and rate of the stored PCM. PCM of 16 kHz from 8 kHz files takes twice the disk that the input has.
RATE, TARGET_RATE = 16_000, 8_000
PAD = 0xFF
#: Bytes of media that are worked on together.
TOGETHER = 4_000_000

#: Step sizes of IMA ADPCM, and the change of the step index for each magnitude of a code.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, segment = (code & 15) << 4, (code >> 4) & 7
    size = np.where(segment == 0, part + 8, (part + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + code: the change of the sample, and the next step index * 16."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGE)[code & 7], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), after.astype(np.int32).ravel()


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
_CHANGE, _AFTER = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks (one a row, bytes): the n-th code of all blocks is decoded at once."""
    start = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    body = blocks[:, 4:].T.astype(np.int32)
    out = np.empty((1 + 2 * len(body), len(blocks)), np.int16)
    out[0] = value = start
    for i, both in enumerate(body):
        for j, code in ((1, both & 15), (2, both >> 4)):
            at = index + code
            value = np.clip(value + _CHANGE[at], -32768, 32767)
            index = _AFTER[at]
            out[2 * i + j] = value
    return out.T


def wav(payload: bytes, codec: int = MULAW, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is ``payload``: 8-bit samples, or whole ADPCM blocks."""
    per_block = (BLOCK - 4) * 2 + 1
    align, bits, samples = (BLOCK, 4, len(payload) // BLOCK * per_block) if codec == ADPCM else (1, 8, len(payload))
    extra = struct.pack("<H", per_block) if codec == ADPCM else b""
    pace = rate * BLOCK // per_block if codec == ADPCM else rate
    fmt = struct.pack("<HHIIHHH", codec, 1, rate, pace, align, bits, len(extra)) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@dataclass
class Wav:
    """The parts of a WAV file that decoding needs."""

    codec: int
    channels: int
    rate: int
    align: int
    payload: bytes


def read_wav(media: bytes) -> Wav:
    """The format and the payload of a WAV file; raises ValueError where it is none, or in a codec other than the three."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            codec, channels, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            if codec not in (ALAW, MULAW, ADPCM) or not channels or not rate or (codec == ADPCM and align < 4 * channels):
                raise ValueError(f"not a telephony WAV file: codec {codec}, {channels} channels, rate {rate}, block align {align}")
            form = (codec, channels, rate, align)
        elif name == b"data":
            if form is None or at + 8 + size > len(media):
                break
            return Wav(*form, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("a WAV file without whole format and data chunks")


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == target or not len(samples):
        return samples
    at = np.arange(len(samples) * target // rate, dtype=np.int64) * rate
    low, part = at // target, at % target
    x = samples.astype(np.int64)
    return ((x[low] * (target - part) + x[np.minimum(low + 1, len(x) - 1)] * part) // target).astype(np.int16)


def _adpcm_channels(raw: np.ndarray, align: int, channels: int) -> np.ndarray:
    """(channels, samples) of whole blocks; a block has a head of 4 bytes for each channel, then 4 bytes of each in turn."""
    blocks = raw.reshape(-1, align)
    if channels == 1:
        return decode_adpcm(blocks).reshape(1, -1)
    heads = blocks[:, : 4 * channels].reshape(len(blocks), channels, 4)
    whole = (align - 4 * channels) // (4 * channels) * 4 * channels
    body = blocks[:, 4 * channels : 4 * channels + whole].reshape(len(blocks), -1, channels, 4)
    return np.stack([decode_adpcm(np.hstack([heads[:, c], body[:, :, c].reshape(len(blocks), -1)])).ravel() for c in range(channels)])


def expand(payload: bytes, codec: int, align: int = BLOCK, channels: int = 1) -> np.ndarray:
    """16-bit samples of a payload, its channels mixed to one by their mean.

    Samples of 8 bits: any length; bytes that do not fill a frame of all channels are left out. ADPCM: blocks of
    ``align`` bytes; a last, shorter block is decoded as far as it holds a head and whole groups of codes.
    """
    raw = np.frombuffer(payload, np.uint8)
    if codec != ADPCM:
        linear = (MULAW_TABLE if codec == MULAW else ALAW_TABLE)[raw[: len(raw) // channels * channels]]
        return linear if channels == 1 else linear.reshape(-1, channels).mean(axis=1).astype(np.int16)
    full = len(raw) // align * align
    parts = [_adpcm_channels(raw[:full], align, channels)] if full else []
    group = 4 * channels if channels > 1 else 1
    rest = (len(raw) - full - 4 * channels) // group * group
    if rest >= 0 and len(raw) > full:
        parts.append(_adpcm_channels(raw[full : full + 4 * channels + rest], 4 * channels + rest, channels))
    if not parts:
        return np.zeros(0, np.int16)
    both = np.concatenate(parts, axis=1)
    return both[0] if channels == 1 else both.mean(axis=0).astype(np.int16)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: int = MULAW) -> DataFrame:
    """(id, n_bytes, media): each text as UTF-8, padded to whole blocks (one at least), in a WAV file. Null: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1).slice(lo, 500)]
                media = [wav(x + bytes([PAD]) * (max(BLOCK, -(-len(x) // BLOCK) * BLOCK) - len(x)), codec) for x in data]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), pa.array(list(map(len, data)), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def _measures(samples: np.ndarray) -> str:
    """Peak, rounded root mean square and sign changes; all 0 without samples."""
    x = samples.astype(np.int64)
    if not len(x):
        return "0/0/0"
    return f"{int(np.abs(x).max())}/{int(round(float(np.sqrt((x * x).mean()))))}/{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def _blocks_at_once(files: list[Wav]) -> list[np.ndarray]:
    """The payload of each file as ADPCM: files of whole mono blocks of one size together, the others one by one."""
    out: list[np.ndarray | None] = [None] * len(files)
    alike: dict[int, list[int]] = {}
    for i, x in enumerate(files):
        align, channels = (x.align, x.channels) if x.codec == ADPCM else (BLOCK, 1)
        if channels == 1 and x.payload and len(x.payload) % align == 0:
            alike.setdefault(align, []).append(i)
        else:
            out[i] = expand(x.payload, ADPCM, align, channels)
    for align, members in alike.items():
        decoded = decode_adpcm(np.frombuffer(b"".join(files[i].payload for i in members), np.uint8).reshape(-1, align))
        at = 0
        for i in members:
            n = len(files[i].payload) // align
            out[i] = decoded[at : at + n].ravel()
            at += n
    return out


def decode_media(media: DataFrame, target_rate: int = TARGET_RATE) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, measures, pcm) of stored WAV files.

    pcm: the file's samples by its own codec, mixed to one channel, resampled, as little-endian 16-bit. measures: for the
    payload under mu-law, A-law and ADPCM each the peak, root mean square and sign changes. Files may have any length,
    rate, number of channels and block align (see ``expand``). Equal media give equal values. A null medium gives nulls,
    one that is no WAV file of the three codecs fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // TOGETHER
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                yield part(batch.slice(lo, hi - lo))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(2).to_pylist()
        read = [None if x is None else read_wav(x) for x in files]
        adpcm = iter(_blocks_at_once([x for x in read if x]))
        rows = []
        for file, x in zip(files, read):
            if not x:
                rows.append([None] * 7)
                continue
            channels = x.channels if x.codec != ADPCM else 1
            forms = {MULAW: expand(x.payload, MULAW, channels=channels), ALAW: expand(x.payload, ALAW, channels=channels), ADPCM: next(adpcm)}
            pcm = resample(forms[x.codec], x.rate, target_rate).astype("<i2").tobytes()
            measures = ";".join(f"{name}:{_measures(forms[c])}" for name, c in (("mulaw", MULAW), ("alaw", ALAW), ("adpcm", ADPCM)))
            rows.append([len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), measures, pcm])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        arrays = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "measures", "pcm"])

    kind = media.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, measures string, pcm binary"
    return media.select("id", "n_bytes", "media").mapInArrow(run, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: int = MULAW) -> DataFrame:
    """Store every text as a medium in the shared folder, read the stored bytes back, store the resampled PCM, and describe what is stored.

    The columns of ``decode_media`` without measures, with feature: the CRC-32 of the stored PCM, then the measures.
    Both tables are compressed.
    """
    stored = materialize(decode_media(materialize(store_texts(docs, id_col, text_col, codec), "zstd")), "zstd")
    crc = F.lower(F.lpad(F.hex(F.crc32("pcm")), 8, "0"))
    return stored.select(*(c for c in stored.columns if c not in ("measures", "pcm")), F.concat_ws(";", crc, "measures").alias("feature"), "pcm")
