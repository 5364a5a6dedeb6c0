"""Operator 5: telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, and resampled PCM.

A media value is a WAV file (mono).  Companded samples expand through tables of 256 entries that
are built from the companding rules.  ADPCM blocks decode in lock step: one numpy operation
advances the same sample of every block of every file of the batch.

A null media value decodes to null and has null features.  Bytes that are no such WAV file raise an
error.  ``to_pcm`` replaces a column named pcm, and the digests replace columns of their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, give_back, staged, text_slices

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17  # WAV format tags
RATE = 8000
UNIT = 64  # payload bytes in an ADPCM block, after its header
HEADER = 4
SLICES = 4
COMPRESSION = {"parquet.compression.codec.zstd.level": "9"}

# Fixed values of the IMA ADPCM standard.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
STEP_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def wav(tag: int, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file; for ADPCM, ``data`` is the nibbles, and each block starts anew from 0."""
    bits, align, extra = (16, 2, b"") if tag == PCM else (8, 1, struct.pack("<H", 0))
    if tag == ADPCM:
        blocks = np.zeros((len(data) // UNIT, HEADER + UNIT), np.uint8)
        blocks[:, HEADER:] = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
        data, bits, align, extra = blocks.tobytes(), 4, HEADER + UNIT, struct.pack("<HH", 2, 2 * UNIT + 1)
    per_second = rate * (HEADER + UNIT) // (2 * UNIT + 1) if tag == ADPCM else rate * align
    head = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body + b"\0" * (len(data) & 1)


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[1] != 1 or form[0] not in (PCM, ALAW, MULAW, ADPCM):
                raise ValueError(f"unsupported WAV format {form}")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("WAV file without data")


def payload_of(media: bytes) -> tuple[int, bytes]:
    """Format tag and the stored units, without ADPCM block headers."""
    tag, _, align, data = parse_wav(media)
    if tag == ADPCM:
        data = np.frombuffer(data, np.uint8).reshape(-1, align)[:, HEADER:].tobytes()
    return tag, data


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of a matrix of ADPCM blocks of one size, one row a block."""
    n = len(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.ascontiguousarray(blocks[:, HEADER:].T)
    out = np.empty((2 * len(codes) + 1, n), np.int16)
    out[0] = value
    for k, pair in enumerate(codes):
        for half, code in enumerate((pair & 0x0F, pair >> 4)):
            step = STEPS[index]
            move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
            index = np.clip(index + STEP_MOVES[code], 0, len(STEPS) - 1)
            out[2 * k + half + 1] = value
    return out.T


def decode_all(media: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Rate and PCM of each WAV file; the ADPCM blocks of all files decode together."""
    parsed = [parse_wav(m) for m in media]
    out: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, np.int16))] * len(media)
    packed: dict[int, list[int]] = {}
    for k, (tag, rate, align, data) in enumerate(parsed):
        raw = np.frombuffer(data, np.uint8)
        if tag == ADPCM:
            packed.setdefault(align, []).append(k)
        else:
            out[k] = rate, MULAW_TABLE[raw] if tag == MULAW else ALAW_TABLE[raw] if tag == ALAW else raw.view("<i2")
    for align, files in packed.items():
        blocks = np.concatenate([np.frombuffer(parsed[k][3], np.uint8).reshape(-1, align) for k in files])
        samples, at = adpcm_blocks(blocks), 0
        for k in files:
            n = len(parsed[k][3]) // align
            out[k] = parsed[k][1], samples[at : at + n].reshape(-1)
            at += n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, the same on every machine."""
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    wide = pcm.astype(np.int64)
    right = wide[np.minimum(left + 1, len(pcm) - 1)] if n else wide[:0]
    return ((wide[left] * (to - part) + right * part) // to).astype(np.int16)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's bytes, padded to whole units, as telephony audio.

    The codec follows from the padded bytes' checksum, so equal texts give equal media.  Null is
    empty; repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            media = []
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                payload = raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))
                media.append(wav((MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3], payload))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pc.binary_length(batch["text"]).cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_pcm(media: DataFrame, rate: int = 16_000, column: str = "media") -> DataFrame:
    """The rows with ``pcm`` (16-bit WAV files at ``rate``) instead of ``column``."""
    media = media.drop(*(c for c in media.columns if c.lower() == "pcm" != column))
    fields = [f for f in media.schema.fields if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " if fields else "") + "`pcm` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in media_slices(batches, column):
            at = batch.schema.get_field_index(column)
            values = batch.column(at).to_pylist()
            given = iter(decode_all([v for v in values if v is not None]))
            pcm = [None if v is None else wav(PCM, resample(x[1], x[0], rate).tobytes(), rate) for v in values for x in [next(given) if v is not None else None]]
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(pcm, pa.binary())], [*(batch.schema.names[k] for k in kept), "pcm"])

    return media.mapInArrow(run, schema)


def media_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


DIGESTS = [("codec", "string"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string")]
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
ARROW = {"string": pa.string(), "long": pa.int64()}


def with_digests(media: DataFrame) -> DataFrame:
    """The rows with what the stored bytes say: codec, payload length and digests, media length and digest."""
    media = media.drop(*(name for name, _ in DIGESTS))
    names = {PCM: "pcm", MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}

    def digests(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * len(DIGESTS)
        tag, payload = payload_of(m)
        return names[tag], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in media_slices(batches, "media"):
            rows = [digests(m) for m in batch["media"].to_pylist()]
            for (name, kind), column in zip(DIGESTS, zip(*rows, strict=True), strict=True):
                batch = batch.append_column(name, pa.array(column, ARROW[kind]))
            yield batch

    return media.mapInArrow(run, T.StructType([*media.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in DIGESTS)).fields]))


def pcm_features(pcm: DataFrame) -> DataFrame:
    """The digests, and as ``feature`` the codec and what the stored PCM says: rate, length, peak, mean square, zero crossings and checksum."""

    def feature(codec: str, stored: bytes | None) -> str | None:
        if stored is None:
            return None
        _, rate, _, data = parse_wav(stored)
        wave = np.frombuffer(data, "<i2")
        wide = wave.astype(np.int64)
        energy, crossings = int(np.dot(wide, wide)) // max(len(wide), 1), int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
        return f"{codec};{rate}Hz;{len(wave)};peak={int(np.abs(wide).max(initial=0))};energy={energy};crossings={crossings};pcm={zlib.crc32(data):08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in media_slices(batches, "pcm"):
            told = [feature(c, p) for c, p in zip(batch["codec"].to_pylist(), batch["pcm"].to_pylist(), strict=True)]
            kept = ["doc_id", "n_bytes", *(name for name, _ in DIGESTS[1:])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(told, pa.string())], [*kept, "feature"])

    return pcm.mapInArrow(run, FEATURES)


def stored_features(docs: DataFrame, rate: int = 16_000, slices: int = SLICES) -> DataFrame:
    """Texts as telephony audio, stored; its resampled PCM, stored; and the features of both as they are read back.

    PCM takes several times its audio's bytes, so that of one slice of the rows at a time lies in the shared folder.
    """
    media, told = staged(to_media(docs), "media", **COMPRESSION), []
    for k in range(slices):
        own = media.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k)
        pcm = staged(to_pcm(with_digests(own), rate), "pcm", **COMPRESSION)
        told.append(staged(pcm_features(pcm), "features"))
        discard(pcm)
    return reduce(DataFrame.unionByName, told)
