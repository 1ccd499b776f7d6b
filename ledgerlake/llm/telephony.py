"""Telephony audio: mu-law, A-law and ADPCM samples in WAV files, expanded to PCM and resampled, with numpy in tasks."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: codec -> WAV format tag
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
TAGS = {ALAW: 6, MULAW: 7, ADPCM: 17}
RATE, TARGET_RATE = 8000, 16000
#: Bytes of an ADPCM block: a header of 4 bytes with the first sample, then two samples a byte.
BLOCK = 192
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
#: Blocks that are decoded at once at most: bounds a task's memory for texts of any length.
BLOCKS_AT_ONCE = 4096
SAMPLES_AT_ONCE = 1 << 20


def _mulaw_table() -> np.ndarray:
    """The value of each of the 256 codes: sign, three bits of segment, four of step, all inverted."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, step + 8, (step + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _step_sizes() -> np.ndarray:
    """ADPCM's 89 quantiser steps: each is about a tenth larger than the one before, from 7 up to 32767."""
    # fixed values of the format
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
_STEPS = _step_sizes()
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: change of the sample for each step and code: (2 * magnitude + 1) / 8 steps, as the format's shifts round it
_CODES = np.arange(16, dtype=np.int32)
_DELTA = (_STEPS[:, None] >> 3) + np.where(_CODES & 4, _STEPS[:, None], 0) + np.where(_CODES & 2, _STEPS[:, None] >> 1, 0) + np.where(_CODES & 1, _STEPS[:, None] >> 2, 0)
_DELTA = np.where(_CODES & 8, -_DELTA, _DELTA).astype(np.int32)
_NEXT = np.clip(np.arange(len(_STEPS))[:, None] + _MOVES, 0, len(_STEPS) - 1).astype(np.int32)
_DELTA_FLAT, _NEXT_FLAT = _DELTA.ravel(), (_NEXT * 16).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes -> (n, BLOCK_SAMPLES) int16. All blocks step together, as each starts from its own header;
    a step index over 88 in a header counts as 88."""
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    row = np.minimum(head[:, 2].astype(np.int32), len(_STEPS) - 1) * 16
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    k = 1
    for column in body:
        for code in (column & 15, column >> 4):
            at = row + code
            value = np.clip(value + _DELTA_FLAT[at], -32768, 32767)
            row = _NEXT_FLAT[at]
            out[k] = value
            k += 1
    return out.T


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file around samples (or blocks), with the fact chunk that compressed formats need."""
    align, bits, extra = (BLOCK, 4, struct.pack("<HH", 2, BLOCK_SAMPLES)) if codec == ADPCM else (1, 8, struct.pack("<H", 0))
    samples = len(payload) // BLOCK * BLOCK_SAMPLES if codec == ADPCM else len(payload)
    per_second = rate * BLOCK // BLOCK_SAMPLES if codec == ADPCM else rate
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, stored bytes) of a WAV file, by its chunks."""
    view, at, found = memoryview(media), 12, {}
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found[bytes(view[at : at + 4])] = view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag, _, rate = struct.unpack_from("<HHI", found[b"fmt "])
    return next(k for k, v in TAGS.items() if v == tag), rate, found[b"data"]


def pcm_parts(codec: str, data: memoryview) -> Iterator[np.ndarray]:
    """int16 samples of stored bytes, in parts of bounded size."""
    raw = np.frombuffer(data, np.uint8)
    if codec == ADPCM:
        blocks = raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)
        for at in range(0, len(blocks), BLOCKS_AT_ONCE):
            yield decode_adpcm(blocks[at : at + BLOCKS_AT_ONCE]).ravel()
    else:
        table = MULAW_PCM if codec == MULAW else ALAW_PCM
        for at in range(0, len(raw), SAMPLES_AT_ONCE):
            yield table[raw[at : at + SAMPLES_AT_ONCE]]


def pcm_of_many(stored: list[tuple[str, memoryview]]) -> Iterator[Iterator[np.ndarray]]:
    """pcm_parts of each file. ADPCM blocks of all files that have BLOCKS_AT_ONCE or fewer are decoded together, so many at
    a time, as decoding takes as many steps as a block has samples, whatever the number of blocks."""
    small = [i for i, (codec, data) in enumerate(stored) if codec == ADPCM and len(data) <= BLOCKS_AT_ONCE * BLOCK]
    together, done, size = [], {}, 0

    def decode() -> None:
        blocks = np.concatenate([np.frombuffer(stored[i][1], np.uint8)[: len(stored[i][1]) // BLOCK * BLOCK] for i in together]).reshape(-1, BLOCK)
        pcm, at = decode_adpcm(blocks), 0
        for i in together:
            n = len(stored[i][1]) // BLOCK
            done[i] = pcm[at : at + n].ravel()
            at += n

    for i in small:
        if size + len(stored[i][1]) > BLOCKS_AT_ONCE * BLOCK:
            decode()
            together, size = [], 0
        together.append(i)
        size += len(stored[i][1])
    if together:
        decode()
    for i, (codec, data) in enumerate(stored):
        yield iter([done.pop(i)]) if i in done else pcm_parts(codec, data)


def double_rate(pcm: np.ndarray, after: int | None = None) -> np.ndarray:
    """Twice the samples: each, and the mean with the one that follows (the last with `after`, or itself)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    follows = np.append(wide[1:], wide[-1] if after is None else after) if len(pcm) else wide
    out[1::2] = (wide + follows) >> 1
    return out


def _measure(codec: str, parts: Iterator[np.ndarray], keep: bool) -> tuple[str, bytes | None]:
    """What is measured on the resampled PCM: its samples, peak, energy, sign changes and CRC; with `keep`, itself."""
    n = peak = energy = changes = crc = 0
    last = None
    kept = []
    part = next(parts, None)
    while part is not None:
        following = next(parts, None)
        pcm = double_rate(part, None if following is None else int(following[0]))
        wide = pcm.astype(np.int64)
        n += len(pcm)
        peak = max(peak, int(np.abs(wide).max(initial=0)))
        energy += int(wide @ wide)
        sign = pcm < 0
        changes += int(np.count_nonzero(sign[1:] != sign[:-1])) + int(last is not None and last != sign[0])
        last = sign[-1]
        raw = pcm.astype("<i2").tobytes()
        crc = zlib.crc32(raw, crc)
        if keep:
            kept.append(raw)
        part = following
    return f"{codec};n={n};peak={peak};rms={round((energy / n) ** 0.5 if n else 0)};crossings={changes};crc={crc}", b"".join(kept) if keep else None


def payload_of(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % BLOCK or (0 if data else BLOCK))


def codec_for(payload: bytes) -> str:
    """One of the three, by the payload's CRC: equal payloads are stored alike."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


#: Payloads are stored, read back and measured in groups of about so many bytes.
GROUP_BYTES = 2_000_000


def _store(keep_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, media, size = [], [], [], 0

            def table(key_type=batch.schema.field(0).type):
                read = [read_wav(m) for m in media]
                rows = []
                for key, n, m, (codec, _, stored), parts in zip(keys, sizes, media, read, pcm_of_many([(codec, stored) for codec, _, stored in read]), strict=True):
                    feature, pcm = _measure(codec, parts, keep_pcm)
                    rows.append((key, n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), m, hashlib.sha256(m).hexdigest(), feature, pcm))
                return _table(rows, key_type, keep_pcm)

            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                payload = payload_of(data)
                keys.append(key)
                sizes.append(len(data))
                media.append(wav(payload, codec_for(payload)))
                size += len(payload)
                if size > GROUP_BYTES:
                    yield table()
                    keys, sizes, media, size = [], [], [], 0
            if keys:
                yield table()

    return run


_FIELDS = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media", "binary"), ("media_sha256", "string"), ("feature", "string")]


def _table(rows: list[tuple], key_type: pa.DataType, keep_pcm: bool) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array([k.as_py() for k in columns[0]], key_type)] + [pa.array(c, kinds[t]) for c, (_, t) in zip(columns[1:], _FIELDS, strict=False)]
    names = ["id", *(n for n, _ in _FIELDS)]
    if keep_pcm:
        arrays.append(pa.array(columns[-1], pa.binary()))
        names.append("pcm")
    return pa.RecordBatch.from_arrays(arrays, names)


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_pcm: bool = True) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media, media_sha256, feature, pcm) for each row.

    A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, are stored as they are as the samples
    of a telephony WAV file: 8-bit mu-law or A-law, or ADPCM blocks of 192 bytes, by the payload's CRC. Digests and
    features come from the file read back: its samples are expanded, and resampled to 16 kHz PCM (column pcm, 16-bit
    little-endian, where keep_pcm; four to eight times the text's bytes, in one value). Null texts count as empty ones, which are one block of spaces. Rows with equal
    texts get equal values, null ids stay null, empty tables give no rows, other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in _FIELDS) + (", pcm binary" if keep_pcm else "")
    return own.mapInArrow(_store(keep_pcm), schema)


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and size and digest of the resampled PCM that is stored beside the file."""
    stored = store_audio(read_table(spark, sf_dir, "documents"))
    sizes = [F.length("media").cast("long").alias("media_bytes"), F.length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256")]
    return stored.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", sizes[0], "media_sha256", "feature", *sizes[1:])


QUERIES = {"op9_telephony_audio": op9_telephony_audio}
ORACLES = {}
