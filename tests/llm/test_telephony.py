import hashlib
import zlib

import numpy as np

from ledgerlake.llm import telephony as t

SF = "/root/testdata/sf0.001"


def one_block(block):
    """A block decoded sample by sample."""
    value = int.from_bytes(block[:2], "little", signed=True)
    step, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            size = int(t._STEPS[step])
            d = size >> 3
            d += size if code & 4 else 0
            d += size >> 1 if code & 2 else 0
            d += size >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            step = max(0, min(88, step + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_tables_and_adpcm():
    assert t.MULAW_PCM[0xFF] == 0 and t.MULAW_PCM[0x00] == -32124 and t.MULAW_PCM[0x80] == 32124
    assert t.ALAW_PCM[0xD5] == 8 and t.ALAW_PCM[0x55] == -8 and t.ALAW_PCM[0x2A] == -32256
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (20, t.BLOCK), np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [one_block(bytes(b)) for b in blocks]


def test_contract_over_a_table(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = t.op9_telephony_audio(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id]
        payload = data + b" " * (-len(data) % 192 or 192 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_edges_and_stored_media(spark):
    rows = [(1, None), (2, ""), (None, "x"), (4, "é" * 96), (5, "a" * 192), (6, "long text " * 300_000), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as media", "3 as pcm")
    out = t.store_audio(df).collect()
    assert len(out) == 7
    by = {r.id: r for r in out}
    for r in out:
        codec, rate, stored = t.read_wav(bytes(r.media))
        assert bytes(stored).rstrip(b" ") == (dict(rows)[r.id] or "").encode().rstrip(b" ") and rate == 8000
        pcm = np.concatenate(list(t.pcm_parts(codec, stored)))
        assert bytes(r.pcm) == t.double_rate(pcm).astype("<i2").tobytes()
    assert by[1].payload_sha256 == by[2].payload_sha256 and by[1].payload_bytes == 192 and by[7].feature == by[None].feature
    assert t.store_audio(df.limit(0)).collect() == []
