"""Telephony audio in table columns: G.711 by lookup tables, IMA ADPCM by numpy across blocks, PCM resampling.

`encode_text` makes a payload a WAV of 8-bit samples, mu-law or A-law by the parity of its CRC-32: one byte, one
sample, so the stored form is lossless. The query writes these files to a table and reads that back. `decode`
expands the stored bytes by table, decodes the same bytes as 64-byte ADPCM blocks, and resamples the expanded
signal to 16 kHz PCM by a half-band filter; `store_pcm` keeps that signal as a column of a table.

Defined cases: null text is an empty payload, padded to 64 zero bytes; equal payloads give equal values;
repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
Short texts are decoded together, about PIECE bytes at a time; memory follows PIECE and the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import materialise, runs, table, text_runs

RATE, RESAMPLED = 8000, 16000
BLOCK = 64  # bytes of an ADPCM block: a 4-byte head and 120 nibbles
TAGS = {"mulaw": 7, "alaw": 6}  # WAV format tags
PIECE = 2 << 20  # bytes decoded together

# Fixed values of IMA ADPCM: how far each code moves the step index.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int64)


def adpcm_steps() -> np.ndarray:
    """The 89 step sizes: from 7, each about a tenth above the one before, as the standard rounds them."""
    # Fixed values of the IMA ADPCM standard.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
         118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
         1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
         6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
         32767], dtype=np.int64)


STEPS = adpcm_steps()


def adpcm_moves() -> np.ndarray:
    """Signed move of each (step index, code): an eighth, and a half, quarter and whole step by the code's bits."""
    step, code = STEPS[:, None], np.arange(16)
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel()


MOVES, INDEX_MOVES = adpcm_moves(), INDEX_MOVE[np.arange(16) & 7].astype(np.int32)


def mulaw_table() -> np.ndarray:
    """int16 value of each mu-law byte (G.711): complemented sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """int16 value of each A-law byte (G.711): even bits inverted, sign set for positive values."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def wav(samples: bytes, law: str = "mulaw") -> bytes:
    """A WAV file of 8-bit companded samples, mono, 8 kHz."""
    head = struct.pack("<HHIIHHH", TAGS[law], 1, RATE, RATE, 1, 8, 0)
    fact = struct.pack("<I", len(samples))
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<I", 4) + fact
    body += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, bytes]:
    """The law and the sample bytes of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, law, data = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            law = {v: k for k, v in TAGS.items()}[struct.unpack_from("<H", media, at + 8)[0]]
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if law is None or data is None:
        raise ValueError("a WAV file without format or data")
    return law, data


def decode_adpcm(data: bytes) -> np.ndarray:
    """IMA ADPCM, 64-byte mono blocks -> int16 of shape (blocks, 121); every step runs across all blocks."""
    raw = np.frombuffer(data, dtype=np.uint8)[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)
    value = np.ascontiguousarray(raw[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out = np.empty((121, len(raw)), dtype=np.int16)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)
    for k in range(120):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        value += MOVES[index * 16 + code]
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_MOVES[code]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return out.T


def encode_adpcm(pcm: np.ndarray) -> bytes:
    """int16 of shape (blocks, 121) -> 64-byte blocks; the twin of decode_adpcm."""
    pcm = np.asarray(pcm, dtype=np.int64).reshape(-1, 121)
    out = np.zeros((len(pcm), BLOCK), dtype=np.uint8)
    out[:, :2] = pcm[:, :1].astype("<i2").view(np.uint8).reshape(-1, 2)
    value, index = pcm[:, 0].copy(), np.zeros(len(pcm), dtype=np.int64)
    for k in range(120):
        step, gap = STEPS[index], pcm[:, k + 1] - value
        size = np.minimum(np.abs(gap) * 4 // step, 7)
        move = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(gap < 0, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[size], 0, 88)
        out[:, 4 + (k >> 1)] |= ((size | np.where(gap < 0, 8, 0)) << (4 * (k & 1))).astype(np.uint8)
    return out.tobytes()


def half_band(taps: int = 8, bits: int = 15) -> np.ndarray:
    """Whole-number weights of the samples on one side of a point half-way: a sinc under a Hann window, halves of 2**bits."""
    k = np.arange(taps) + 0.5
    weight = np.sinc(k) * np.cos(np.pi * k / (2 * taps + 1)) ** 2
    out = np.round(weight / weight.sum() * (1 << (bits - 1))).astype(np.int64)
    out[0] += (1 << (bits - 1)) - out.sum()
    return out


HALF = half_band()


def resample_double(pcm: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """8 -> 16 kHz: each sample, then the half-band value between it and the next; beyond its ends a signal repeats
    its outer samples. `ends` are the ends of several signals in a row."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    if not len(pcm):
        return out
    ends = np.array([len(pcm)]) if ends is None else np.asarray(ends)
    sizes, taps = np.diff(ends, prepend=0), len(HALF)
    # every signal with `taps` repeats of its outer samples on both sides, one after the other
    lead = np.repeat(np.arange(len(ends)) * 2 * taps + taps, sizes)
    wide = np.zeros(len(pcm) + 2 * taps * len(ends), dtype=np.int32)
    at = np.arange(len(pcm)) + lead
    wide[at] = pcm
    starts = ends - sizes
    for k in range(1, taps + 1):
        wide[at[starts] - k], wide[at[ends - 1] + k] = pcm[starts], pcm[ends - 1]
    between = np.full(len(wide), 1 << 14, dtype=np.int32)  # rounds; sums stay within 32 bits
    for k, weight in enumerate(HALF.tolist()):
        between[taps - 1 : -taps] += weight * (wide[taps - 1 - k : len(wide) - taps - k] + wide[taps + k : len(wide) - taps + k + 1][: len(wide) - 2 * taps + 1])
    out[1::2] = np.clip(between[at] >> 15, -32768, 32767)
    return out


def features(stored: list[bytes], law: str) -> list[str]:
    """A digest of what each sample string decodes to: level, peak, crossings, and checksums of the 16 kHz PCM
    and of the ADPCM reading. All are worked together; each has a positive multiple of 64 bytes."""
    sizes = np.array([len(x) for x in stored])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = b"".join(stored)
    pcm = EXPAND[law][np.frombuffer(data, dtype=np.uint8)]
    wide = pcm.astype(np.float64)  # whole numbers below 2**53, so sums are exact
    energy = np.add.reduceat(wide * wide, starts)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    flips = np.zeros(len(pcm), dtype=np.int64)
    flips[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    flips[starts] = 0
    crossings = np.add.reduceat(flips, starts)
    fast = memoryview(resample_double(pcm, ends).astype("<i2", copy=False)).cast("B")
    blocks = memoryview(np.ascontiguousarray(decode_adpcm(data)).astype("<i2", copy=False).reshape(-1)).cast("B")
    out = []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        pcm_crc, adpcm_crc = zlib.crc32(fast[4 * a : 4 * b]), zlib.crc32(blocks[a // BLOCK * 242 : b // BLOCK * 242])
        rms = (energy[i] / (b - a)) ** 0.5
        out.append(f"{law};n={b - a};rms={rms:.3f};peak={peak[i]:.0f};zc={crossings[i]};pcm16k={pcm_crc:08x};adpcm={adpcm_crc:08x}")
    return out


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


MEDIA = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def law_of(payload: bytes) -> str:
    return "alaw" if zlib.crc32(payload) & 1 else "mulaw"


def encode_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", law: str | None = None) -> DataFrame:
    """doc_id, n_bytes (unpadded) and the stored form `media` of each text; law None takes that of the payload."""

    def work(batches):
        for batch in batches:
            for a, texts in text_runs(batch, 1):
                made = [payload_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(made)), pa.array([n for n, _ in made], pa.int64()), pa.array([wav(p, law or law_of(p)) for _, p in made], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.selectExpr(f"cast(`{id_column}` as long) doc_id", f"cast(`{text_column}` as string) text").mapInArrow(work, MEDIA)


def decode(media: DataFrame) -> DataFrame:
    """Media rows -> doc_id, payload (as read back), pcm (16 kHz, int16 little-endian) and feature."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                law, data = read_wav(batch.column(1)[i].as_py())
                pcm = resample_double(EXPAND[law][np.frombuffer(data, dtype=np.uint8)]).astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([data], pa.binary()), pa.array([pcm], pa.binary()), pa.array(features([data], law))],
                    ["doc_id", "payload", "pcm", "feature"],
                )

    return media.select("doc_id", "media").mapInArrow(work, "doc_id long, payload binary, pcm binary, feature string")


def digest(media: DataFrame) -> DataFrame:
    """Media rows -> sizes and checksums of what is read back, one small row each."""

    def work(batches):
        for batch in batches:
            for a, b in runs(pc.binary_length(batch.column(2)).to_pylist(), PIECE):
                stored = batch.column(2).slice(a, b - a).to_pylist()
                read = [read_wav(m) for m in stored]
                feature: list[str | None] = [None] * len(read)
                for law in EXPAND:
                    at = [i for i, (kind, _) in enumerate(read) if kind == law]
                    for i, f in zip(at, features([read[i][1] for i in at], law) if at else [], strict=True):
                        feature[i] = f
                data = [d for _, d in read]
                columns = {
                    "payload_bytes": pa.array(map(len, data), pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                    "tail_crc32": pa.array([zlib.crc32(d[-64:]) for d in data], pa.int64()),
                    "media_bytes": pa.array(map(len, stored), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                    "feature": pa.array(feature, pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), *columns.values()], ["doc_id", "n_bytes", *columns])

    return media.mapInArrow(work, DIGEST)


def store_pcm(media: DataFrame, path: str) -> DataFrame:
    """Write doc_id, payload, pcm and feature as a table, and read it back."""
    decode(media).write.mode("error").option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(materialise(encode_text(table(spark, sf_dir, "documents")), "telephony-media"))
