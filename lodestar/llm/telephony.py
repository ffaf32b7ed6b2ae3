"""Telephony audio: mu-law, A-law and IMA ADPCM in RIFF/WAVE, expanded, resampled and stored as 16-bit PCM.

The laws expand by tables of 256 samples, built from their formulas. ADPCM is sequential inside a block but not across blocks, so
all blocks of a batch advance together, one sample at a time, with numpy. Rates change by a polyphase filter (windowed sinc in integers:
results do not depend on the machine). Everything is a narrow pass over rows; a batch is cut to a few MB before it is decoded.

Defined results: null media decodes to null; media that isn't a whole RIFF/WAVE file of one channel in a known codec decodes to null, with
the reason in a column of its own; null text counts as empty (its payload is 64 zero bytes); equal bytes give equal results; an empty table
gives no rows; other columns are kept, but for ones that are named like the results, which these replace.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import as_bytes, blocks

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: The least and the most samples a second that are taken for audio.
RATES = (1000, 192_000)
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima_adpcm"}

# Fixed values of IMA ADPCM: step sizes, and how a code moves the place in them.
_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544,
     598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
     13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    chord, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(chord == 0, low + 8, low + 0x108 << np.maximum(chord - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm() -> tuple[np.ndarray, np.ndarray]:
    """For place * 16 + code: the change of the sample, and the next place times 16."""
    code, step = np.arange(16)[None, :], _STEPS[:, None]
    change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    place = np.clip(np.arange(len(_STEPS))[:, None] + _MOVES[code & 7], 0, len(_STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (place * 16).astype(np.int32).ravel()


_EXPAND = {MULAW: _mulaw(), ALAW: _alaw()}
_CHANGE, _NEXT = _adpcm()


def wave(kind: int, rate: int, unit: int, data: bytes, channels: int = 1, per_block: int = 0) -> bytes:
    """A RIFF/WAVE file. unit: bytes of a sample or block; per_block: samples of an ADPCM block."""
    bits = {PCM: 16, ADPCM: 4}.get(kind, 8)
    speed = rate * unit // max(1, per_block)
    fmt = struct.pack("<HHIIHH", kind, channels, rate, speed, unit, bits)
    fmt += struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0) if kind != PCM else b""
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", fmt), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse(media: bytes) -> tuple[int, int, int, bytes]:
    """Kind, rate, bytes of a unit, and the data of a RIFF/WAVE file with one channel."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not RIFF/WAVE")
    at, fmt, data = 12, b"", None
    while at + 8 <= len(media) and data is None:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = media[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("a chunk is cut off")
        fmt, data = (body, None) if name == b"fmt " else (fmt, body if name == b"data" else None)
        at += 8 + size + size % 2
    if len(fmt) < 16 or data is None:
        raise ValueError("fmt or data is missing")
    kind, channels, rate, _, unit, _ = struct.unpack_from("<HHIIHH", fmt)
    if kind not in NAMES or channels != 1:
        raise ValueError(f"format {kind} with {channels} channels isn't telephony audio")
    if not RATES[0] <= rate <= RATES[1]:
        raise ValueError(f"{rate} samples a second")
    if unit < 5 if kind == ADPCM else unit != (2 if kind == PCM else 1):
        raise ValueError(f"units of {unit} bytes")
    if len(data) % unit:
        raise ValueError("the last unit is cut off")
    return kind, rate, unit, data


def decode_adpcm(blocks_: np.ndarray) -> np.ndarray:
    """Samples of blocks (rows of bytes: sample, place, zero, codes): the header's sample and two for each further byte."""
    n, unit = blocks_.shape
    now = np.ascontiguousarray(blocks_[:, :2]).view("<i2").astype(np.int32).ravel()
    place = np.minimum(blocks_[:, 2].astype(np.int32), len(_STEPS) - 1) * 16
    out = np.empty((1 + 2 * (unit - 4), n), np.int16)
    out[0] = now
    codes = np.ascontiguousarray(blocks_[:, 4:].T)
    for k in range(unit - 4):
        for half in (0, 1):
            at = place + (codes[k] & 15 if half == 0 else codes[k] >> 4)
            now = np.clip(now + _CHANGE[at], -32768, 32767)
            place = _NEXT[at]
            out[1 + 2 * k + half] = now
    return out.T


def decode(media: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """Kind, rate and samples of each file; ADPCM blocks of one size advance together over all files."""
    read = [parse(m) for m in media]
    out: list = [None] * len(media)
    together: dict[int, list[int]] = {}
    for k, (kind, rate, unit, data) in enumerate(read):
        if kind == ADPCM:
            together.setdefault(unit, []).append(k)
        else:
            out[k] = (kind, rate, np.frombuffer(data, "<i2") if kind == PCM else _EXPAND[kind][np.frombuffer(data, np.uint8)])
    for unit, files in together.items():
        counts = [len(read[k][3]) // unit for k in files]
        samples = decode_adpcm(np.frombuffer(b"".join(read[k][3][: n * unit] for k, n in zip(files, counts, strict=True)), np.uint8).reshape(-1, unit))
        for k, part in zip(files, np.split(samples, np.cumsum(counts)[:-1]), strict=True):
            out[k] = (ADPCM, read[k][1], part.ravel())
    return out


def resample(x: np.ndarray, source: int, target: int, half: int = 4) -> np.ndarray:
    """x at another rate: ceil(len(x) * target / source) samples, each from 2 * half neighbours."""
    if source == target or not len(x):
        return x.astype(np.int16)
    g = math.gcd(source, target)
    up, down = target // g, source // g
    n = -(-len(x) * up // down)
    wide = np.zeros(len(x) + 2 * half + down, np.int32)
    wide[half - 1 : half - 1 + len(x)] = x
    out, low = np.empty(n, np.int16), min(1.0, up / down)
    for phase in range(min(up, n)):
        first, part = divmod(phase * down, up)
        t = np.arange(1 - half, half + 1) - part / up
        taps = low * np.sinc(low * t) * np.cos(np.pi * t / (2 * half + 1)) ** 2
        taps = np.round(taps / taps.sum() * 2**14).astype(np.int32)
        m = len(out[phase::up])
        total = np.full(m, 2**13, np.int32)
        for k, tap in enumerate(taps):
            if tap:
                total += tap * wide[first + k : first + k + (m - 1) * down + 1 : down]
        out[phase::up] = np.clip(total >> 14, -32768, 32767)
    return out


def _error(media: bytes) -> str | None:
    """Why media can't be decoded."""
    try:
        parse(media)
    except ValueError as e:
        return str(e)
    return None


def to_pcm(df: DataFrame, media: str = "media", rate: int = 16_000, out: str = "pcm", error: str = "pcm_error") -> DataFrame:
    """df with the columns ``out``, the audio in ``media`` as a WAVE file of 16-bit samples at ``rate``, and ``error``, why there is none (null for null media)."""
    kept = [c for c in df.columns if c not in (out, error)]
    schema = df.select(*(F.col(f"`{c}`") for c in kept)).schema.add(out, "binary").add(error, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 20):
            files = batch.column(batch.num_columns - 1).to_pylist()
            errors = [f if f is None else _error(f) for f in files]
            good = [k for k, (f, e) in enumerate(zip(files, errors, strict=True)) if f is not None and e is None]
            made: list[bytes | None] = [None] * len(files)
            for k, (_, was, x) in zip(good, decode([files[k] for k in good]), strict=True):
                made[k] = wave(PCM, rate, 2, resample(x, was, rate).astype("<i2").tobytes())
            yield pa.record_batch([*batch.columns[:-1], pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{media}`").cast("binary").alias("_media_")).mapInArrow(run, schema)


def store(payload: bytes, rate: int = 8_000, block: int = 64) -> bytes:
    """payload (a multiple of ``block`` bytes), losslessly, as mu-law or A-law samples or ADPCM codes; its checksum chooses which."""
    kind = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
    if kind != ADPCM:
        return wave(kind, rate, 1, payload)
    codes = np.frombuffer(payload, np.uint8).reshape(-1, block)
    return wave(ADPCM, rate, block + 4, np.hstack([np.zeros((len(codes), 4), np.uint8), codes]).tobytes(), per_block=2 * block + 1)


def payload_of(media: bytes) -> bytes:
    """The bytes that ``store`` put away."""
    kind, _, unit, data = parse(media)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, unit)[:, 4:]).tobytes() if kind == ADPCM else data


def _feature(kind: int, x: np.ndarray) -> str:
    """Codec, samples, checksum, root mean square, peak, and sign changes of the resampled audio."""
    wide = x.astype(np.int64)
    level = math.isqrt(int(np.dot(wide, wide)) // max(1, len(x)))
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"{NAMES[kind]}:{len(x)}:{zlib.crc32(x.astype('<i2').tobytes()):08x}:{level}:{int(np.abs(wide).max(initial=0))}:{turns}"


def _digests(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 20):
            texts = as_bytes(batch.column("text"))
            media = [store(t + b"\0" * ((-len(t)) % 64 if t else 64)) for t in texts]
            back, heard = [payload_of(m) for m in media], decode(media)
            features = [_feature(kind, resample(x, was, rate)) for kind, was, x in heard]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "payload_bytes": pa.array([len(p) for p in back], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()),
                    "media_bytes": pa.array([len(m) for m in media], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    "feature": pa.array(features, pa.string()),
                }
            )

    return run


def text_as_audio(docs: DataFrame, rate: int = 16_000) -> DataFrame:
    """Each text, stored as telephony audio, read back, expanded and resampled to ``rate``: digests of all three forms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests(rate), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
