"""Media columns: 8-bit WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

pack() stores a payload as the samples of a mono 8-bit WAV and unpack() reads it with the wave
module. fingerprint() finds each frame's strongest spectral peaks, pairs every peak with the next
few ones and codes a pair as (f1, f2, dt) with the time of its first peak: two arrays per medium,
times (frame numbers) and codes. Magnitudes are rounded to integers first, so ties are ties; of equal
peaks the lower frequency comes first.

Null and empty payloads are padded like any other; silence has no peak and empty arrays. Repeated rows come
as often as they are there, equal texts with equal values. Extra columns are ignored. A very long text is one
medium, transformed BLOCK frames at a time. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

RATE, FRAME, HOP = 8000, 64, 64
PEAKS, FAN, REACH = 2, 3, 16  # peaks a frame, pairs a peak, frames a pair may span
BLOCK = 4096  # frames transformed at once
_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def padded(payload: bytes, unit: int = 64) -> bytes:
    """Append zero bytes up to a positive multiple of unit."""
    return payload + b"\0" * (-len(payload) % unit if payload else unit)


def pack(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(payload), "NONE", "not compressed"))
        w.writeframes(payload)
    return out.getvalue()


def unpack(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit WAV")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray):
    """Rounded magnitudes, frames x (FRAME/2 + 1), block by block."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] if n else np.zeros((0, FRAME), np.uint8)
    for at in range(0, n, BLOCK):
        x = frames[at : at + BLOCK].astype(np.float32) - np.float32(128)
        yield np.rint(np.abs(np.fft.rfft(x * _HANN, axis=1))).astype(np.int32)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """times int32, codes int32 (f1 << 12 | f2 << 6 | dt), and the number of peaks."""
    times, freqs, base = [], [], 0
    for mag in spectrum(samples):
        mid = mag[:, 2:-1]  # without the window's share of the constant
        top = (mid > mag[:, 1:-2]) & (mid >= mag[:, 3:]) & (mid > 0)
        rank = np.where(top, mid.astype(np.int64) * 64 + (63 - np.arange(mid.shape[1])), -1)
        best = np.argpartition(-rank, PEAKS - 1, axis=1)[:, :PEAKS]
        best = np.sort(np.where(np.take_along_axis(rank, best, 1) > 0, best, 99), axis=1)
        t, k = np.nonzero(best < 99)
        times.append(t + base)
        freqs.append(best[t, k] + 2)
        base += len(mag)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    t, f = np.concatenate(times), np.concatenate(freqs)
    ts, cs = [], []
    for step in range(1, FAN + 1):
        dt = t[step:] - t[:-step]
        near = dt <= REACH
        ts.append(t[:-step][near])
        cs.append((f[:-step] << 12 | f[step:] << 6 | dt)[near])
    ts, cs = np.concatenate(ts), np.concatenate(cs)
    order = np.lexsort((cs, ts))
    return ts[order].astype(np.int32), cs[order].astype(np.int32), len(t)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (unpadded UTF-8) and media: the text's bytes as a WAV."""

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([pack(padded(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"{id_col} long, n_bytes long, media binary")


def analysed(media: DataFrame, id_col: str = "doc_id", arrays: bool = True) -> DataFrame:
    """Read each medium back: digests of payload and file, fingerprint arrays (if arrays) and summary.

    feature is frames:peaks:pairs:digest of the two arrays.
    """
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", fp_times array<int>, fp_codes array<int>" if arrays else ""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for media in batch.column(2).to_pylist():
                data = unpack(media)
                times, codes, peaks = fingerprint(np.frombuffer(data, np.uint8))
                mark = hashlib.blake2b(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes(), digest_size=12).hexdigest()
                frames = max(0, (len(data) - FRAME) // HOP + 1)
                row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{frames}:{peaks}:{len(codes)}:{mark}", times, codes)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fp_times", "fp_codes"][: 8 if arrays else 6]
            made = [pa.array(c, k) for c, k, _ in zip(cols[:6], kinds, names, strict=False)]
            if arrays:
                ends = pa.array(np.cumsum([0, *map(len, cols[6])]), pa.int32())
                made += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *c]))) for c in cols[6:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[id_col, "n_bytes", *names])

    return media.mapInArrow(tidy(run), schema)
