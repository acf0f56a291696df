"""Media columns: texts stored as WAV, read back, and fingerprinted by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE, FRAME, HOP, PEAKS = 8000, 256, 128, 2
#: The least magnitude of a peak: of a frame of silence, or of one value throughout, rounding alone is left.
FLOOR = 1.0


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples, one a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes, frame: int = FRAME, hop: int = HOP, peaks: int = PEAKS, block: int = 4096) -> np.ndarray:
    """The strongest `peaks` local maxima of each frame's spectrum, strongest first (of equals the lower); -1 for none.

    Short-time Fourier transforms of Hann-windowed frames, one every `hop` samples, with silence of a frame less a hop
    before the first sample and after the last, so that every sample has full weight in some frame. Frames are taken in
    blocks, so memory doesn't grow with the recording.
    """
    x = np.frombuffer(samples, np.uint8)
    lead = frame - hop
    n = -(-(len(x) + lead) // hop) if len(x) else 0
    window = np.hanning(frame + 1)[:-1].astype(np.float32)
    rows = [np.zeros((0, peaks), np.int64)]
    for at in range(0, n, block):
        m = min(block, n - at)
        a, z = at * hop - lead, (at + m - 1) * hop - lead + frame
        part = np.zeros(z - a, np.float32)
        part[max(0, -a) : min(z, len(x)) - a] = x[max(0, a) : min(z, len(x))].astype(np.float32) - 128.0
        part = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop]
        power = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * window, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        local = np.where((inner >= power[:, :-2]) & (inner > power[:, 2:]) & (inner > FLOOR), inner, -1.0)
        best = np.argpartition(-local, peaks - 1, axis=1)[:, :peaks]
        strength = np.take_along_axis(local, best, 1)
        order = np.lexsort((best, -strength), axis=1)
        best, strength = np.take_along_axis(best, order, 1), np.take_along_axis(strength, order, 1)
        rows.append(np.where(strength > 0, best + 1, -1))
    return np.concatenate(rows)


def peak_pairs(samples: bytes, frame: int = FRAME, hop: int = HOP, peaks: int = PEAKS) -> str:
    """The spectral-peak pairs as time-coded entries `frame:code`, by frame, joined by spaces; code is the hexadecimal
    number (f1 * 256 + f2) * 4 + gap.

    f1 and f2 are frequency bins. The strongest peak of a frame is paired with its others (gap 0); each of a frame's
    peaks is paired with the strongest of the next frame and of the one after (gaps 1, 2).
    """
    f = spectral_peaks(samples, frame, hop, peaks)
    said = []
    for gap in (0, 1, 2):
        for k in range(peaks):
            a, b = (f[:, 0], f[:, k]) if gap == 0 else (f[:-gap, k], f[gap:, 0])
            there = np.flatnonzero((a > 0) & (b > 0)) if gap or k else np.zeros(0, np.int64)
            said.append((there, (a[there] * 256 + b[there]) * 4 + gap))
    t, code = (np.concatenate(c) for c in zip(*said, strict=True))
    order = np.lexsort((code, t))
    return " ".join([f"{i}:{c:x}" for i, c in zip(t[order].tolist(), code[order].tolist(), strict=True)])


def media_features(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with
    keep_media, the WAV file itself as `media`.

    The payload is the text's UTF-8 bytes (null: none) with bytes 0 up to a positive multiple of 64; everything but
    n_bytes comes from what is read back from the stored file. One row a row; equal texts give equal values; no
    shuffle. A WAV file holds at most 4 GB, beyond what a string column holds.
    """
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kind += ", media binary" if keep_media else ""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    raw = text or b""
                    media = write_wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                    back = read_wav(media)
                    row = (i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), peak_pairs(back))
                    out.append((*row, media) if keep_media else row)
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                n = 9 if keep_media else 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[:n], strict=True)], names[:n])

    return docs.select("doc_id", "text").mapInArrow(run, kind)
