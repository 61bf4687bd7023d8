"""Media columns: texts stored as WAV, read back by ``wave``, and spectral-peak pair fingerprints.

A payload is kept as 8-bit mono samples, so the stored form is lossless. The stored
bytes are read again with the standard library's ``wave`` module; a short-time
Fourier transform (Hann window) gives the strongest bin of each frequency band per
frame, and every peak is paired with the strongest peak of each of the next frames.
A pair is one time-coded integer: ``frame << 32 | f1 << 16 | f2 << 4 | gap``.

Defined results: a null text is an empty one; an empty text is one block of zero
bytes; a payload shorter than a window is padded with silence for the transform
only; silent frames have no peaks, so the array may be empty; repeated rows give
repeated results; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, slices, whole_text

BLOCK = 64
RATE = 8000
WINDOW, HOP, BANDS, AHEAD = 256, 128, 4, 3
#: A peak stands this many times above the mean magnitude of its frame.
OVER_MEAN = 2.0
#: Frames transformed at once; bounds memory for texts of any length.
FRAMES = 8192


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and the unpadded length."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def store_wav(payload: bytes, rate: int = RATE) -> bytes:
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


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band: the bin of the peak (-1: none) and its magnitude."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    if len(x) < WINDOW:
        x = np.concatenate([x, np.full(WINDOW - len(x), 128, np.float32)])
    x -= 128.0
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    hann = np.hanning(WINDOW).astype(np.float32)
    width = WINDOW // 2 // BANDS
    at, power = [], []
    for i in range(0, len(frames), FRAMES):
        spectrum = np.fft.rfft(frames[i : i + FRAMES] * hann, axis=1)[:, 1:]
        mag = (spectrum.real**2 + spectrum.imag**2).reshape(len(spectrum), BANDS, width)
        best = mag.argmax(axis=2)
        top = np.take_along_axis(mag, best[:, :, None], 2)[:, :, 0]
        keep = top > np.maximum(OVER_MEAN**2 * mag.mean(axis=(1, 2)), 1e-6)[:, None]
        at.append(np.where(keep, best + np.arange(BANDS) * width + 1, -1))
        power.append(np.where(keep, top, 0.0))
    return np.concatenate(at), np.concatenate(power)


def peak_pairs(samples: bytes) -> np.ndarray:
    """Time-coded pairs in order of frame, band and gap."""
    at, power = peaks(samples)
    n = len(at)
    strongest = at[np.arange(n), power.argmax(axis=1)]
    out = []
    for gap in range(1, AHEAD + 1):
        target = np.full(n, -1)
        target[: max(0, n - gap)] = strongest[gap:]
        code = (np.arange(n)[:, None] << 32) | (at << 16) | (target[:, None] << 4) | gap
        out.append(np.where((at >= 0) & (target >= 0)[:, None], code, -1))
    codes = np.stack(out, axis=2).reshape(-1)
    return codes[codes >= 0].astype(np.int64)


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``media`` (the WAV bytes) and ``n_bytes`` to ``doc_id``."""

    @lean
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [to_payload(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([store_wav(p) for p, _ in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads ``media`` back and computes ``pairs``, the time-coded peak pairs."""

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            pairs = [peak_pairs(read_wav(m)) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pairs, pa.list_(pa.int64()))], ["doc_id", "pairs"])

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, pairs array<long>")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long, pairs array<long>"


def digest_row(text: str | None) -> tuple:
    """Stores one text, reads the stored bytes back and digests them."""
    payload, n = to_payload(text)
    media = store_wav(payload)
    back = read_wav(media)
    pairs = peak_pairs(back)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return n, len(back), sha(back), zlib.crc32(back[-BLOCK:]), len(media), sha(media), f"{len(pairs)}:{sha(pairs.astype('<i8').tobytes())}", len(pairs), pairs


def media_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Store, read back and fingerprint in one pass, without moving media between processes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols = list(zip(*map(digest_row, b.column(1).to_pylist()), strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), whole_text(text).alias("text")).mapInArrow(run, DIGEST)
