"""Media columns: texts as 8-bit WAV samples, with spectral-peak pair fingerprints.

A payload is stored as mono 8-bit WAV and read back by the ``wave`` module. A short-time Fourier
transform gives a magnitude for each frame and frequency; the strongest local peaks of each frame (``peaks`` = 3
of those with at least 1 / ``floor`` = 1 / 16 of the frame's largest magnitude, so that rounding noise is none) are
landmarks, and each landmark is paired with the next ``fan`` = 3 ones in time. A pair ``(f1, f2, dt)`` at frame
``t`` is one 64-bit code ``t << 32 | f1 << 20 | f2 << 8 | dt``, so a fingerprint is an array of codes
in order of time. Pairs 256 or more frames apart, as over a long run of one sign, have negative codes, which
come first: the sign bit, ``t`` and ``dt`` of 24 bits, ``f1`` and ``f2`` of 7 (for frames of 256).

Nulls and empty texts are 64 zero bytes: silence, which has no peaks and an empty fingerprint. Texts of
any length are processed whole, in blocks of frames; the rounded mean goes before and after the samples, for a
hop and up to a whole number of hops, so that every sample counts in two frames and none only where the window
fades out. Equal texts get equal values; an empty table gives no rows; rows are independent, so repeated rows, ties in ``doc_id`` and further
columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import sliced, texts

RATE = 8000


@dataclass(frozen=True)
class Spectrum:
    frame: int = 256
    hop: int = 128
    peaks: int = 3  # landmarks of a frame
    fan: int = 3  # later landmarks that one is paired with
    floor: int = 16  # a landmark's magnitude times this is the frame's largest one at least
    block: int = 4096  # frames transformed at once


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


def landmarks(samples: bytes, s: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequencies of the peaks, in order of time and then of frequency."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    x = np.pad(x, (s.hop, max(s.frame - s.hop - len(x), s.hop + -len(x) % s.hop)), constant_values=np.rint(x.mean(dtype=np.float64)))
    views = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
    window = np.hanning(s.frame).astype(np.float32)
    when, which = [], []
    for at in range(0, len(views), s.block):
        frames = views[at : at + s.block]
        frames = (frames - frames.mean(axis=1, keepdims=True)) * window
        # rounded, so that the last bits of a transform never decide between two peaks
        power = np.rint(np.abs(np.fft.rfft(frames, axis=1)) * 16).astype(np.int64)
        inner = power[:, 1:-1]
        peak = (inner > power[:, :-2]) & (inner >= power[:, 2:]) & (s.floor * inner >= inner.max(axis=1, keepdims=True))
        rank = np.where(peak, inner * 4096 + (4095 - np.arange(1, inner.shape[1] + 1)), -1)
        best = np.sort(np.partition(rank, -s.peaks, axis=1)[:, -s.peaks :], axis=1)
        frame, place = np.nonzero(best >= 0)
        freq = 4095 - best[frame, place] % 4096
        order = np.lexsort((freq, frame))
        when.append(frame[order] + at)
        which.append(freq[order])
    return np.concatenate(when), np.concatenate(which)


def fingerprint(samples: bytes, s: Spectrum = Spectrum()) -> np.ndarray:
    """The codes of all landmark pairs, in order of time."""
    t, f = landmarks(samples, s)
    b = (s.frame // 2 - 1).bit_length()
    w = (63 - 2 * b) // 2
    codes = []
    for k in range(1, s.fan + 1):
        if len(t) > k:
            dt = t[k:] - t[:-k]
            code = t[:-k] << 32 | f[:-k] << 20 | f[k:] << 8 | dt
            codes.append(np.where(dt < 256, code, np.iinfo(np.int64).min | t[:-k] << w + 2 * b | dt << 2 * b | f[:-k] << b | f[k:]))
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def stored_media(docs: DataFrame, spectrum: Spectrum = Spectrum()) -> DataFrame:
    """``doc_id``, ``n_bytes`` of the text, ``media`` (the WAV file) and ``fingerprint`` (the time-coded pairs)."""

    def kernel(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            raws = texts(batch)
            media = [to_wav(padded(raw)) for raw in raws]
            codes = [fingerprint(from_wav(m), spectrum) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(raw) for raw in raws], pa.int64()), pa.array(media, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "media", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id long, n_bytes long, media binary, fingerprint array<long>")


def media_columns(docs: DataFrame, spectrum: Spectrum = Spectrum(), keep_media: bool = False, keep_codes: bool = True) -> DataFrame:
    """A row for each document: sizes and digests of payload and stored form, and the fingerprint.

    All but ``n_bytes`` are derived from the columns of :func:`stored_media`, which can be left out of the result.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_landmark_pairs long"
    schema += ", fingerprint array<long>" * keep_codes + ", media binary" * keep_media

    def kernel(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            rows = []
            for media, codes in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                back, own = from_wav(media), codes.values.to_numpy(zero_copy_only=False)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(own.astype("<i8").tobytes()).hexdigest(), len(own)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
            columns += [batch.column(3)] * keep_codes + [batch.column(2)] * keep_media
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return stored_media(docs, spectrum).mapInArrow(kernel, schema)
