"""Texts as media columns: lossless WAV storage and spectral-peak fingerprints.

A payload is written as 8-bit mono samples by the standard ``wave`` module and
read back by it.  The samples go through a short-time Fourier transform (Hann
window, half-overlapping frames); in each frame the strongest bin of each of
some bands is a peak if it stands out from its frame; an anchor peak is paired
with peaks of the next frames, and (anchor bin, other bin, frame distance) is a
hash.  Fingerprints are arrays of (frame, hash), that is, time-coded.
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

from gleaner.llm.common import small_batches, text_of, worker_cache

BLOCK_BYTES = 576
RATE = 8000
FRAME, HOP = 256, 128
BANDS = ((2, 8), (8, 16), (16, 32), (32, 64), (64, 128))
STANDS_OUT = 2.0  # times the frame's mean magnitude
FAN_OUT = 2  # frames ahead that an anchor is paired with
FRAMES_AT_A_TIME = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of 576."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK_BYTES)) * BLOCK_BYTES - len(raw))


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


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """For each frame and band the bin of its peak, or -1; in blocks, so memory does not follow the length.

    Silence is added up to a whole number of hops, so that frames cover the end.
    """
    short = max(0, FRAME - len(samples)) or -(len(samples) - FRAME) % HOP
    samples = np.concatenate([samples, np.full(short, 128, samples.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS)), np.int16)
    for start in range(0, len(frames), FRAMES_AT_A_TIME):
        part = (frames[start : start + FRAMES_AT_A_TIME].astype(np.float32) - 128.0) * _WINDOW
        size = np.abs(np.fft.rfft(part, axis=1))[:, : BANDS[-1][1]].round(3)
        level = size[:, BANDS[0][0] :].mean(axis=1) * STANDS_OUT
        for k, (low, high) in enumerate(BANDS):
            at = size[:, low:high].argmax(axis=1)
            top = np.take_along_axis(size[:, low:high], at[:, None], 1)[:, 0]
            out[start : start + len(part), k] = np.where(top > level, at + low, -1)
    return out


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Rows (frame, hash) by frame, then hash; hash = anchor bin * 2^10 + other bin * 2^3 + distance."""
    peaks = spectral_peaks(samples)
    found = []
    for ahead in range(1, FAN_OUT + 1):
        for a in range(len(BANDS)):
            anchor = peaks[:-ahead, a].astype(np.int64)
            for b in range(len(BANDS)):
                other = peaks[ahead:, b].astype(np.int64)
                frame = np.flatnonzero((anchor >= 0) & (other >= 0))
                found.append(np.stack([frame, (anchor[frame] << 10) | (other[frame] << 3) | ahead]))
    rows = np.concatenate(found, axis=1)
    return rows[:, np.lexsort((rows[1], rows[0]))].T


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per row: sizes and digests, and with ``keep_media`` the WAV and its fingerprints.

    Columns: ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature`` and ``media binary, peaks
    array<struct<frame int, hash int>>``.  A null text is the empty text, whose
    payload is one block of padding.  ``feature`` is the number of fingerprints
    and a digest of them, so equal texts have equal values.  Repeated rows
    repeat; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("body"))
    pair = pa.struct([("frame", pa.int32()), ("hash", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("media")
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, wavs, marks = [], [], []
                for text in part.column(1).to_pylist():
                    stored = to_wav(payload_of(text))
                    read = from_wav(stored)
                    found = fingerprints(np.frombuffer(read, np.uint8)).astype("<i4")
                    feature = f"{len(found)}:{hashlib.sha256(found.tobytes()).hexdigest()[:32]}"
                    rows.append((len(text.encode("utf-8", "surrogatepass")), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]),
                                 len(stored), hashlib.sha256(stored).hexdigest(), feature))
                    if keep_media:
                        wavs.append(stored)
                        marks.append([{"frame": int(f), "hash": int(h)} for f, h in found])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                extra = [pa.array(wavs, pa.binary()), pa.array(marks, pa.list_(pair))] if keep_media else []
                yield pa.RecordBatch.from_arrays(columns + extra, names=names + (["media", "peaks"] if keep_media else []))

    kind = source.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
        + (", media binary, peaks array<struct<frame:int,hash:int>>" if keep_media else "")
    )
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def matches(fingerprinted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, hash, frames``: how many frames of each row carry a hash, for lookups by hash."""
    return fingerprinted.select(id_col, F.explode("peaks").alias("p")).groupBy(id_col, F.col("p.hash").alias("hash")).agg(F.count("*").alias("frames"))
