"""Media columns: texts kept as 8-bit WAV samples, with spectral-peak pair fingerprints.

``wav`` stores bytes losslessly as unsigned 8-bit mono samples; ``fingerprint`` reads a WAV
with the wave module, takes short-time Fourier transforms and pairs each peak with those
that follow it shortly, as arrays of (frame, code).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = 576
RATE = 8000
PEAKS = 3
FAN = 4
REACH = 6
BLOCK = 4096
#: A peak has at least this part of its frame's greatest magnitude; below is what rounding leaves of a constant.
LEAST = 1e-4

ANALYSIS = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("frames", T.LongType()),
    T.StructField("pair_time", T.ArrayType(T.IntegerType())), T.StructField("pair_code", T.ArrayType(T.IntegerType())),
])


def wav(payload: bytes) -> bytes:
    """A WAV file whose 8-bit samples are the bytes, padded with 255 to a positive multiple of FRAME."""
    payload += b"\xff" * (max(FRAME, -(-len(payload) // FRAME) * FRAME) - len(payload))
    to = io.BytesIO()
    with wave.open(to, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return to.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """The PEAKS strongest local maxima of each frame's spectrum, ascending; -1 where there are fewer.

    Blocks of frames are transformed one after another, so memory doesn't grow with the text.
    """
    x = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    window = np.hanning(FRAME).astype(np.float32)
    found = []
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK].astype(np.float32) - 128
        power = np.abs(np.fft.rfft(part * window, axis=1))
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.argpartition(-inner, PEAKS, axis=1)[:, :PEAKS]
        strong = np.take_along_axis(inner, best, 1) > LEAST * power.max(axis=1, keepdims=True)
        found.append(np.sort(np.where(strong, best + 1, -1), axis=1))
    return np.concatenate(found)


def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each peak with the next FAN peaks up to REACH frames on: its frame, and both bins and the distance in one code."""
    time, slot = np.nonzero(at >= 0)
    bins = at[time, slot]
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = time[step:] - time[:-step]
        near = gap <= REACH
        times.append(time[:-step][near])
        codes.append(((bins[:-step] << 13) | (bins[step:] << 4) | gap)[near])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


@F.pandas_udf(T.BinaryType())
def to_media(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda x: wav(bytes(x)))


@F.pandas_udf(ANALYSIS)
def analysed(media: pd.Series) -> pd.DataFrame:
    rows = []
    for file in media:
        payload = samples(bytes(file))
        time, code = pairs(peaks(payload))
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), len(payload) // FRAME, time, code))
    return pd.DataFrame(rows, columns=ANALYSIS.names)


def media_column(text: Column) -> Column:
    """The WAV file of a text's UTF-8 bytes; null is an empty text."""
    return to_media(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def media_features(docs: DataFrame) -> DataFrame:
    """For each document its WAV's digests and fingerprint.

    Takes columns doc_id and text; others are ignored, whatever their names. A null or empty
    text is one frame of 255s, which has no peak and so an empty fingerprint. Repeated rows
    and null ids each give a row; an empty table gives none. feature is the frame count and a
    digest of the fingerprint arrays, equal for equal texts.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        analysed(media_column(F.col("text"))).alias("m"),
    )
    feature = F.concat_ws(":", F.col("m.frames"), F.size("m.pair_time"), F.sha2(F.concat_ws(",", F.array_join("m.pair_time", " "), F.array_join("m.pair_code", " ")), 256))
    return rows.select("doc_id", "n_bytes", "m.payload_bytes", "m.payload_sha256", "m.tail_crc32", "m.media_bytes", "m.media_sha256", feature.alias("feature"), "m.pair_time", "m.pair_code")
