"""Media columns: 8-bit audio, polyphase resampling, log-mel filterbanks and hysteresis energy segments."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import table

BLOCK = 64  # fixed by the contract: payloads are padded to a positive multiple of this


@dataclass(frozen=True)
class Settings:
    """rate: of the stored samples; up/down: the resampling ratio; frames of `frame` samples every `hop` after it.

    A tensor has shape (frames, mels). on/off: a segment starts where a frame's energy, in dB under the loudest frame,
    reaches on, and ends before it falls under off; segments shorter than least frames are dropped.
    """

    rate: int = 8000
    up: int = 3
    down: int = 4
    taps: int = 8
    frame: int = 192
    hop: int = 96
    mels: int = 16
    frames: int = 32
    on: float = -1.0
    off: float = -3.0
    least: int = 2


def encode_wav(payload: bytes, rate: int) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples: one byte of payload is one sample, so nothing is lost."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples), found by walking the chunks; other formats are refused."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _polyphase(up: int, down: int, taps: int) -> tuple[np.ndarray, int]:
    """The bank: row p holds the taps that make output phase p from the inputs around it; and the half width."""
    half = taps * max(up, down) // up
    n = np.arange(-half * up, half * up + 1)
    cut = 1.0 / max(up, down)
    low = cut * np.sinc(n * cut) * np.hamming(len(n)) * up
    bank = np.zeros((up, 2 * half + 1), np.float32)
    for p in range(up):
        shift = (p * down) % up
        for j in range(-half, half + 1):
            k = shift - j * up
            if -half * up <= k <= half * up:
                bank[p, j + half] = low[k + half * up]
    return bank / bank.sum(axis=1, keepdims=True), half


def resample(x: np.ndarray, up: int, down: int, taps: int = 8, start: int = 0, end: int | None = None) -> np.ndarray:
    """x at up/down of its rate: output m is the bank's phase m mod up over the inputs around m * down / up.

    Outputs start up to end alone if given; what they need of x is then all that is made a float. 8-bit samples are
    centred and scaled to -1 to 1.
    """
    bank, half = _polyphase(up, down, taps)
    end = -(-len(x) * up // down) if end is None else end
    centre = np.minimum(np.arange(start, end) * down // up, len(x) - 1)
    out = np.empty(end - start, np.float32)
    if not len(out):
        return out
    lo, hi = int(centre[0]) - half, int(centre[-1]) + half + 1
    part = x[max(lo, 0) : hi].astype(np.float32)
    if x.dtype == np.uint8:
        part = (part - 128) / 128
    part = np.pad(part, (max(-lo, 0), max(hi - len(x), 0)))
    windows = np.lib.stride_tricks.sliding_window_view(part, 2 * half + 1)
    for p in range(up):
        at = slice((p - start) % up, None, up)
        out[at] = np.einsum("ij,j->i", windows[centre[at] - half - lo], bank[p])
    return out


@cache
def _filters(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles spaced evenly in mel, over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    rise = (bins - points[:-2, None]) / np.diff(points)[:-1, None]
    fall = (points[2:, None] - bins) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


STEP = 2048  # frames that are worked at once


def log_mel(samples: np.ndarray, rate: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) in dB, and each frame's energy in dB, of the resampled samples. Short inputs are padded to one frame.

    Long recordings pass through in steps: of each, only its own stretch is resampled, so that beside the samples and
    the result (together 1.6 bytes a sample) the memory is bounded.
    """
    total = -(-len(samples) * s.up // s.down)
    n = 1 + max(0, -(-(total - s.frame) // s.hop))
    window, filters = np.hanning(s.frame).astype(np.float32), _filters(rate, s.frame, s.mels)
    mel, energy = np.empty((n, s.mels), np.float32), np.empty(n, np.float32)
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        first, last = a * s.hop, (b - 1) * s.hop + s.frame
        y = resample(samples, s.up, s.down, s.taps, first, min(total, last))
        y = np.pad(y, (0, last - first - len(y)))
        f = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop] * window
        power = np.abs(np.fft.rfft(f, axis=1)).astype(np.float32) ** 2
        mel[a:b] = 10 * np.log10(power @ filters + 1e-6)
        energy[a:b] = 10 * np.log10(np.einsum("ij,ij->i", f, f) / s.frame + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, on: float, off: float, least: int) -> list[tuple[int, int]]:
    """Runs of frames by hysteresis: from a frame at least at on, until one is under off; ends exclusive."""
    level = np.where(energy >= on, 2, np.where(energy >= off, 1, 0))
    runs, start = [], None
    for i in np.flatnonzero(np.diff(level, prepend=-1)):
        if start is None and level[i] == 2:
            start = int(i)
        elif start is not None and level[i] == 0:
            runs.append((start, int(i)))
            start = None
    if start is not None:
        runs.append((start, len(level)))
    return [r for r in runs if r[1] - r[0] >= least]


def features(media: bytes, s: Settings = Settings()) -> dict:
    """What one stored recording holds: tensors of (s.frames, s.mels), the last padded with its floor, and spans in ms."""
    rate, samples = decode_wav(media)
    x = np.frombuffer(samples, np.uint8)
    mel, energy = log_mel(x, rate * s.up / s.down, s)
    n = -(-len(mel) // s.frames)
    tensor = np.full((n * s.frames, s.mels), -60, np.float32)
    tensor[: len(mel)] = mel
    ms = lambda i: i * s.hop * 1000 * s.down // (rate * s.up)
    last = len(x) * 1000 // rate
    spans = [(ms(i * s.frames), min(last, ms((i + 1) * s.frames))) for i in range(n)]
    loud = [(ms(a), min(last, ms(b))) for a, b in segments(energy - energy.max(), s.on, s.off, s.least)]
    return {"payload": samples, "tensors": tensor.reshape(n, s.frames * s.mels), "spans": spans, "segments": loud}


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the padded payload): UTF-8 with bytes 0 up to a positive multiple of 64. Null: empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


SPAN = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
COLUMNS = "n_bytes long, media binary, tensors array<array<float>>, spans array<struct<start_ms:long,end_ms:long>>, segments array<struct<start_ms:long,end_ms:long>>"


def tensor_type(s: Settings = Settings()) -> pa.DataType:
    """The Arrow type of one tensor: fixed shape (frames, mels)."""
    return pa.fixed_shape_tensor(pa.float32(), (s.frames, s.mels))


def to_tensors(tensors: pa.ListArray, s: Settings = Settings()) -> pa.ExtensionArray:
    """A column of tensors, as Spark hands it over (list of lists), as one fixed-shape tensor array, rows in order."""
    return fixed_shape(tensors.flatten().flatten(), s)


def fixed_shape(flat: pa.Array, s: Settings = Settings()) -> pa.ExtensionArray:
    """A tensor array over the floats of all its tensors, which it doesn't copy."""
    return pa.ExtensionArray.from_storage(tensor_type(s), pa.FixedSizeListArray.from_arrays(flat, s.frames * s.mels))


def media_columns(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), s: Settings = Settings(), slim: bool = False) -> DataFrame:
    """The columns in carry, and n_bytes, media (a WAVE file of the text's bytes), tensors, spans and segments.

    Everything but n_bytes is computed from the stored file as read back. tensors is a list of flat float lists, each
    the storage of one fixed-shape tensor (see tensor_type); spans has each tensor's time, segments the loud stretches.
    slim: leaves these out and puts feature instead, a digest of what the stored tensors hold when read back, rounded
    to 0.01 dB, of spans and segments. Names in carry must not be n_bytes, media, tensors, spans, segments or feature.
    Null and empty texts: 64 bytes of 0. Each row is worked alone, so equal texts give equal values; nothing is
    shuffled. Empty table: empty result. Batches are handed on in parts of bounded size.
    """
    ship(docs.sparkSession)
    names = list(carry)
    if taken := {"n_bytes", "media", "tensors", "spans", "segments", "feature", "__text"} & set(names):
        raise ValueError(f"carried columns must be renamed first: {', '.join(sorted(taken))}")
    pairs = lambda rows: pa.array([[{"start_ms": a, "end_ms": b} for a, b in r] for r in rows], SPAN)

    def emit(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        cols = [b.column(c).take(pa.array(at)) for c in names]
        cols += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
        counts = [len(r[2]["tensors"]) for r in rows]
        stored = fixed_shape(pa.array(np.concatenate([r[2]["tensors"].ravel() for r in rows]), pa.float32()), s)
        if slim:
            firsts = np.cumsum(counts) - counts
            held = [stored.slice(a, n).to_numpy_ndarray() for a, n in zip(firsts.tolist(), counts)]
            cols.append(pa.array([digest(t, r[2]["spans"], r[2]["segments"]) for t, r in zip(held, rows)], pa.string()))
            return pa.RecordBatch.from_arrays(cols, names=[*names, "n_bytes", "media", "feature"])
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(stored) + 1, dtype=np.int32) * (s.frames * s.mels), pa.int32()), stored.storage.values)
        outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), inner)
        cols += [outer, pairs([r[2]["spans"] for r in rows]), pairs([r[2]["segments"] for r in rows])]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "n_bytes", "media", "tensors", "spans", "segments"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, held = [], [], 0
            for i, t in enumerate(b.column("__text")):
                n, payload = payload_of(t.as_py())
                media = encode_wav(payload, s.rate)
                at.append(i)
                rows.append((n, media, features(media, s)))
                held += len(media)
                if held > 4_000_000:
                    yield emit(b, at, rows)
                    at, rows, held = [], [], 0
            if rows:
                yield emit(b, at, rows)

    rows = docs.select(*names, F.col("text").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(work, f"{kept}, n_bytes long, media binary, feature string" if slim else f"{kept}, {COLUMNS}")


def digest(tensors: np.ndarray, spans: list, loud: list) -> str:
    """Tensors of shape (count, frames, mels), spans and segments in a short string: counts, the least and the mean
    level in dB, and a hash of all."""
    whole = np.rint(tensors * 100).astype(np.int32)
    h = hashlib.sha256(whole.tobytes() + repr((spans, loud)).encode()).hexdigest()
    return f"{len(whole)} tensors, {len(loud)} segments, least {int(whole.min()) // 100} dB, mean {int(whole.sum(dtype=np.int64)) // whole.size // 100} dB, {h[:32]}"


def op2_media_audio(spark, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), slim=True)
    payload = F.expr("substring(media, 45)")  # the samples follow the header of 44 bytes
    out = found.select("doc_id", "n_bytes", payload.alias("payload"), "media", "feature")
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
