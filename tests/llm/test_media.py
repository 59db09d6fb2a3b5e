import hashlib
import io
import time
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trialforge.llm import media

from .helpers import odd_docs


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op2_media_audio(spark, sf).collect()
    assert len(rows) == len(docs)
    seen = {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        p = raw + bytes(-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(p), len(p) + 44)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert media.decode_wav(media.encode_wav(p, 8000)) == (8000, p)
        assert seen.setdefault(docs[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_resample_keeps_a_tone():
    t = np.arange(4000) / 8000
    x = np.sin(2 * np.pi * 500 * t)
    y = media.resample(x, 3, 4)
    want = np.sin(2 * np.pi * 500 * np.arange(len(y)) / 6000)
    assert len(y) == 3000 and np.abs(y - want)[50:-50].max() < 0.02
    alias = media.resample(np.sin(2 * np.pi * 3800 * t), 3, 4)
    assert np.abs(alias[50:-50]).max() < 0.05


def test_mel_peak_and_segments():
    s = media.Settings(up=1, down=1)
    y = np.sin(2 * np.pi * 1000 * np.arange(6000) / 6000).astype(np.float32)
    mel, _ = media.log_mel(y, 6000, s)
    points = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 3000 / 700), s.mels + 2) / 2595) - 1)
    assert abs(points[1 + int(mel[5].argmax())] - 1000) < 200
    e = np.array([-9, -9, 0, -2, -2, -9, -2, -9, 0, 0, -2.0])
    assert media.segments(e, -1, -3, 2) == [(2, 5), (8, 11)]


def test_tensors_and_odd_rows(spark):
    docs = odd_docs(spark, "media tensors")
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count()
    s = media.Settings()
    for r in rows:
        assert len(r.tensors) == len(r.spans) and all(len(t) == s.frames * s.mels for t in r.tensors)
        assert all(a.start_ms < a.end_ms for a in r.spans) and r.spans[0].start_ms == 0
    assert {r.n_bytes for r in rows} >= {0, 1}
    got = media.to_tensors(pa.array([r.tensors for r in rows], pa.list_(pa.list_(pa.float32()))))
    assert got.type == media.tensor_type() and len(got) == sum(len(r.tensors) for r in rows)
    assert got.to_numpy_ndarray().shape[1:] == (s.frames, s.mels)
    assert media.media_columns(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        media.media_columns(docs, carry=("doc_id", "media"))


def wav(payload):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(payload)
    return out.getvalue()


def plain_features(payload):
    """The features by definition: zeros between samples, one long filter, every fourth value; frame by frame spectra."""
    s = media.Settings()
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    half = s.taps * s.down // s.up
    n = np.arange(-half * s.up, half * s.up + 1)
    low = np.sinc(n / s.down) * np.hamming(len(n))
    phases = [low[(half * s.up - p) % s.up :: s.up].sum() for p in range(s.up)]
    total = -(-len(x) * s.up // s.down)
    y = np.zeros(total)
    for m in range(total):
        c, p = m * s.down // s.up, m * s.down % s.up
        taps = [(c + j, low[p - j * s.up + half * s.up]) for j in range(-half, half + 1) if abs(p - j * s.up) <= half * s.up]
        y[m] = sum(x[i] * w for i, w in taps if 0 <= i < len(x)) / sum(w for _, w in taps)
    assert len(phases) == s.up
    count = 1 + max(0, -(-(total - s.frame) // s.hop))
    y = np.pad(y, (0, (count - 1) * s.hop + s.frame - total))
    mel, energy = [], []
    for k in range(count):
        f = y[k * s.hop : k * s.hop + s.frame] * np.hanning(s.frame)
        power = np.abs(np.fft.rfft(f)) ** 2
        mel.append(10 * np.log10(power @ media._filters(6000.0, s.frame, s.mels) + 1e-6))
        energy.append(10 * np.log10((f**2).mean() + 1e-9))
    return np.array(mel), np.array(energy)


def test_features_against_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 6000").limit(12)
    s, steps = media.Settings(), media.STEP
    for r in media.media_columns(docs.select("doc_id", "text"), carry=("doc_id", "text")).collect():
        n, payload = media.payload_of(r.text)
        assert bytes(r.media) == wav(payload) and n == len(r.text.encode())
        mel, energy = plain_features(payload)
        got = np.array(r.tensors).reshape(-1, s.mels)
        assert np.abs(got[: len(mel)] - mel).max() < 0.05 and (got[len(mel) :] == -60).all() and len(got) - len(mel) < s.frames
        loud = media.segments(energy - energy.max(), s.on, s.off, s.least)
        assert abs(len(loud) - len(r.segments)) <= 1
        media.STEP = 7  # however the frames are dealt to steps
        try:
            assert np.allclose(media.features(bytes(r.media))["tensors"].ravel(), np.array(r.tensors).ravel(), atol=1e-3)
        finally:
            media.STEP = steps


def test_long_text(spark):
    """Five million characters: the payload is whole, and the work takes seconds."""
    text = "long text, näïve 🙂\n" * 280_000
    began = time.perf_counter()
    r = media.media_columns(spark.createDataFrame([(1, text)], "doc_id long, text string"), slim=True).first()
    assert bytes(r.media)[44:] == media.payload_of(text)[1] and r.n_bytes == len(text.encode())
    assert r.feature.startswith(f"{-(-(1 + -(-(len(r.media) - 44) * 3 // 4 - 192) // 96) // 32)} tensors") and time.perf_counter() - began < 60
