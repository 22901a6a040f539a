import hashlib
import io
import math
import wave

import numpy as np

from corpusloom.llm.audio import CLIP, FRAME, HOP, MELS, RATE, audio_column, energy_segments, log_mel, low_pass, read_tensors, resample

SCHEMA = "doc_id long, text string"


def test_payload_round_trip(spark):
    texts = [None, "", "a", "é" * 31, "x" * 64, "y" * 65, "long " * 60_000]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], SCHEMA + ", media string")
    got = {r.doc_id: r for r in audio_column(df).collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        row = got[k]
        assert row.n_bytes == len(data) and bytes(row.payload) == padded
        with wave.open(io.BytesIO(bytes(row.media))) as stored:
            assert (stored.getnchannels(), stored.getsampwidth()) == (1, 1)
            assert hashlib.sha256(stored.readframes(stored.getnframes())).digest() == hashlib.sha256(padded).digest()
        tensors = read_tensors(bytes(row.tensors))
        assert len(tensors) == row.n_clips and tensors["clip"].type.shape == [CLIP, MELS]
        assert all(a < b for a, b in zip(tensors["start_s"].to_pylist(), tensors["end_s"].to_pylist()))
        assert all(0 <= s.start_s < s.end_s for s in row.segments)


def test_equal_texts_equal_values_and_empty(spark):
    df = spark.createDataFrame([(None, "same text"), (None, "same text"), (5, "same text")], SCHEMA)
    assert len({(bytes(r.media), bytes(r.tensors), r.feature) for r in audio_column(df).collect()}) == 1
    assert audio_column(df.limit(0)).count() == 0


def test_resample_equals_the_plain_filter():
    rng = np.random.default_rng(2)
    for up, down in ((1, 2), (2, 1), (3, 2), (2, 3), (1, 1)):
        x = rng.standard_normal(200).astype(np.float32)
        taps = low_pass(up, down).T.ravel()
        raised = np.zeros(len(x) * up)
        raised[::up] = x
        full = np.convolve(raised, taps)
        n, centre = -(-len(x) * up // down), low_pass(up, down).size // 2
        wanted = np.array([full[centre + i * down] if centre + i * down < len(full) else 0 for i in range(n)])
        assert np.allclose(resample(x, up, down), wanted, atol=1e-4)
    tone = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    half = resample(tone)
    assert np.argmax(np.abs(np.fft.rfft(half))) * RATE / len(half) == 440


def test_hysteresis():
    energy = np.array([0, 0, 10, 5, 5, 10, 0, 5, 5, 0, 10, 0], dtype=np.float32)
    assert energy_segments(energy) == [(2, 6), (10, 11)]


def plain_mel(y):
    """Frame by frame: a naive Fourier sum, triangles on the mel scale, logs."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1) if len(y) > FRAME else 1
    y = np.concatenate((y.astype(np.float64), np.zeros(n * HOP + FRAME)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(mel(RATE / 2) * k / (MELS + 1)) for k in range(MELS + 2)]
    frames, energy = [], []
    turns = np.exp(-2j * np.pi * np.outer(np.arange(FRAME // 2 + 1), np.arange(FRAME)) / FRAME)
    for k in range(n):
        part = y[k * HOP : k * HOP + FRAME] * window
        power = np.abs(turns @ part) ** 2
        row = []
        for m in range(MELS):
            low, mid, high = edges[m : m + 3]
            total = 0.0
            for b, p in enumerate(power):
                hz = b * RATE / FRAME
                if low < hz < high:
                    total += p * ((hz - low) / (mid - low) if hz <= mid else (high - hz) / (high - mid))
            row.append(math.log(total + 1e-6))
        frames.append(row)
        energy.append(math.log(sum(part * part) + 1e-6))
    return np.array(frames), np.array(energy)


def plain_segments(energy):
    mean, deviation = energy.mean(), energy.std()
    on, out = False, []
    for k, e in enumerate(energy):
        was, on = on, e > mean + 0.5 * deviation or (on and not e < mean - 0.5 * deviation)
        if on and not was:
            out.append([k, k + 1])
        elif on:
            out[-1][1] = k + 1
    return [tuple(s) for s in out]


def test_log_mel_equals_the_plain_sums():
    rng = np.random.default_rng(3)
    for n in (1, 100, FRAME, FRAME + 1, 1000, 2 * FRAME + HOP):
        y = rng.standard_normal(n).astype(np.float32)
        mel, energy = log_mel(y)
        want, loud = plain_mel(y)
        assert mel.shape == want.shape and np.allclose(mel, want, atol=2e-3) and np.allclose(energy, loud, atol=2e-3)


def test_tensors_segments_and_feature_from_the_stored_bytes(spark):
    """Everything that is derived, again from the bytes that were stored."""
    rng = np.random.default_rng(4)
    texts = ["", "a", "quiet " * 200 + "".join(chr(33 + int(c)) for c in rng.integers(0, 90, 3000)) + " " * 3000, "".join(chr(int(c)) for c in rng.integers(32, 500, 4000))]
    for r in audio_column(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        x = (np.frombuffer(bytes(r.payload), np.uint8).astype(np.float32) - 128) / 128
        want, _ = plain_mel(resample(x))
        assert r.n_frames == len(want) and r.n_clips == -(-len(want) // CLIP)
        tensors = read_tensors(bytes(r.tensors))
        clips = np.concatenate([np.asarray(c, np.float32).reshape(CLIP, MELS) for c in tensors["clip"].combine_chunks().storage.to_pylist()])
        assert np.allclose(clips[: len(want)], want, atol=5e-3) and (clips[len(want) :] == np.float32(math.log(1e-6))).all()
        assert tensors["start_s"].to_pylist() == [k * CLIP * HOP / RATE for k in range(r.n_clips)]
        _, energy = log_mel(resample(x))
        spans = plain_segments(energy.astype(np.float64))
        assert [(s.start_s, s.end_s) for s in r.segments] == [(a * HOP / RATE, ((b - 1) * HOP + FRAME) / RATE) for a, b in spans]
        parts = dict(p.split("=") for p in r.feature.split(";"))
        assert (int(parts["frames"]), int(parts["segments"]), int(parts["on"])) == (len(want), len(spans), sum(b - a for a, b in spans))
        assert np.allclose([float(v) for v in parts["mel"].split(",")], [want[:, k * 4 : k * 4 + 4].mean() for k in range(8)], atol=0.02)
