"""Byte payloads as 8-bit audio: lossless WAV, polyphase resampling, log-mel tensors, energy segments."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import text_bytes

ALIGN = 64
RATE_IN, UP, DOWN = 16_000, 1, 2
RATE = RATE_IN * UP // DOWN
TAPS_PER_PHASE = 16
FRAME, HOP, MELS = 256, 128, 32
#: Frames of one tensor; the last of a recording is filled up with FLOOR.
CLIP = 16
FLOOR = np.float32(np.log(1e-6))
#: Hysteresis: a segment begins above ENTER and ends below LEAVE, both in standard deviations from the mean log energy.
ENTER, LEAVE = 0.5, -0.5

SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, tensors binary, n_clips long, n_frames long, segments array<struct<start_s:double,end_s:double>>, feature string"


def wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    """A mono 8-bit PCM file whose samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of an 8-bit PCM file, found by walking its chunks."""
    at = 12
    while at < len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def low_pass(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc, in rows by phase: row p holds taps p, p + up, p + 2 up and so on."""
    half = TAPS_PER_PHASE // 2 * max(up, down)
    t = np.arange(-half, half)
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * half, 6.0)
    h *= up / h.sum()
    h = np.concatenate((h, np.zeros(-len(h) % up)))
    return h.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Rational resampling by up / down; each output phase is a short filter over strided input."""
    phases = low_pass(up, down)
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    centre = phases.size // 2
    padded = np.concatenate((np.zeros(taps, np.float32), x, np.zeros(taps + down, np.float32)))
    out = np.zeros(n, np.float32)
    for r in range(min(up, n)):
        first, phase = divmod(r * down + centre, up)
        count = len(range(r, n, up))
        acc = np.zeros(count, np.float32)
        for j, h in enumerate(phases[phase]):
            begin = taps + first - j
            piece = padded[begin : begin + down * (count - 1) + 1 : down]
            acc[: len(piece)] += h * piece
        out[r::up] = acc
    return out


@cache
def filterbank(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangular filters that overlap by half, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None).T.astype(np.float32)


#: Frames that are transformed at once; bounds memory for long recordings.
FRAMES_AT_ONCE = 4096


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, log energy of each frame)."""
    y = np.concatenate((y, np.zeros(max(0, FRAME - len(y)) + (-(len(y) - FRAME) % HOP if len(y) > FRAME else 0), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), filterbank(RATE, FRAME, MELS)
    mel, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[i : i + FRAMES_AT_ONCE] * window
        mel[i : i + len(part)] = np.log(np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2 @ bank + 1e-6)
        energy[i : i + len(part)] = np.log((part * part).sum(axis=1) + 1e-6)
    return mel, energy


def energy_segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames (first, after the last) that are on, with hysteresis between two thresholds."""
    mean, deviation = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + ENTER * deviation, 1, np.where(energy < mean + LEAVE * deviation, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(known >= 0, mark[np.maximum(known, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), [CLIP, MELS])
TENSOR_SCHEMA = pa.schema([("clip", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensor_stream(mel: np.ndarray) -> bytes:
    """Arrow stream of the frames as fixed-shape tensors of CLIP frames, each with its time span."""
    clips = -(-len(mel) // CLIP)
    filled = np.full((clips * CLIP, MELS), FLOOR, np.float32)
    filled[: len(mel)] = mel
    begin = np.arange(clips) * CLIP
    end = np.minimum(begin + CLIP, len(mel))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), CLIP * MELS)
    spans = (pa.array(begin * HOP / RATE), pa.array(((end - 1) * HOP + FRAME) / RATE))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), *spans], schema=TENSOR_SCHEMA))
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def describe(data: bytes) -> dict:
    """One recording's stored form and what is computed from reading it back."""
    media = wav(data + bytes(-len(data) % ALIGN or (0 if data else ALIGN)))
    payload = samples(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    spans = energy_segments(energy)
    bands = mel.reshape(len(mel), 8, MELS // 8).mean(axis=(0, 2), dtype=np.float64)
    return {
        "n_bytes": len(data),
        "media": media,
        "payload": payload,
        "tensors": tensor_stream(mel),
        "n_clips": -(-len(mel) // CLIP),
        "n_frames": len(mel),
        "segments": [{"start_s": a * HOP / RATE, "end_s": ((b - 1) * HOP + FRAME) / RATE} for a, b in spans],
        "feature": f"frames={len(mel)};segments={len(spans)};on={sum(b - a for a, b in spans)};mel=" + ",".join(f"{v:.2f}" for v in bands),
    }


#: Payload bytes after which a batch is given out.
BATCH_BYTES = 8 << 20


def audio_column(docs: DataFrame) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text) as audio and compute its features from the stored form.

    The UTF-8 bytes, filled up with zeros to a positive multiple of ALIGN, are the samples of a
    mono 8-bit PCM file. That is read back, resampled by UP / DOWN with a polyphase filter, cut
    into overlapping frames, and turned into log-mel tensors of fixed shape (CLIP, MELS), each
    with its time span, as an Arrow stream in ``tensors``. ``segments`` are the time spans that
    are loud, found with hysteresis. Row by row, no shuffle; equal texts give equal values.

    Cases: null and empty texts are ALIGN zeros, n_bytes 0; a null doc_id stays null; repeated
    rows each get a row; a text of any length is one recording, transformed in slices; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in TARGET]
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("data"), strict=True):
                rows.append({"doc_id": doc_id} | describe(data.as_py()))
                held += len(rows[-1]["payload"])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], TARGET.field(n).type) for n in names], schema=TARGET)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], TARGET.field(n).type) for n in names], schema=TARGET)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_bytes("text").alias("data")).mapInArrow(run, SCHEMA)


TARGET = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("tensors", pa.binary()),
    ("n_clips", pa.int64()), ("n_frames", pa.int64()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("feature", pa.string()),
])
