"""Toxicity by compression distance: how much shorter text gets with a dictionary of toxic rather than ordinary text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window at most; windows end between words.
WINDOW = 56
#: Bytes of the dictionary that is trained on ordinary windows, and of each class's own; windows it is trained on.
COMMON_BYTES, OWN_BYTES, TRAIN_BYTES = 96_000, 4_000, 3_000_000
#: Segment and substring lengths by which the classes' own dictionaries are trained: a few words, most of a word.
SEGMENT, SUBSTRING = 32, 6
#: Least z-score and documents for a fragment to mark a class; lengths of word beginnings that count as fragments.
LEAST_Z, LEAST_DOCS, STEMS = 7.0, 3, (4, 5, 6, 7, 8)
#: Windows are counted that get shorter by more than these shares of ordinary windows do.
QUANTILES = (0.9, 0.95, 0.98, 0.99, 0.995)
N_FEATURES = 4 + 2 * len(QUANTILES)
LEVEL, MIN_MATCH = 3, 4
#: Bound of the labelled rows that are used to fit: documents of each class, and bytes of a document.
MAX_PER_CLASS, MAX_FIT_BYTES = 2_000, 1 << 16
FOLDS = 3

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def normalised(text: str) -> bytes:
    return _SPACE.sub(b" ", text.lower().encode("utf-8", "replace"))


def windows(data: bytes) -> list[bytes]:
    """Consecutive windows of whole words, each with the space before its first word."""
    if not (data := data.strip(b" ")):
        return []
    data = b" " + data + b" "
    out, at, last = [], 0, len(data) - 1
    while at < last:
        end = last if at + WINDOW >= last else data.rfind(b" ", at + 1, at + WINDOW)
        if end <= at:  # a word longer than a window is cut
            end = at + WINDOW - 1
        out.append(data[at : end + 1])
        at = end
    return out


def _words(text: str) -> Iterator[bytes]:
    for word in normalised(text).split(b" "):
        if word := word.strip(b".,;:!?|\"'()"):
            yield word


def _fragments_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, each behind a space."""
    return [b" " + word + b" ", *(b" " + word[:k] for k in STEMS if len(word) >= k)]


def fragments(text: str) -> set[bytes]:
    """Words and word beginnings, once each."""
    return {f for word in set(_words(text)) for f in _fragments_of(word)}


def marking_fragments(toxic: list[str], ordinary: list[str]) -> tuple[set[bytes], set[bytes]]:
    """Fragments whose share of documents is higher in ordinary, and in toxic texts, by LEAST_Z standard errors."""
    counts = [Counter(), Counter()]
    for counter, texts in zip(counts, (ordinary, toxic), strict=True):
        for text in texts:
            counter.update(fragments(text))
    n0, n1 = max(1, len(ordinary)), max(1, len(toxic))
    found: tuple[set[bytes], set[bytes]] = (set(), set())
    for fragment in counts[0].keys() | counts[1].keys():
        a, b = counts[0][fragment], counts[1][fragment]
        if a + b >= LEAST_DOCS:
            share = (a + b + 1) / (n0 + n1 + 2)
            z = (b / n1 - a / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
            if abs(z) >= LEAST_Z:
                found[int(z > 0)].add(fragment)
    return found


def _trained(samples: list[bytes], size: int, **parameters: int) -> bytes:
    """A dictionary that zstandard trains on ``samples``, of ``size`` bytes or, where these are too few for that, of less."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, **parameters).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The dictionaries of ordinary and of toxic text, trained by zstandard.

    Trained on whole texts, the two hold much the same common words, of which chance decides, and
    tell little. So both begin with one dictionary trained on windows of ordinary text, and each
    ends with one trained on its class's occurrences of words that mark the class.
    """
    windowed, size = [], 0
    for text in ordinary:
        parts = windows(normalised(text))
        windowed += parts
        size += sum(map(len, parts))
        if size >= TRAIN_BYTES:
            break
    common = _trained(windowed, COMMON_BYTES)
    own = []
    for marks, texts in zip(marking_fragments(toxic, ordinary), (ordinary, toxic), strict=True):
        # One sample a text: zstandard takes nothing from samples of under eight bytes.
        found = (b" ".join(w for w in _words(text) if not marks.isdisjoint(_fragments_of(w))) for text in texts) if marks else ()
        samples = [b" " + words + b" " for words in found if words]
        own.append(_trained(samples, OWN_BYTES, k=SEGMENT, d=SUBSTRING))
    return common + own[0], common + own[1]


class Meter:
    """How many bytes shorter the windows of a text get with the toxic than with the ordinary dictionary."""

    def __init__(self, contents: tuple[bytes, bytes]):
        self.compressors = []
        for content in contents:
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            # Under 8 bytes is not a dictionary; spaces stand for an empty one.
            data = zstandard.ZstdCompressionDict(content.rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=data))

    def shorter(self, text: str | None) -> np.ndarray:
        plain, toxic = (c.compress for c in self.compressors)
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(normalised(text or ""))], dtype=float)


def features(shorter: np.ndarray, thresholds: list[float]) -> list[float]:
    if not len(shorter):
        return [0.0] * N_FEATURES
    top = np.sort(shorter)[::-1][:3]
    marked = [float((shorter > t).sum()) for t in thresholds]
    return [shorter.mean(), top[0], top.sum() / 3, *np.log1p(marked), *(m / len(shorter) for m in marked), np.log1p(len(shorter))]


@dataclass(frozen=True)
class ToxicityModel:
    contents: tuple[bytes, bytes]
    thresholds: list[float]  # by which windows are counted
    mean: list[float]
    scale: list[float]
    weights: list[float]  # the intercept first

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        meter = Meter(self.contents)
        x = np.array([features(meter.shorter(t), self.thresholds) for t in texts], dtype=float).reshape(-1, len(self.mean))
        return _sigmoid(self.weights[0] + (x - self.mean) / self.scale @ np.array(self.weights[1:]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    a, w = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = _sigmoid(a @ w)
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, a.T @ (y - p) - ridge * w)
    return w


def calibrate(texts: list[str], toxic: list[int], odds: float = 1.0) -> ToxicityModel:
    """Dictionaries from all texts; thresholds and weights from what dictionaries of the other folds give.

    Thresholds are QUANTILES of how much shorter ordinary texts' windows get, each text with the
    dictionaries of folds without it. ``odds`` corrects the odds of the sample to those of all
    labelled rows.
    """
    y = np.array(toxic, dtype=float)
    fold = np.zeros(len(y), dtype=int)
    for label in (0, 1):  # either class in each fold
        of = np.flatnonzero(y == label)
        fold[of] = np.arange(len(of)) % FOLDS
    pick = lambda label, keep: [t for t, v, k in zip(texts, y, keep, strict=True) if v == label and k]
    shorter: list[np.ndarray] = [np.empty(0)] * len(y)
    for k in range(FOLDS):
        meter = Meter(dictionaries(pick(1, fold != k), pick(0, fold != k)))
        for i in np.flatnonzero(fold == k):
            shorter[i] = meter.shorter(texts[i])
    ordinary = np.concatenate([s for s, v in zip(shorter, y, strict=True) if not v] or [np.empty(0)])
    thresholds = np.quantile(ordinary, QUANTILES).tolist() if len(ordinary) else [0.0] * len(QUANTILES)
    x = np.array([features(s, thresholds) for s in shorter])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    w[0] += np.log(odds)
    every = np.ones(len(y), dtype=bool)
    return ToxicityModel(dictionaries(pick(1, every), pick(0, every)), thresholds, mean.tolist(), scale.tolist(), w.tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Fit on labelled documents: at most ``max_per_class`` of each class, of MAX_FIT_BYTES bytes each at most.

    The sample is chosen by a hash of the ids from ``labels`` (doc_id, toxic) alone; only these
    few ids are sent to the scan of ``docs`` (doc_id, text), which so needs no shuffle. Ids and
    texts that reach the driver are bounded by the two limits. Null ids, labels and texts are
    left out; of a repeated label the highest counts; without rows of both classes every text
    scores the labelled rows' share of toxic ones (0 without any).
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    # Each task keeps its first rows only, so no class meets in one task.
    first = lambda label: marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
    chosen = first(0).union(first(1))
    found = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_FIT_BYTES))
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * max_per_class)
        .select("text", "toxic").collect()
    )
    texts, y = [r["text"] for r in found], [r["toxic"] for r in found]
    if min(y.count(0), y.count(1)) < FOLDS:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return ToxicityModel((b"", b""), [0.0] * len(QUANTILES), [0.0] * N_FEATURES, [1.0] * N_FEATURES, [float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))] + [0.0] * N_FEATURES)
    odds = (totals[1] / y.count(1)) / (totals[0] / y.count(0))
    return calibrate(texts, y, odds)


def toxicity_score(text: Column | str, model: ToxicityModel) -> Column:
    """Probability of the toxic label for each whole text; null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch))

    return score(text)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each of ``docs`` (doc_id, text).

    Labels are learnt only from rows that are not held out (CRC-32 of the id as text, modulo 5,
    not 0). Only the text enters the score. Scoring is row by row, without a shuffle.

    Cases: null and empty texts get the score of no windows; a null doc_id is kept (and held
    out); repeated rows each get a row; an empty table gives none; other columns are not read.
    """
    model = fit_toxicity(docs, labels.where(~is_held_out()), max_per_class)
    scored = docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
