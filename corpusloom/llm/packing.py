"""Packing token streams into fixed windows by dynamic programming over document and sentence ends."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import byte_bpe_ids, encoder

END_OF_DOCUMENT = 1
#: Tokens after which the windows found so far are given out; bounds a task's memory (a longer document is held whole).
BLOCK_TOKENS = 1 << 18
#: Costs of a cut, in tokens of padding: at a sentence's end, and inside a sentence longer than MAX_SENTENCE.
SENTENCE_PENALTY, INSIDE_PENALTY, MAX_SENTENCE = 4.0, 24.0, 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@cache
def sentence_enders(vocabulary: str) -> np.ndarray:
    """For each token id, whether its bytes, without closing quotes and spaces, end a sentence or a line."""
    enc = encoder(vocabulary)
    ends = np.zeros(enc.n_vocab + 1, dtype=bool)
    for i in set(range(enc.n_vocab)) - set(map(enc.encode_single_token, enc.special_tokens_set)):
        data = enc.decode_single_token_bytes(i)
        ends[i] = data.endswith(b"\n") or data.rstrip(b" \"')]").endswith((b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode()))
    ends[END_OF_DOCUMENT] = False
    return ends


def window_cuts(ends: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indices into ``ends`` of the cheapest cuts; the last end is always one.

    ``ends`` are the allowed cuts, ascending, none more than ``window`` apart. A window from cut i
    to cut j costs its padding, window - (ends[j] - ends[i]), plus penalties[j]. As the cost is
    f(i) + ends[i] up to terms of j alone, the best i of all that are near enough is the head of
    a queue that is kept monotone: linear time.
    """
    cost, places = [0.0], [0, *ends.tolist()]
    came = [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j, (end, penalty) in enumerate(zip(places[1:], penalties.tolist(), strict=True), 1):
        while end - places[queue[0][1]] > window:
            queue.popleft()
        value, i = queue[0]
        came[j] = i
        here = value + penalty + window  # cost + end: what a later window that starts here adds to
        cost.append(here - end)
        while queue and queue[-1][0] >= here:
            queue.pop()
        queue.append((here, j))
    path, j = [], len(places) - 1
    while j:
        path.append(j - 1)
        j = came[j]
    return path[::-1]


class _Stream:
    """Documents of one partition, in order; holds those that are not yet packed."""

    def __init__(self, vocabulary: str, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.enders = sentence_enders(vocabulary)
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # id, tokens, tokens given out before, tokens in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)

    def _candidates(self, tokens: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sentence = np.flatnonzero(self.enders[tokens]) + 1
        natural = np.union1d(sentence, doc_ends)
        starts = np.concatenate(([0], natural[:-1]))
        step = min(MAX_SENTENCE, self.window)
        long = np.flatnonzero(natural - starts > step)
        inside = [np.arange(starts[k] + step, natural[k], step) for k in long]
        ends = np.union1d(natural, np.concatenate(inside)) if inside else natural
        penalties = np.full(len(ends), INSIDE_PENALTY)
        penalties[np.searchsorted(ends, sentence)] = SENTENCE_PENALTY
        penalties[np.searchsorted(ends, doc_ends)] = 0.0
        return ends, penalties

    def pack(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all windows found; unless ``last``, the final two windows stay for the next block."""
        if not self.docs:
            return None
        tokens = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        ends, penalties = self._candidates(tokens, doc_ends)
        cuts = ends[window_cuts(ends, penalties, self.window)]
        if not last:
            cuts = cuts[:-2]
            if not len(cuts):
                return None
        done = int(cuts[-1])
        doc_starts = np.concatenate(([0], doc_ends[:-1]))
        cut_starts = np.concatenate(([0], cuts[:-1]))
        starts = np.union1d(doc_starts[doc_starts < done], cut_starts)
        stops = np.concatenate((starts[1:], [done]))
        doc = np.searchsorted(doc_starts, starts, "right") - 1
        seq = np.searchsorted(cut_starts, starts, "right") - 1
        before = np.array([d[2] for d in self.docs])
        data = tokens[:done].astype("<u4").tobytes()
        offsets = (np.concatenate((starts, [done])) * 4).astype(np.int32)
        columns = {
            "doc_id": pa.array([self.docs[k][0] for k in doc], pa.int64()),
            "start": pa.array(starts - doc_starts[doc] + before[doc], pa.int64()),
            "length": pa.array(stops - starts, pa.int64()),
            "ids": pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]),
            "doc_tokens": pa.array(np.array([d[3] for d in self.docs])[doc], pa.int64()),
            "sequence_id": pa.array(seq + self.sequence, pa.int64()),
            "offset": pa.array(starts - cut_starts[seq], pa.int64()),
        }
        self.sequence += len(cuts)
        keep = int(np.searchsorted(doc_ends, done, "right"))
        rest = self.docs[keep:]
        if rest:
            used = done - int(doc_starts[keep])
            doc_id, ids, given, total = rest[0]
            rest[0] = (doc_id, ids[used:], given + used, total)
        self.docs, self.held = rest, len(tokens) - done
        return pa.RecordBatch.from_pydict(columns)


def pack_documents(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``window`` tokens, order kept.

    Each document is its tokens, added tokens such as <|endoftext|> found in the text among them,
    then END_OF_DOCUMENT. The documents of a partition, in their order, are one stream; ``window_cuts`` chooses where it is cut, at the ends of documents
    (free) or sentences (a small penalty), so that padding plus penalties is least. Only in a
    stretch of more than MAX_SENTENCE tokens without such an end may a cut lie inside, at a high
    penalty. Returned are the pieces: doc_id, start (tokens of the document before it), length,
    ids (little-endian unsigned 32-bit, as binary), doc_tokens, sequence_id and offset in the
    sequence. The stream is packed in blocks of about BLOCK_TOKENS tokens, so that a task's memory
    is bounded: cuts are the cheapest of each block, the window that a block leaves part-filled
    being taken on by the next. A sequence id is the partition's number, then a running number, so a task that
    runs again gives the same ids. Nothing is shuffled; a partition ends with one part-filled
    sequence.

    Cases: null and empty texts are END_OF_DOCUMENT alone; a null doc_id stays null; repeated
    rows are packed one by one; a text of any length is cut into as many windows as it needs;
    an empty table gives no rows; other columns are not read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(vocabulary, window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = byte_bpe_ids(text.as_py() or "", vocabulary)
                stream.add(doc_id, np.append(ids, np.uint32(END_OF_DOCUMENT)))
                if stream.held >= BLOCK_TOKENS and (out := stream.pack(last=False)) is not None:
                    yield out
        if (out := stream.pack(last=True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, PIECES)
