"""Aligning the tokens of two tokenizers by the bytes that they cover, and counting the linked pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.llm.tokens import Spelling, by_name

#: Bytes of text whose links are found in one go, and whose documents share one list of pairs; they bound a task's memory.
SEGMENT_BYTES, CHUNK_BYTES = 1 << 21, 1 << 22

LINKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, keys array<long>, sums array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_SCHEMA = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in RESULT.split(", "))])


def components(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Union-find over a bipartite graph with edges (left, right): the least node of each node's component, left nodes first.

    Every round hooks the greater root of each open edge under the least root it meets, then
    halves all paths until they end at roots; edges whose ends agree are done.
    """
    parent = np.arange(n_left + n_right, dtype=np.int32)
    u, v = left, right + np.int32(n_left)
    while len(u):
        a, b = parent[u], parent[v]
        if not (apart := a != b).any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while ((up := parent[parent]) != parent).any():
            parent = up
    return parent


class Aligned:
    """Links and groups of two rows of tokens that spell the same bytes."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.ids_a, self.ids_b = ids_a, ids_b
        ends_a, ends_b = np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b])
        marks = np.zeros(int(ends_a[-1]) + 1, dtype=np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        marks = marks[marks > 0]
        ends = (marks & 1).astype(np.int32), (marks >> 1).astype(np.int32)
        # Between two neighbouring ends lies one token of either row: these are the overlapping pairs, each once.
        self.link_a, self.link_b = (np.cumsum(e, dtype=np.int32) - e for e in ends)
        root = components(self.link_a, self.link_b, len(ids_a), len(ids_b))
        self.first = root[: len(ids_a)] == np.arange(len(ids_a), dtype=np.int32)
        self.group_a = np.cumsum(self.first, dtype=np.int32) - 1
        self.group_b = self.group_a[root[len(ids_a) :]]

    def described(self, decimals: Spelling) -> tuple[np.ndarray, np.ndarray]:
        """All groups as ``a1,a2|b1;a3|b2,b3;``: bytes, and where each token's part ends, tokens by group, A before B."""
        n_a, n_b, groups = len(self.ids_a), len(self.ids_b), int(self.group_a[-1]) + 1
        through_a = np.cumsum(np.bincount(self.group_a, minlength=groups))
        through_b = np.cumsum(np.bincount(self.group_b, minlength=groups))
        before_b = np.concatenate(([0], through_b[:-1]))
        ids = np.empty(n_a + n_b, dtype=np.uint32)
        ids[np.arange(n_a) + before_b[self.group_a]] = self.ids_a
        ids[np.arange(n_b) + through_a[self.group_b]] = self.ids_b
        data, ends = decimals.spelled(ids)
        data[ends[through_a + before_b - 1] - 1] = ord("|")
        data[ends[through_a + through_b - 1] - 1] = ord(";")
        return data, ends


def _cuts(ends_a: np.ndarray, ends_b: np.ndarray, step: int) -> np.ndarray:
    """Byte offsets, about ``step`` apart, where both rows have an end; the last is the end of all."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.unique(np.concatenate((common[np.searchsorted(common, np.arange(step, common[-1], step))], common[-1:])))


class _Document:
    """What is known of one document so far."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.n_a, self.n_b, self.n_groups, self.n_links = doc_id, 0, 0, 0, 0
        self.digest = None
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, n_a: int, n_b: int, n_groups: int, groups: memoryview, keys: np.ndarray, times: np.ndarray) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(groups)
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        self.n_links += int(times.sum())
        self.keys.append(keys)
        self.times.append(times)


class _Aligner:
    """Documents of one partition, in chunks: segments are aligned as they fill, pairs get places when a chunk ends."""

    def __init__(self, vocabulary_a: str, vocabulary_b: str, first_chunk: int):
        self.a, self.b = by_name(vocabulary_a), by_name(vocabulary_b)
        self.decimals = Spelling([b"%d," % i for i in range(max(len(self.a.spelling), len(self.b.spelling)))])
        self.chunk = first_chunk
        self.docs: list[_Document] = []
        self.held = 0
        self.segment: list[tuple[_Document, bytes, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, doc_id: int | None, text: str) -> None:
        doc = _Document(doc_id)
        self.docs.append(doc)
        self.held += len(text)
        if not text:
            return
        data = b" " + text.encode()
        ids_a, ids_b = self.a.ids(" " + text), self.b.ids(text)
        lengths_a, lengths_b = self.a.spelling.lengths, self.b.spelling.lengths
        if int(lengths_a[ids_a].sum()) != len(data) or int(lengths_b[ids_b].sum()) != len(data):
            return
        if len(data) <= SEGMENT_BYTES:
            self.segment.append((doc, data, ids_a, ids_b))
            self.pending += len(data)
            if self.pending >= SEGMENT_BYTES:
                self.flush()
            return
        if not (np.array_equal(self._bytes(self.a, ids_a), np.frombuffer(data, np.uint8)) and np.array_equal(self._bytes(self.b, ids_b), np.frombuffer(data, np.uint8))):
            return
        ends_a, ends_b = np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b])
        from_a = from_b = 0
        for cut in _cuts(ends_a, ends_b, SEGMENT_BYTES).tolist():
            to_a, to_b = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            self._align([doc], [ids_a[from_a:to_a]], [ids_b[from_b:to_b]])
            from_a, from_b = to_a, to_b

    @staticmethod
    def _bytes(tokenizer, ids: np.ndarray) -> np.ndarray:
        return tokenizer.spelling.spelled(ids)[0]

    def flush(self) -> None:
        """Align the segment's documents; those whose tokens don't spell their bytes have none."""
        if not self.segment:
            return
        docs, data, ids_a, ids_b = (list(part) for part in zip(*self.segment, strict=True))
        self.segment, self.pending = [], 0
        whole = np.frombuffer(b"".join(data), np.uint8)
        wrong = (self._bytes(self.a, np.concatenate(ids_a)) != whole) | (self._bytes(self.b, np.concatenate(ids_b)) != whole)
        if wrong.any():
            starts = np.cumsum([0, *map(len, data)])[:-1]
            right = np.flatnonzero(~np.logical_or.reduceat(wrong, starts)).tolist()
            docs, ids_a, ids_b = ([part[i] for i in right] for part in (docs, ids_a, ids_b))
        if docs:
            self._align(docs, ids_a, ids_b)

    def _align(self, docs: list[_Document], ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> None:
        both = Aligned(np.concatenate(ids_a), np.concatenate(ids_b), self.a.spelling.lengths, self.b.spelling.lengths)
        stops_a, stops_b = np.cumsum(list(map(len, ids_a))), np.cumsum(list(map(len, ids_b)))
        starts_a = np.concatenate(([0], stops_a[:-1]))
        n_groups = np.add.reduceat(both.first.astype(np.int64), starts_a).tolist()
        data, ends = both.described(self.decimals)
        group_stops = ends[stops_a + stops_b - 1].tolist()
        starts = np.searchsorted(both.link_a, starts_a)
        n_links = np.diff(np.concatenate((starts, [len(both.link_a)])))
        pairs = both.ids_a[both.link_a].astype(np.int64) * len(self.b.spelling) + both.ids_b[both.link_b]
        codes, distinct = pd.factorize(pairs)
        own, of_docs = pd.factorize(np.repeat(np.arange(len(docs)), n_links) * len(distinct) + codes)
        times = np.bincount(own)
        owner, keys = of_docs // len(distinct), distinct[of_docs % len(distinct)]
        bounds = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        view, at = memoryview(data), 0
        for i, (doc, a, b) in enumerate(zip(docs, ids_a, ids_b, strict=True)):
            doc.add(len(a), len(b), n_groups[i], view[at : group_stops[i] - 1], keys[bounds[i] : bounds[i + 1]], times[bounds[i] : bounds[i + 1]])
            at = group_stops[i]

    def rows(self) -> pa.RecordBatch:
        """The chunk's documents, their pairs as places in the chunk's list, then that list with its sums."""
        self.flush()
        spans = [sum(map(len, d.keys)) for d in self.docs]
        none = np.empty(0, np.int64)
        keys, times = np.concatenate([none, *(k for d in self.docs for k in d.keys)]), np.concatenate([none, *(t for d in self.docs for t in d.times)])
        places, distinct = pd.factorize(keys)
        sums = np.bincount(places, weights=times, minlength=len(distinct)).astype(np.int64)
        offsets = pa.py_buffer((np.cumsum([0, *spans, 0]) * 4).astype(np.int32).tobytes())
        binary = lambda values: pa.Array.from_buffers(pa.binary(), len(self.docs) + 1, [None, offsets, pa.py_buffer(values.astype("<i4").tobytes())])
        listed = lambda values: pa.array([None] * len(self.docs) + [values], pa.list_(pa.int64()))
        out = pa.RecordBatch.from_pydict(
            {"chunk": pa.array([self.chunk] * (len(self.docs) + 1), pa.int64())}
            | {n: pa.array([getattr(d, n) for d in self.docs] + [None], pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            | {"groups_sha256": pa.array([d.digest.hexdigest() if d.digest else "" for d in self.docs] + [None], pa.string())}
            | {"places": binary(places), "times": binary(times), "keys": listed(distinct), "sums": listed(sums)}
        )
        self.chunk, self.docs, self.held = self.chunk + 1, [], 0
        return out


def align_tokens(docs: DataFrame, vocabulary_a: str = "byte_bpe_50k.tiktoken", vocabulary_b: str = "piece_bpe_32k.model") -> tuple[DataFrame, DataFrame]:
    """Groups and links between the tokens of two tokenizers: a row for each document, and the table of pairs.

    Tokenizer A, a byte-level BPE, encodes a space and the text; B, of sentence pieces, puts that space itself. Tokens of
    A and B are linked if they cover a common byte. The connected components of this bipartite graph, by union-find, are the smallest groups of tokens
    that cover the same bytes. A pair of ids counts as many links as the whole corpus has of it.

    Documents: (doc_id, n_a, n_b, n_groups, n_links, n_best: links whose pair has the highest
    count of its B id, count_sum: their counts' sum, groups_sha256: of ``a1,a2|b1;a3|b2,b3``). Pairs: (key = a * size of B + b, a, b, count, is_best).

    Documents are aligned in their partitions, in chunks of about CHUNK_BYTES of text. A chunk sends each of its
    distinct pairs once, so the commonest pair has as many rows as there are chunks; counts
    come back to the chunks in the same way, and meet the documents there.

    Cases: null and empty texts, and those that one tokenizer doesn't spell back to their bytes, have no tokens (zeros, and an
    empty digest); a null doc_id stays null; repeated rows each get their row and count each; a very
    long text is cut where both rows of tokens end; an empty table gives none; other columns are not read.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(vocabulary_a, vocabulary_b, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                aligner.add(doc_id, text.as_py() or "")
                if aligner.held >= CHUNK_BYTES:
                    yield aligner.rows()
        if aligner.docs:
            yield aligner.rows()

    n_b = len(by_name(vocabulary_b).spelling)
    links = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(linked, LINKS), "align-links")
    listed = links.where("keys is not null").select("chunk", F.posexplode(F.arrays_zip("keys", "sums")).alias("place", "pair"))
    sums = listed.select("chunk", "place", F.col("pair.keys").alias("key"), F.col("pair.sums").alias("n"))
    counts = written(sums.groupBy("key").agg(F.sum("n").alias("count")).withColumn("b", F.col("key") % n_b), "align-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    pairs = counts.join(highest, "b").select("key", F.expr(f"key div {n_b}").alias("a"), "b", "count", (F.col("count") == F.col("highest")).alias("is_best"))
    known = sums.select("chunk", "place", "key").join(pairs.select("key", "count", "is_best"), "key").select(F.col("chunk").alias("of_chunk"), "place", "count", "is_best")

    def looked_up(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("is_best").to_numpy()
        n_best, count_sum = [], []
        for places, times in zip(documents.column("places"), documents.column("times"), strict=True):
            places, times = np.frombuffer(places.as_py(), "<i4"), np.frombuffer(times.as_py(), "<i4").astype(np.int64)
            n_best.append(int(times[best[places]].sum()))
            count_sum.append(int((times * count[places]).sum()))
        found = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table({f.name: found.get(f.name) if f.name in found else documents.column(f.name) for f in RESULT_SCHEMA}, schema=RESULT_SCHEMA)

    rows = links.where("keys is null").drop("keys", "sums")
    return rows.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(looked_up, RESULT), pairs
