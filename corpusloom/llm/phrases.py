"""Phrases of words that occur together, counted by bitmaps of word positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER, written

#: Words whose positions share one set of bitmaps, words coded at a time, and bitmap words extended at a time; they bound a task's memory.
CHUNK_WORDS, CODED, BATCH = 1 << 21, 1 << 17, 1 << 17
#: Bytes of a text that are split into words at a time, up to the end of a piece.
PART_BYTES = 1 << 20
#: Positions of a bitmap's word: few, so that a block has few other words to be compared with.
WIDTH = 16

#: A-Z in lower case, a tab as a space, and every separator of pieces as a line feed; all other bytes stay.
FOLD = bytes.maketrans(f"{UPPER}\t.,;:!?\n\x0b\x0c\r".encode(), f"{LOWER} ".encode() + b"\n" * 10)
WORDS = re.compile(rb"\n|[^ \n]+")

CHUNKS = "chunk long, lang string, words array<string>, counts array<long>, codes binary"


def _parts(text: str) -> Iterator[bytes]:
    data, at = text.encode().translate(FOLD), 0
    while at < len(data):
        stop = data.find(b"\n", at + PART_BYTES)
        stop = len(data) if stop < 0 else stop + 1
        yield data[at:stop]
        at = stop


class _Positions:
    """Words of one language by position: each as its place among the distinct ones, or -1 between pieces."""

    def __init__(self):
        self.places: dict[bytes, int] = {b"\n": -1}
        self.codes: list[np.ndarray] = []
        self.pending: list[bytes] = []
        self.coded = 0

    def __len__(self) -> int:
        return self.coded + len(self.pending)

    def add(self, words: list[bytes]) -> None:
        self.pending += words
        self.pending.append(b"\n")
        if len(self.pending) >= CODED:
            self.code()

    def code(self) -> None:
        found = pa.array(self.pending, pa.binary()).dictionary_encode()
        places = np.array([self.places.setdefault(w, len(self.places) - 1) for w in found.dictionary.to_pylist()], dtype="<i4")
        self.codes.append(places[found.indices.to_numpy()])
        self.coded, self.pending = len(self), []

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        if self.pending:
            self.code()
        codes = np.concatenate(self.codes)
        words = [w.decode() for w in self.places if w != b"\n"]
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        return pa.RecordBatch.from_pydict({"chunk": [number], "lang": [lang], "words": pa.array([words], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int64())), "codes": [codes.tobytes()]})


def position_chunks(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (lang, text) by position, in chunks of about CHUNK_WORDS words of one language."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for part in _parts(text.as_py() or ""):
                    own = held.setdefault(lang, _Positions())
                    own.add(WORDS.findall(part))
                    full = lang if len(own) >= CHUNK_WORDS else None
                    if full is None and len(held) > 2 and sum(map(len, held.values())) >= 2 * CHUNK_WORDS:
                        full = max(held, key=lambda k: len(held[k]))
                    if full is not None:
                        yield held.pop(full).row(number, full)
                        number += 1
        for lang, own in held.items():
            yield own.row(number, lang)
            number += 1

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(chunks, CHUNKS)


class Bitmaps:
    """Positions of words as bitmaps of WIDTH positions a block, of which only those with a bit set are kept, by block."""

    def __init__(self, codes: np.ndarray, n_words: int):
        at = np.flatnonzero(codes >= 0)
        key = at // WIDTH * n_words + codes[at]
        order = np.argsort(key, kind="stable")
        key, bits = key[order], np.left_shift(np.uint16(1), (at[order] % WIDTH).astype(np.uint16))
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.bits = np.bitwise_or.reduceat(bits, heads) if len(heads) else bits
        block, word = np.divmod(key[heads], n_words) if n_words else (heads, heads)
        self.block, self.word = block.astype(np.int32), word.astype(np.int32)
        blocks = len(codes) // WIDTH + 2
        self.starts = np.searchsorted(self.block, np.arange(blocks + 1)).astype(np.int32)

    def first(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, bits) of all words, a batch of words at a time."""
        order = np.argsort(self.word, kind="stable")
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            yield self.word[own], self.block[own], self.bits[own]

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases one word longer, as (phrase, word, block, bits): shifted by one position, then AND with each word of the block."""
        over = bits >> np.uint16(WIDTH - 1)
        carried = over > 0
        phrase, block = np.concatenate((phrase, phrase[carried])), np.concatenate((block, block[carried] + np.int32(1)))
        bits = np.concatenate((bits << np.uint16(1), over[carried]))
        n = self.starts[block + 1] - self.starts[block]
        own = np.repeat(np.arange(len(n), dtype=np.int32), n)
        other = np.arange(len(own), dtype=np.int32) + np.repeat((self.starts[block] - (np.cumsum(n) - n)).astype(np.int32), n)
        both = bits[own] & self.bits[other]
        held = np.flatnonzero(both)
        own, other = own[held], other[held]
        return phrase[own], self.word[other], block[own], both[held]


class _Known:
    """Rows of word codes, sorted, looked up a word at a time: a phrase of d words has the number of its row."""

    def __init__(self, rows: np.ndarray, n_words: int):
        self.n_words, self.keys = n_words, []
        number = rows[:, 0]
        for d in range(1, rows.shape[1]):
            keys = np.unique(number * n_words + rows[:, d])
            number = np.searchsorted(keys, number * n_words + rows[:, d])
            self.keys.append(keys)

    def number(self, d: int, phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Number of each phrase (by its number among those of ``d`` words) and word among those of ``d + 1``; -1 if not known, also for a phrase of -1."""
        keys, key = self.keys[d - 1], phrase.astype(np.int64) * self.n_words + word
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else np.zeros(len(key), np.int64)
        return np.where(keys[at] == key, at, -1) if len(keys) else np.full(len(key), -1)

    def words(self, d: int, phrase: np.ndarray) -> list[np.ndarray]:
        """Word codes of phrases of ``d`` words, first to last."""
        out = []
        for keys in reversed(self.keys[: d - 1]):
            phrase, word = np.divmod(keys[phrase], self.n_words)
            out.append(word)
        return [phrase, *reversed(out)]


def runs_of(codes: np.ndarray, n_words: int, frequent: np.ndarray) -> np.ndarray:
    """The parts of ``codes`` in which all phrases as long as those in ``frequent`` are there, -1 after each; parts of just one phrase are left out.

    ``frequent`` has a row of word codes for each phrase, all of one length d. So the phrases of d + 1 words in the
    result are those of ``codes`` whose first and last d words both are frequent, as often as there. Each batch of
    first words is extended to the full length before the next.
    """
    length = frequent.shape[1]
    kept = np.zeros(n_words + 1, bool)
    kept[frequent.ravel()] = True
    maps = Bitmaps(np.where(kept[codes], codes, -1), n_words)
    known = _Known(frequent, n_words)
    ends = np.zeros(len(codes) // WIDTH + 2, "<u2")
    for phrase, block, bits in maps.first():
        for d in range(1, length):
            phrase, word, block, bits = maps.extended(phrase, block, bits)
            phrase = known.number(d, phrase, word)
            phrase, block, bits = phrase[phrase >= 0], block[phrase >= 0], bits[phrase >= 0]
        np.bitwise_or.at(ends, block, bits)
    last = np.unpackbits(ends.view(np.uint8), bitorder="little")[: len(codes)].astype(bool)
    # Two such phrases that end at neighbouring positions make one of a word more; a run goes on as long as they do.
    edges = np.flatnonzero(np.diff(np.concatenate(([0], last[1:] & last[:-1], [0]))))
    starts, n = edges[::2] + 1 - length, edges[1::2] - edges[::2] + length
    at = np.arange(int((n + 1).sum())) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    return np.where(at < np.repeat(n, n + 1), codes[np.minimum(at + np.repeat(starts, n + 1), len(codes) - 1)], -1) if len(n) else np.empty(0, codes.dtype)


def phrases_within(codes: np.ndarray, n_words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All phrases of ``length`` words in ``codes``: (rows of codes, counts)."""
    maps = Bitmaps(codes, n_words)
    found, counts = [np.empty((0, length), np.int64)], [np.empty(0, np.int64)]
    for phrase, block, bits in maps.first():
        columns = [np.arange(n_words)]
        for _ in range(1, length):
            phrase, word, block, bits = maps.extended(phrase, block, bits)
            phrase, distinct = pd.factorize(phrase.astype(np.int64) * n_words + word)
            before, word = np.divmod(distinct, n_words)
            columns = [*(c[before] for c in columns), word]
        counts.append(np.bincount(phrase, weights=np.bitwise_count(bits), minlength=len(columns[0])).astype(np.int64))
        found.append(np.stack(columns, axis=1))
    return _summed(np.concatenate(found), np.concatenate(counts))


def longer_phrases(codes: np.ndarray, n_words: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases one word longer than those in ``frequent`` whose first and last part both are there: (rows of codes, counts)."""
    return phrases_within(runs_of(codes, n_words, frequent), n_words, frequent.shape[1] + 1)


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with the sum of their counts: a word's positions can lie in two batches."""
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    if not len(rows):
        return rows, counts
    heads = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    return rows[heads], np.add.reduceat(counts, heads)


def _packed(rows: np.ndarray) -> list[np.ndarray]:
    """Word ids, two to a long: the id plus one, 0 where there is none."""
    filled = np.concatenate((rows + 1, np.zeros((len(rows), rows.shape[1] % 2), np.int64)), axis=1)
    return [(filled[:, d] << 32) | filled[:, d + 1] for d in range(0, filled.shape[1], 2)]


def _unpacked(keys: list[np.ndarray], length: int) -> np.ndarray:
    return np.stack([(key >> 32 if d == 0 else key & 0xFFFFFFFF) - 1 for key in keys for d in (0, 1)][:length], axis=1)


def _key_columns(length: int) -> list[str]:
    return [f"k{j}" for j in range((length + 1) // 2)]


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids as codes without gaps, -1 where there is none, and the id of each code."""
    codes, own = pd.factorize(np.where(ids < 0, -1, ids).astype(np.int64))
    if (gap := np.flatnonzero(own < 0)).size:  # the code of -1 is the last one's from now on
        codes = np.where(codes == gap[0], -1, np.where(codes == len(own) - 1, gap[0], codes))
        own[gap[0]] = own[-1]
        own = own[:-1]
    return codes, own


def _positions(chunk: pa.Table) -> np.ndarray:
    """The word ids of a chunk, of one or more rows."""
    return np.frombuffer(b"".join(chunk.column("ids").to_pylist()), "<i4")


def _counted(length: int):
    """(chunk, key columns, n): the phrases of ``length`` words of one chunk."""

    def counted(chunk: pa.Table) -> pa.Table:
        codes, own = _numbered(_positions(chunk))
        rows, counts = phrases_within(codes, len(own), length)
        return pa.table({"chunk": pa.array(np.full(len(counts), chunk.column("chunk")[0].as_py()), pa.int64())} | dict(zip(_key_columns(length), _packed(own[rows]), strict=True)) | {"n": counts})

    return counted


def _runs(length: int):
    """(chunk, size, ids): what ``runs_of`` leaves of one chunk, beside the rows of its frequent phrases of ``length`` words."""

    def left(chunk: pa.Table, frequent: pa.Table) -> pa.Table:
        runs = np.empty(0, "<i4")
        if len(chunk) and len(frequent):
            codes, own = _numbered(_positions(chunk))
            order = np.argsort(own)
            rows = _unpacked([frequent.column(k).to_numpy() for k in _key_columns(length)], length)
            codes = runs_of(codes, len(own), order[np.searchsorted(own, rows, sorter=order)])
            runs = np.where(codes < 0, -1, own[codes]).astype("<i4")
        n = min(len(runs), 1)
        return pa.table({"chunk": pa.array(chunk.column("chunk").to_pylist()[:n], pa.int64()), "size": pa.array([len(runs)][:n], pa.int64()), "ids": pa.array([runs.tobytes()][:n], pa.binary())})

    return left


def _gathered(left: DataFrame, langs: DataFrame) -> DataFrame:
    """What is left of the chunks (chunk, ids), those of one language together up to about CHUNK_WORDS words, as one chunk of several rows.

    A phrase has a row in each chunk that it is in, so the fewer, the better they are summed. The chunk has the number of one of those in it.
    """
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("chunk")) - F.col("size")
    dealt = left.select("chunk", "size").join(langs, "chunk").withColumn("part", F.floor(before / CHUNK_WORDS))
    named = dealt.select("chunk", F.min("chunk").over(Window.partitionBy("lang", "part")).alias("into"))
    return left.join(F.broadcast(named), "chunk").select(F.col("into").alias("chunk"), "ids")


def _level(rows: DataFrame, least: int, length: int) -> DataFrame:
    """Rows of frequent phrases (chunk, key columns, f, first): each chunk that has one; ``first`` marks one of them.

    A phrase has one row a chunk, so its rows are few; one shuffle gives their sum, and which are frequent.
    """
    w = Window.partitionBy(*_key_columns(length))
    summed = rows.withColumns({"f": F.sum("n").over(w), "first": F.min("chunk").over(w) == F.col("chunk")})
    return written(summed.where(F.col("f") >= least).drop("n"), f"phrases-{length}")


def _phrase_ids(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, id, f), frequent phrases (lang, p: array of ids, f) of one word and more, and words in all (lang, n)."""
    chunks = written(position_chunks(docs), "phrase-chunks")
    exploded = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    own = exploded.select("chunk", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda total, n: total + n).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    sums = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    placed = written(sums.withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    # Ids without gaps: one row a partition, whose words come after those of the partitions before.
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    words = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part").select("lang", "word", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"), "f")
    words = written(words, "phrase-ids")

    def as_ids(chunk: pa.Table, known: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table({"chunk": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        codes = np.frombuffer(chunk.column("codes")[0].as_py(), "<i4")
        ids = np.full(len(codes) + 2, -1, "<i4")  # more than there are codes; the last stays for -1
        ids[known.column("place").to_numpy()] = known.column("id").to_numpy()
        return pa.table({"chunk": pa.array([chunk.column("chunk")[0].as_py()], pa.int64()), "ids": pa.array([ids[codes].tobytes()], pa.binary())})

    known = own.select(F.col("chunk").alias("of_chunk"), "lang", "place", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("of_chunk", "place", "id")
    ids = written(chunks.select("chunk", "codes").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(as_ids, "chunk long, ids binary"), "phrase-positions")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counted(2)
        for batch in batches:
            for at in range(len(batch)):
                yield from counted(pa.Table.from_batches([batch.slice(at, 1)])).to_batches()

    langs = chunks.select("chunk", "lang")
    levels, positions, found = [], ids, ids.mapInArrow(pairs, "chunk long, k0 long, n long")
    for length in range(2, longest + 1):
        if length > 2:
            frequent = levels[-1].select(F.col("chunk").alias("of_chunk"), *_key_columns(length - 1))
            left = positions.groupBy("chunk").cogroup(frequent.groupBy("of_chunk")).applyInArrow(_runs(length - 1), "chunk long, size long, ids binary")
            left = written(left, f"phrase-runs-{length}")
            # Pairs leave much of the words, so as many tasks go on; after three words little is left.
            positions = _gathered(left, langs) if length > 3 else left.select("chunk", "ids")
            schema = "chunk long, " + ", ".join(f"{k} long" for k in _key_columns(length)) + ", n long"
            found = positions.groupBy("chunk").applyInArrow(_counted(length), schema)
        levels.append(_level(found, least, length))
    phrases = words.select("lang", F.array("id").alias("p"), "f")
    for length, level in enumerate(levels, 2):
        halves = [half for k in _key_columns(length) for half in (F.shiftright(k, 32) - 1, F.col(k).bitwiseAND(0xFFFFFFFF) - 1)]
        phrases = phrases.unionByName(level.where("first").select("chunk", F.array(*halves[:length]).alias("p"), "f").join(langs, "chunk").select("lang", "p", "f"))
    return words, written(phrases, "phrases"), totals


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with the words of the ids in ``p``, joined by spaces, as ``phrase``."""
    others = [c for c in phrases.columns if c != "p"]
    parts = phrases.select(*others, "p", F.posexplode("p").alias("place", "id")).join(words.select("id", "word"), "id")
    gathered = parts.groupBy(*others, "p").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts"))
    return gathered.select(*others, F.array_join(F.col("parts.word"), " ").alias("phrase"))


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, phrase, n_words, f) of all phrases of up to ``longest`` words with f >= ``least``, and words in all by lang (lang, n).

    Phrases lie within a piece. Every chunk of positions counts its phrases of d words by bitmaps;
    the chunks' sums are then summed by phrase. Before d grows, a chunk keeps only the runs of
    words whose phrases of d words all are frequent in the whole corpus (a phrase is no more
    frequent than its parts), and what is left of several chunks is put together. Between the steps a
    frequent word is its id, of less than 2^31.
    """
    words, phrases, totals = _phrase_ids(docs, least, longest)
    return _spelled(phrases.withColumn("n_words", F.size("p")), words).select("lang", "phrase", "n_words", "f"), totals


def _inner(least: int) -> str:
    """SQL for all parts of ``least`` words or more of the array ``p``, itself left out."""
    return f"flatten(transform(sequence({least}, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))"


def mine_phrases(docs: DataFrame, least: int = 30, longest: int = 4, covered: tuple[int, int] = (80, 100), top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases by how well their words hold together: (lang, rank, phrase, a, l, r, n, score).

    Candidates are phrases of 2 to ``longest`` words with a = f(phrase) >= ``least``. Cut after
    k words, l and r are the counts of the parts; score is floor(2000000 * a / (l + r)) at the
    cut where that is least, ties at the smallest k. A candidate that lies inside a longer one
    with f(longer) / a of at least ``covered`` goes. n counts all words of the language. Order: score descending, a
    descending, phrase in byte order. Products are decimals of 38 digits, so exact for any long count.

    Cases: a null lang is ``und``; null and empty texts have no words; repeated rows count each; very long texts are
    split at ends of pieces; an empty table gives no rows; other columns are not read.
    """
    words, counts, totals = _phrase_ids(docs, least, longest)
    candidates = counts.where(F.size("p") > 1).withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    parts = cuts.select("lang", "p", "a", "k", F.expr("slice(p, 1, k)").alias("head"), F.expr("slice(p, k + 1, size(p))").alias("tail"))
    heads, tails = counts.select(F.col("p").alias("head"), F.col("f").alias("l")), counts.select(F.col("p").alias("tail"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = parts.join(heads, "head").join(tails, "tail").withColumn("score", score)
    lowest = scored.groupBy("lang", "p").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    inside = candidates.where(F.size("p") > 2).select(F.explode(F.expr(_inner(2))).alias("p"), F.col("a").alias("longer"))
    longer = inside.groupBy("p").agg(F.max("longer").alias("longer"))
    part, whole = (F.lit(x).cast("decimal(18,0)") for x in covered)
    within = longer.join(candidates.select("p", "a"), "p").where(whole * F.col("longer").cast("decimal(19,0)") >= part * F.col("a").cast("decimal(19,0)")).select("p")
    kept = lowest.join(within, "p", "left_anti").select("lang", "p", "cut.a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc()]
    # A language may hold most of the phrases: its first ones are found in 64 parts, then among those of all parts. Ties stay until their words are known.
    parted = kept.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(64)))
    near = parted.withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("place") <= top).drop("part", "place")
    nearer = near.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("place") <= top).drop("place")
    ranked = _spelled(nearer, words).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
