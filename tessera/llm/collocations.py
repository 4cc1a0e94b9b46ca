"""Phrase collocations per language: exact counts in the slots of minimal perfect hashes, scored by their weakest cut.

Texts (A-Z lower-cased, null: empty) fall into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`. n is
the number of words of a language (null: `und`, one with a language that is called so), f(phrase) the number of its
occurrences inside pieces, overlaps included. Candidates are phrases of 2 to 5 words with f >= 100.

Method. Level by level (Apriori): a phrase of k words can reach the threshold only if its first k - 1 and its last
k - 1 words do. What is frequent at a level gets a minimal perfect hash (`Slots`): keys fall into bit arrays, those
alone in their place stay, the others go on to the next array, and the rank of a key's bit is its slot. Each slot
keeps its key, so what was never put in is told apart: a word by its 64-bit name, length, first and last eight bytes
and language, a phrase by the slots of its first and its last k - 1 words (which is exact). A pass over the
corpus
1. nominates: pairs of neighbouring slots of the level below, which are the Apriori-safe phrases seen, summed by
   Spark; those that reach the threshold get slots;
2. counts: each task looks up its pairs, adds `numpy.bincount` of the slots to one array, and writes the slots as
   the sequence of the next level (what isn't frequent only parts runs). The arrays of all tasks are summed as a
   tree, in blocks of slots.
The counts of a phrase's two parts at any cut are then read by slot. Only counts of frequent words and phrases are in
these tables, and they are broadcast, so their size is checked: with more than `most` keys at a level the same result
comes from `counted_by_shuffle`, which groups and joins phrases as they are and broadcasts nothing. Tests hold both
against a brute-force version.

Scores are exact integers of any size: floor(1000 a n / (l r)), for the cut where that is least (ties: the earliest). A
candidate goes where a longer one holds it and is as frequent (100 f(longer) >= `covered` f); as f never grows with a
phrase, those longer by one word decide. The first `top` of each language are kept by score and a, descending, then by
phrase in the order of UTF-8 bytes.

Defined results: empty tables, and languages without candidates, give no rows. Rows that share a doc_id, or have
none, count like all others; copies count as often as they are there. Only text and lang are read, whatever other
columns there are. Control characters other than \\x09-\\x0D are parts of words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as H

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words
TOP = 2_000  # phrases reported of each language
COVERED = 100  # percent of a phrase's occurrences that a longer one must hold to replace it
MOST = 1 << 21  # keys of a level whose tables are broadcast: some 40 bytes each
FAN = 32  # arrays that meet in one step of the tree
BLOCK = 1 << 16  # slots of a block of counts
ROW = 2_048  # slots in a row of a sequence, more only where a run is longer
PIECE = 2 << 20  # bytes cut into words at once
LONG_WORD = 512  # bytes; longer words are named one by one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_PARTING = re.compile(rb"[ \t.,;:!?\n-\r]")
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SIGN = np.uint64(32)


# ---------------------------------------------------------------- minimal perfect hash


class Slots:
    """A minimal perfect hash of distinct uint64 keys to 0 .. n - 1; `keys` are in the order of their slots."""

    ROOM, ARRAYS = 1.6, 40

    def __init__(self, keys: np.ndarray):
        self.starts, self.sizes, bits, placed, rest = [], [], [], [], keys.astype(np.uint64)
        while len(rest) and len(self.sizes) < self.ARRAYS:
            size = max(64, int(len(rest) * self.ROOM))
            at = self._place(rest, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.starts.append(sum(self.sizes))
            self.sizes.append(size)
            bits.append(alone)
            inside = alone[at]
            placed.append(rest[inside][np.argsort(at[inside])])
            rest = rest[~inside]
        assert not len(rest), "keys are distinct"
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.ranks = (np.cumsum(self.bits) - 1).astype(np.int32)
        self.keys = np.concatenate(placed) if placed else np.zeros(0, np.uint64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = H.splitmix(keys ^ np.uint64(0xA0761D6478BD642F * (level + 1) % (1 << 64)))
        return (((h >> _SIGN) * np.uint64(size)) >> _SIGN).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that aren't stored."""
        out, live = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            if not len(live):
                break
            at = start + self._place(keys[live], level, size)
            hit = self.bits[at]
            slot = self.ranks[at[hit]]
            out[live[hit]] = np.where(self.keys[slot] == keys[live[hit]], slot, -1)
            live = live[~hit]
        return out


# ---------------------------------------------------------------- words


class Words:
    """Words of a stretch of texts: first, size, name, head and tail (their first and last eight bytes), and whether each begins a piece."""

    def __init__(self, data: np.ndarray, lo: int, hi: int, heads: np.ndarray, carry: bool):
        b = np.zeros(hi - lo + 8, np.uint8)
        np.take(_LOWER, data[lo:hi], out=b[:-8])
        kind = _KIND[b[:-8]]
        word = np.zeros(hi - lo + 2, bool)  # one further on, so that both ends have a neighbour
        np.equal(kind, _WORD, out=word[1:-1])
        cut = np.zeros(hi - lo + 1, bool)
        cut[heads[(heads > lo) & (heads < hi)] - lo] = True
        self.bytes, self.lo = b, lo
        self.first = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        self.size = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1 - self.first
        parted = np.cumsum((kind == _BREAK) | cut[:-1], dtype=np.int32)
        at = parted[self.first]
        self.new = np.ones(len(at), bool)
        self.new[1:] = at[1:] > at[:-1]
        if len(at):
            self.new[0] = carry or at[0] > 0
        #: Whether what follows this stretch begins a piece.
        self.carry = bool(parted[-1] > at[-1]) if len(at) else bool(carry or (len(parted) and parted[-1] > 0))
        eights = np.ndarray((hi - lo + 1,), "<u8", b, strides=(1,))
        self.head = eights[self.first] & _LOW_BYTES[np.minimum(self.size, 8)]
        self.tail = eights[self.first + np.maximum(self.size - 8, 0)] & _LOW_BYTES[np.minimum(self.size, 8)]
        name = H.splitmix(H.splitmix(self.head + self.size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ self.tail)
        live = np.flatnonzero((self.size > 16) & (self.size <= LONG_WORD))
        step = 8
        while len(live):  # the eights between head and tail
            name[live] = H.splitmix(name[live] ^ eights[self.first[live] + step])
            step += 8
            live = live[self.size[live] > step + 8]
        for i in np.flatnonzero(self.size > LONG_WORD):
            name[i] = xxhash.xxh3_64_intdigest(b[self.first[i] : self.first[i] + self.size[i]].tobytes())
        self.name = name

    def bytes_of(self, rows: np.ndarray) -> pa.Array:
        """The words at rows as strings."""
        size = self.size[rows]
        edge = np.concatenate(([0], np.cumsum(size)))
        raw = self.bytes[np.repeat(self.first[rows] - edge[:-1], size) + np.arange(edge[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())


def stretches(data: np.ndarray, edge: np.ndarray):
    """Words of the texts data[edge[i] : edge[i + 1]], some megabytes at a time; pieces go on where a long text is cut."""
    lo, carry = int(edge[0]), True
    while lo < edge[-1]:
        k = int(np.searchsorted(edge, lo + PIECE, side="right")) - 1
        hi = int(edge[k])
        if hi <= lo:  # one text that is longer: cut between words
            last, hi = int(edge[np.searchsorted(edge, lo, side="right")]), lo + PIECE
            while hi < last and _KIND[data[hi]] == _WORD:
                step = _PARTING.search(data[hi : hi + PIECE].tobytes())
                hi = min(last, hi + (step.start() if step else PIECE))
            hi = min(hi, last)
        w = Words(data, lo, hi, edge, carry)
        yield w
        lo = hi
        carry = w.carry or edge[np.searchsorted(edge, lo)] == lo


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(bytes, edges, code of the language of each text, languages) of a batch of (lang, text)."""
    text = batch.column(1).cast(pa.large_binary())
    edge = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lang = batch.column(0).dictionary_encode()
    return data, edge, lang.indices.to_numpy(), lang.dictionary


def _salts(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs.to_pylist()], np.uint64)


def _seen_words(batches):
    """(lang, word, n) of each stretch, once a word."""
    for batch in batches:
        data, edge, code, langs = _texts(batch)
        salt = _salts(langs)
        for w in stretches(data, edge):
            if not len(w.first):
                continue
            lang = code[np.searchsorted(edge, w.first + w.lo, side="right") - 1]
            key = H.splitmix(w.name ^ salt[lang])
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            if any((same & (x[order][1:] != x[order][:-1])).any() for x in (w.head, w.tail, w.size, lang)):  # two words of one name
                got = Counter(zip(lang.tolist(), w.bytes_of(np.arange(len(key))).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array([k for k, _ in got], pa.int32())), pa.array([x for _, x in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])
                continue
            begin = np.flatnonzero(np.concatenate(([True], ~same)))
            one = order[begin]
            n = np.diff(np.concatenate((begin, [len(key)])))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[one])), w.bytes_of(one), pa.array(n, pa.int64())], names=["lang", "word", "n"])


class WordSlots:
    """Slots of the frequent words of all languages, with what tells them from others."""

    def __init__(self, langs: list[str], words: list[str]):
        raw = [x.encode() for x in words]
        edge = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))).astype(np.int64)
        w = Words(np.frombuffer(b" ".join(raw) + b" ", np.uint8), 0, int(edge[-1]), edge, True)
        table = pa.array(langs, pa.string()).dictionary_encode()
        salt = _salts(table.dictionary)[table.indices.to_numpy()]
        key = H.splitmix(w.name ^ salt)
        self.slots = Slots(key)
        order = np.empty(len(key), np.int64)
        order[self.slots.find(key)] = np.arange(len(key))
        self.marks = [x[order] for x in (w.head, w.tail, w.size, salt)]
        self.words, self.langs = pa.array(words, pa.string()).take(pa.array(order)), pa.array(langs, pa.string()).take(pa.array(order))

    def __len__(self) -> int:
        return len(self.slots)

    def find(self, w: Words, salt: np.ndarray) -> np.ndarray:
        slot = self.slots.find(H.splitmix(w.name ^ salt))
        for mine, theirs in zip(self.marks, (w.head, w.tail, w.size, salt), strict=True):
            slot[mine[slot] != theirs] = -1
        return slot


# ---------------------------------------------------------------- sequences of slots


def _runs(ids: np.ndarray) -> np.ndarray:
    """Runs of two or more slots, one -1 behind each."""
    live = np.zeros(len(ids) + 2, bool)
    live[1:-1] = ids >= 0
    kept = live[1:-1] & (live[:-2] | live[2:])
    out = np.where(kept, ids, -1)
    return out[kept | np.concatenate(([False], kept[:-1]))]


def _rows(ids: np.ndarray):
    """Cut behind the first -1 after each ROW slots."""
    ends, lo = np.flatnonzero(ids < 0), 0
    while lo < len(ids):
        k = int(np.searchsorted(ends, lo + ROW))
        hi = int(ends[k]) + 1 if k < len(ends) else len(ids)
        yield ids[lo:hi]
        lo = hi


_COUNTED = "ids array<int>, block int, part int, counts array<long>"
_COUNTED_TYPES = [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int64())]


def _counted(sequences, n: int, go_on: bool):
    """Rows of sequences and, at the end, of this task's counts. sequences: arrays of slots with -1 between runs."""
    total, names = np.zeros(n, np.int64), ["ids", "block", "part", "counts"]
    for ids in sequences:
        live = ids[ids >= 0]
        if len(live):
            got = np.bincount(live)
            total[: len(got)] += got
        rows = list(_rows(_runs(ids))) if go_on else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, _COUNTED_TYPES[0]), *[pa.nulls(len(rows), t) for t in _COUNTED_TYPES[1:]]], names=names)
    part = TaskContext.get().partitionId()
    for lo in range(0, n, BLOCK):
        block = total[lo : lo + BLOCK]
        if block.any():
            one = [pa.nulls(1, _COUNTED_TYPES[0]), pa.array([lo // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([block], _COUNTED_TYPES[3])]
            yield pa.RecordBatch.from_arrays(one, names=names)


def _of_texts(table):
    def run(batches):
        words = table.value

        def sequences():
            for batch in batches:
                data, edge, code, langs = _texts(batch)
                salt = _salts(langs)
                parts = []
                for w in stretches(data, edge):
                    if len(w.first):
                        slot = words.find(w, salt[code[np.searchsorted(edge, w.first + w.lo, side="right") - 1]])
                        ids = np.full(len(slot) + int(w.new.sum()), -1, np.int32)
                        ids[np.arange(len(slot)) + np.cumsum(w.new)] = slot
                        parts.append(ids)
                if parts:
                    yield np.concatenate(parts)

        yield from _counted(sequences(), len(words), True)

    return run


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(whether both of a place and the next are slots, their keys) over the rows of a batch."""
    col = batch.column(0)
    edge = col.offsets.to_numpy()
    ids = np.insert(col.values.to_numpy()[edge[0] : edge[-1]], edge[1:-1] - edge[0], -1)
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return both, (ids[:-1][both].astype(np.uint64) << _SIGN) | ids[1:][both].astype(np.uint64)


def _seen_pairs(batches):
    for batch in batches:
        key, n = np.unique(_pairs(batch)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def _of_pairs(table, go_on: bool):
    def run(batches):
        slots = table.value

        def sequences():
            for batch in batches:
                both, key = _pairs(batch)
                ids = np.full(len(both), -1, np.int32)
                ids[both] = slots.find(key)
                yield ids

        yield from _counted(sequences(), len(slots), go_on)

    return run


def _summed(rows):
    first = rows.iloc[0]
    return type(rows)({"block": [first["block"]], "part": [first["part"]], "counts": [np.sum(np.stack(rows["counts"].to_list()), axis=0)]})


def tree_sum(counted: DataFrame, n: int) -> np.ndarray:
    """Counts of n slots from the arrays of all tasks: at most FAN arrays of a block meet in one step."""
    parts = counted.filter("block is not null").select("block", "part", "counts")
    groups = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while groups > 1:
        groups = -(-groups // FAN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("block", "part").applyInPandas(_summed, "block int, part int, counts array<long>")
    out = np.zeros(n, np.int64)
    for row in parts.select("block", "counts").toLocalIterator():
        out[row[0] * BLOCK : row[0] * BLOCK + len(row[1])] = row[1]
    return out


# ---------------------------------------------------------------- counts and scores


class Level:
    """Phrases of one length by slot: counts, slots of the first and of the last words, slot of the last word."""

    def __init__(self, keys: np.ndarray | None, counts: np.ndarray, below: Level | None):
        self.counts = counts
        if keys is None:
            self.last = np.arange(len(counts), dtype=np.int32)
        else:
            self.first_part, self.last_part = (keys >> _SIGN).astype(np.int32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int32)
            self.last = below.last[self.last_part]
        self.longer = np.zeros(len(counts), np.int64)  # most occurrences of a phrase that is longer by one word

    def covers(self, below: Level) -> None:
        np.maximum.at(below.longer, self.first_part, self.counts)
        np.maximum.at(below.longer, self.last_part, self.counts)


def _scores(shared, covered: int):
    """Rows of phrases by their place over all levels."""

    def run(batches):
        levels, words, langs, totals = shared.value
        edge = np.concatenate(([0], np.cumsum([len(x.counts) for x in levels[1:]])))
        names = ["lang", "phrase", "a", "l", "r", "n", "score"]
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k, top in enumerate(levels[1:], 2):
                slot = at[(at >= edge[k - 2]) & (at < edge[k - 1])] - edge[k - 2]
                slot = slot[100 * top.longer[slot] < covered * top.counts[slot]]
                if not len(slot):
                    continue
                left, right = {k: slot}, {k: slot}  # slots of the first and of the last i words
                for i in range(k, 1, -1):
                    left[i - 1], right[i - 1] = levels[i - 1].first_part[left[i]], levels[i - 1].last_part[right[i]]
                count = lambda i, s: levels[i - 1].counts[s]
                n = np.array([totals[x] for x in langs.take(pa.array(left[1])).to_pylist()], object)
                a = count(k, slot)
                score = l = r = None
                for i in range(1, k):
                    li, ri = count(i, left[i]), count(k - i, right[k - i])
                    s = 1000 * a.astype(object) * n // (li.astype(object) * ri.astype(object))  # Python's integers
                    if score is None:
                        score, l, r = s, li, ri
                    else:
                        less = (s < score).astype(bool)
                        score, l, r = np.where(less, s, score), np.where(less, li, l), np.where(less, ri, r)
                spelled = [words.take(pa.array(levels[i - 1].last[left[i]])) for i in range(1, k + 1)]
                phrase = pc.binary_join_element_wise(*spelled, " ")
                longs = [pa.array(x.tolist(), pa.int64()) for x in (a, l, r, n, score)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(left[1])), phrase, *longs], names=names)

    return run


_SCORED = "lang string, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = H.in_small_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = H.settle(texts.mapInArrow(_seen_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    often = words.filter(F.col("n") >= least)
    if often.count() > most:
        return _first(counted_by_shuffle(docs, least, longest, covered), top)
    got = often.select("lang", "word").orderBy("lang", "word").toArrow()
    if not len(got):
        return _first(spark.createDataFrame([], _SCORED), top)
    totals = dict(map(tuple, words.join(F.broadcast(often.select("lang").distinct()), "lang", "left_semi").groupBy("lang").agg(F.sum("n")).collect()))
    H.remove(words)
    table = WordSlots(got["lang"].to_pylist(), got["word"].to_pylist())
    spread = sc.broadcast(table)
    seq = H.settle(texts.mapInArrow(_of_texts(spread), _COUNTED), "slots")
    levels = [Level(None, tree_sum(seq, len(table)), None)]
    spread.unpersist()
    for k in range(2, longest + 1):
        runs = seq.filter("ids is not null").select("ids")
        seen = H.settle(runs.mapInArrow(_seen_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"), "pairs")
        n = seen.count()
        if n > most:
            return _first(counted_by_shuffle(docs, least, longest, covered), top)
        keys = np.sort(seen.toArrow()["key"].to_numpy()) if n else np.zeros(0, np.int64)
        H.remove(seen)
        if not n:
            break
        slots = Slots(keys.view(np.uint64))
        spread = sc.broadcast(slots)
        nxt = H.settle(runs.mapInArrow(_of_pairs(spread, k < longest), _COUNTED), "slots")
        H.remove(seq)
        seq = nxt
        levels.append(Level(slots.keys, tree_sum(seq, n), levels[-1]))
        levels[-1].covers(levels[-2])
        spread.unpersist()
    H.remove(seq)
    total = sum(len(x.counts) for x in levels[1:])
    shared = sc.broadcast((levels, table.words, table.langs, totals))
    rows = spark.range(0, total, 1, max(1, min(total // 20_000 + 1, 1_000)))
    return _first(rows.mapInArrow(_scores(shared, covered), _SCORED), top)


def _first(scored: DataFrame, top: int) -> DataFrame:
    """Spark keeps `top` rows of a language in each task before they meet."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def counted_by_shuffle(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """The same scored candidates by grouping and joining phrases: for tables of frequent phrases too large to broadcast."""
    plain = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(plain, r"[.,;:!?\n-\r]")).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(r"[^ \t]+"), F.lit(0)).alias("ws")).filter("size(ws) > 0")
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: i + k - 1 <= F.size("ws")), lambda i: F.struct(k.alias("k"), F.concat_ws(" ", F.slice("ws", i, k)).alias("phrase"))))))
    found = H.settle(words.select("lang", spans.alias("s")).groupBy("lang", "s.k", "s.phrase").agg(F.count("*").alias("f")).filter(F.col("f") >= least), "phrases")
    totals = words.groupBy("lang").agg(F.sum(F.size("ws")).cast("long").alias("n"))
    parts = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i")
    cuts = found.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), parts.alias("ws"), cut)
    joined = lambda at, size: F.concat_ws(" ", F.slice("ws", at, size))
    cuts = cuts.withColumn("left", joined(F.lit(1), F.col("i"))).withColumn("right", joined(F.col("i") + 1, F.col("k") - F.col("i")))
    side = lambda key, name: found.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")).cast("decimal(34,0)")).withColumn("base", wide("l") * wide("r")).withColumn("score", F.expr("top div base"))
    best = cuts.groupBy("lang", "k", "phrase", "a", "n").agg(F.min(F.struct("score", "i", "l", "r")).alias("b"))
    longer = found.filter("k > 2").select("lang", "f", parts.alias("ws"), F.col("k"))
    longer = longer.select("lang", "f", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(100 * F.coalesce("longer", F.lit(0)) < covered * F.col("a"))
    return kept.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


#: The same by counting every phrase of up to five words.
ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
s AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, ws[i:i + k - 1] AS ph, count(*) AS f FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT *, unnest(range(1, k)) AS i FROM f WHERE k > 1),
d AS (SELECT c.lang, c.k, c.ph, c.f AS a, c.i, x.f AS l, y.f AS r, n, ((1000 * c.f::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:c.i] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[c.i + 1:] JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, i) AS o FROM d) WHERE o = 1),
u AS (SELECT lang, f, unnest([ph[1:k - 1], ph[2:]]) AS ph FROM f WHERE k > 2),
g AS (SELECT lang, ph, max(f) AS longer FROM u GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(array_to_string(b.ph, ' '))) AS rank, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, score
  FROM b LEFT JOIN g ON g.lang = b.lang AND g.ph = b.ph WHERE coalesce(longer, 0) < a) WHERE rank <= 2000
"""
