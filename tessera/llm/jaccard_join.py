"""Exact Jaccard join of word-shingle sets by universe partitioning and the pigeonhole principle.

A document's set: its distinct 5-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words,
the whole sequence as one shingle; with no word or text, empty and linked with nothing. Two documents link when
100 |A & B| >= 75 |A | B|, that is when their symmetric difference is at most (|A| + |B|) (1 - s) / (1 + s).

Method. The universe is hashed into m segments; m depends on the size band [2^t, 2^(t+1)) of a set. Linked sets
differ in at most H segments, so among any H + 1 of the segments that hold something of a set at least one
agrees. A set therefore indexes its first H + 1 such segments, with H from its own size and the largest partner
it can have, in the scheme of its own band and, where a smaller partner may be in the band below, in that
scheme too. (If a <= b are the last segments indexed by two linked sets, every segment of the first set up to a
that agrees is among those indexed by the second.) Cost-based allocation decides how the H + 1 units are spent.
An exact match of a segment is one signature a unit. A match of a segment with one deletion (its own name and
those with one shingle less) counts two units and costs one signature more than the segment has shingles, that is
as much or more a unit. So a set with more than H segments that hold something buys exact matches only; one that
crowds into fewer buys all m segments with their one-deletion neighbourhoods, 2 m > H units, which always suffice.

Everything is judged on classes of equal sets, so copies never meet. Candidates are verified exactly:
1. signatures met by two or more classes; each class is verified against the least class of its signature;
2. components of the links found are taken, and only members of one signature in different components go on:
   they are compared in tiles of bounded size by a parity sketch, whose Hamming distance never exceeds the
   symmetric difference, so no linked pair is lost, and what passes is verified exactly. A first round takes the
   nearest pair of each two components of a tile, which joins most that belong together; a second round takes
   all pairs of components that are still apart.
Signatures of near copies thus cost a star, not all pairs, and signatures shared by unlike documents cost a few
machine words per pair inside a tile.

Words, shingles and classes are held by names of 64 bits: words by a mixing hash of their bytes, eight at a time,
shingles by a polynomial in these names. A text is cut into words once for its class, sketch and signatures, and once
more where its set is verified. Defined results: null, empty and
blank texts have n_shingles 0 and are their own component. component_id is the least doc_id reachable; a null
doc_id takes no part as a least id unless all are null. Rows that share a doc_id are separate rows, and share a
component only through their sets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as H

WIDTH = 5
NUM, DEN = 75, 100  # similarity, as a fraction
SKETCH, SKETCH_MOST = 16, 128  # words of 64 bits: for small sets, and at most
TILE = 512  # classes of one signature compared at once
SMALL_IDS = 1_000_000  # up to so many ids are broadcast (16 bytes each); beyond that they are joined by a shuffle

PIECE = 4 << 20  # bytes that are cut into words at once
LONG_WORD = 512  # bytes; longer words are named one by one
CLASSES_HELD = 200_000  # classes that a task knows to have written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_SPACE = re.compile(rb"[ \t-\r]")
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words_between(data: np.ndarray, lo: int, hi: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit name) of the words of data[lo:hi], A-Z lower-cased. Texts begin at heads."""
    b = np.zeros(hi - lo + 8, np.uint8)
    np.take(_LOWER, data[lo:hi], out=b[:-8])
    word = np.zeros(hi - lo + 2, bool)  # one further on, so that both ends have a neighbour
    np.take(_WORD, b[:-8], out=word[1:-1])
    cut = np.zeros(hi - lo + 1, bool)
    cut[heads[(heads > lo) & (heads < hi)] - lo] = True
    first = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    size = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1 - first
    eights = np.ndarray((hi - lo + 1,), "<u8", b, strides=(1,))
    names = H.splitmix(size.astype(np.uint64))
    live, at, left = np.arange(len(first)), first, size
    while len(live):  # eight bytes of each word at a time
        names[live] = H.splitmix(names[live] ^ (eights[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = (left > 8) & (size[live] <= LONG_WORD)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        names[i] = xxhash.xxh3_64_intdigest(b[first[i] : first[i] + size[i]].tobytes())
    return first + lo, names


def word_names(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts data[edge[i] : edge[i + 1]], and the number of words of each text."""
    places, names, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], int(edge[0])
    while lo < edge[-1]:
        k = int(np.searchsorted(edge, lo + PIECE, side="right")) - 1
        hi = int(edge[k])
        if hi <= lo:  # one text that is longer: cut between words
            last, hi = int(edge[k + 1]), lo + PIECE
            while hi < last and _WORD[data[hi]]:
                step = _SPACE.search(data[hi : hi + PIECE].tobytes())
                hi = min(last, hi + (step.start() if step else PIECE))
        at, name = _words_between(data, lo, hi, edge)
        places.append(at)
        names.append(name)
        lo = hi
    return np.concatenate(names), np.diff(np.searchsorted(np.concatenate(places), edge))


class Sets:
    """Sorted distinct 64-bit shingle names of several texts, one after the other: values[edge[i] : edge[i + 1]]."""

    def __init__(self, values: np.ndarray, edge: np.ndarray):
        self.values, self.edge = values, edge
        self.size = np.diff(edge)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.edge[i] : self.edge[i + 1]]

    def take(self, rows: np.ndarray) -> Sets:
        size = self.size[rows]
        edge = np.concatenate(([0], np.cumsum(size)))
        return Sets(self.values[np.repeat(self.edge[rows] - edge[:-1], size) + np.arange(edge[-1])], edge)

    def names(self) -> np.ndarray:
        """64-bit names of the sets; 0 for empty ones."""
        out = np.zeros(len(self.size), np.int64)
        some = np.flatnonzero(self.size)
        if len(some):
            sums = np.add.reduceat(self.values, self.edge[some])
            out[some] = H.splitmix(sums + (self.size[some].astype(np.uint64) << np.uint64(40))).view(np.int64)
        return out


def shingle_sets(data: np.ndarray, edges: np.ndarray, width: int = WIDTH) -> Sets:
    """Sets of the texts data[edges[i] : edges[i + 1]] of UTF-8 bytes."""
    names, size = word_names(data, edges)
    words = np.split(names, np.cumsum(size)[:-1]) if (size < width).any() else []
    names = np.concatenate((names, np.zeros(width, np.uint64)))
    h = np.zeros(len(names) - width, np.uint64)
    for k in range(width):
        h = h * np.uint64(H.BASE) + names[k : k + len(h)]
    h = H.splitmix(h + np.uint64(width))
    start = np.cumsum(size) - size
    for i in np.flatnonzero((size > 0) & (size < width)):  # the whole sequence as one
        one = np.zeros(1, np.uint64)
        for x in words[i]:
            one = one * np.uint64(H.BASE) + x
        h[start[i]] = H.splitmix(one + np.uint64(size[i]))[0]
    count = np.where(size > 0, np.maximum(1, size - width + 1), 0)
    edge = np.concatenate(([0], np.cumsum(count)))
    h = h[np.repeat(start - edge[:-1], count) + np.arange(edge[-1])]
    new = np.ones(len(h), bool)
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        h[lo:hi].sort()
    new[1:] = h[1:] != h[:-1]
    new[edge[:-1][count > 0]] = True
    return Sets(h[new], np.concatenate(([0], np.cumsum(new)))[edge])


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle names of UTF-8 bytes."""
    return shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), width).values


def difference_bound(a, b):
    """Largest symmetric difference of linked sets with a and b members."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def segments_of_band(t: int) -> int:
    """Enough segments that more than H of them hold something, as few as possible: fuller ones are more selective."""
    return 2 << t if t < 5 else 7 << (t - 3)


def _schemes(sets: Sets, t: np.ndarray, most: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, signature) of sets (none empty), each in the scheme of band t for partners of up to `most` members.

    Segments are ranges of the shingle names, which are uniform, so a sorted set lies in segment order.
    """
    rows = np.repeat(np.arange(len(t)), sets.size)
    need = difference_bound(sets.size, most) + 1
    m = np.array([segments_of_band(int(k)) for k in t], np.uint64)
    salt = t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seg = ((sets.values >> np.uint64(32)) * m[rows]) >> np.uint64(32)
    new = np.ones(len(seg), bool)
    new[1:] = seg[1:] != seg[:-1]
    new[sets.edge[:-1]] = True
    head = np.flatnonzero(new)
    at, ids, names = rows[head], seg[head], np.add.reduceat(sets.values, head)
    edge = np.searchsorted(head, sets.edge)
    enough = np.diff(edge) >= need
    # Enough segments hold something: exact subsets of one segment each, one signature a unit.
    use = enough[at] & (np.arange(len(head)) - edge[at] < need[at])
    out = [(at[use], H.splitmix(names[use] ^ (ids[use] * np.uint64(0xD1342543DE82EF95) + salt[at[use]])))]
    for i in np.flatnonzero(~enough):
        lo, hi = edge[i], edge[i + 1]
        sig = _with_deletions(sets[i], ids[lo:hi], head[lo:hi] - sets.edge[i], names[lo:hi], int(m[i]), salt[i])
        out.append((np.full(len(sig), i), sig))
    return out


def _with_deletions(s: np.ndarray, ids: np.ndarray, head: np.ndarray, names: np.ndarray, m: int, salt: np.uint64) -> np.ndarray:
    """Spend units on one-deletion neighbourhoods where plain segments do not suffice.

    Only sets that crowd into fewer than H + 1 segments come here. A segment matched with one deletion counts
    two units, and all m segments taken so make 2 m > H of them. Empty segments count too: one may be empty in
    the partner, or hold a single shingle there. The exact signatures serve partners that have segments enough.
    """
    size = np.diff(np.append(head, len(s)))
    exact, loose = (lambda i: i * np.uint64(0xD1342543DE82EF95) + salt), (lambda i: H.splitmix(i * np.uint64(2) + salt))
    drop = np.repeat(names, size) - s
    rest = np.setdiff1d(np.arange(m, dtype=np.uint64), ids)
    return np.concatenate((
        H.splitmix(names ^ exact(ids)), H.splitmix(names ^ loose(ids)), H.splitmix(drop ^ np.repeat(loose(ids), size)),
        H.splitmix(exact(rest)), H.splitmix(loose(rest)),
    ))


def all_signatures(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets, none empty, in order of rows; linked sets share at least one signature."""
    n = sets.size
    t = np.array([int(x).bit_length() - 1 for x in n], np.int64)
    out = _schemes(sets, t, n * DEN // NUM)
    below = np.flatnonzero((t > 0) & (n * NUM <= ((1 << t) - 1) * DEN))  # a partner may be in the band below
    if len(below):
        out += [(below[r], s) for r, s in _schemes(sets.take(below), t[below] - 1, (1 << t[below]) - 1)]
    rows, sigs = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], sigs[order]


def signatures(s: np.ndarray) -> np.ndarray:
    return all_signatures(Sets(s, np.array([0, len(s)])))[1] if len(s) else s


def _words(n: int) -> int:
    words = SKETCH
    while words < SKETCH_MOST and words * 32 < n:
        words *= 2
    return words


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch: bits toggled by the members. Hamming distance of sketches <= symmetric difference.

    Two bits a member, so that it stays telling for large sets; a sketch folds into one of half its size.
    """
    words = _words(len(s))
    bit = ((H.splitmix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(30)) & np.uint64(words * 64 - 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) folded to fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


# ---------------------------------------------------------------- passes over the texts


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a column of texts; null is empty."""
    col = col.fill_null("").cast(pa.large_binary())
    edges = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), edges


_CLASSES_DDL = "doc_id long, cls long, n long, sketch array<long>, sigs array<long>"


def _classes(batches):
    """Per row its class and the size of its set; sketch and signatures once for each class that the task meets."""
    seen: set[int] = set()
    for batch in batches:
        sets = shingle_sets(*_texts(batch.column(batch.schema.get_field_index("text"))))
        names = sets.names()
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        first &= sets.size > 0
        new = np.array([i for i in np.flatnonzero(first) if names[i] not in seen], np.int64)
        if len(seen) > CLASSES_HELD:
            seen.clear()  # a class may be written again: no harm
        seen.update(names[new].tolist())
        lists = [pa.nulls(len(names), pa.list_(pa.int64()))] * 2
        if len(new):
            rows, sigs = all_signatures(sets.take(new))
            none = np.ones(len(names), bool)
            none[new] = False
            lists = [_lists(none, np.concatenate(x), y) for x, y in (([sketch(sets[i]) for i in new], [_words(int(n)) for n in sets.size[new]]), ([sigs.view(np.int64)], np.bincount(rows, minlength=len(new))))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(sets.size), *lists], names=["doc_id", "cls", "n", "sketch", "sigs"])


def _lists(none: np.ndarray, values: np.ndarray, sizes) -> pa.Array:
    """Lists of the sizes given where not none, null elsewhere."""
    size = np.zeros(len(none), np.int32)
    size[~none] = sizes
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values), mask=pa.array(none))


def _set_rows(batches):
    for batch in batches:
        sets = shingle_sets(*_texts(batch.column(batch.schema.get_field_index("text"))))
        members = pa.ListArray.from_arrays(pa.array(sets.edge.astype(np.int32)), pa.array(sets.values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(sets.names()), members], names=["cls", "members"])


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SMALL_TILE = 24  # tiles of up to so many classes are compared many at once


class _Light:
    """What the rows of a batch say of their classes."""

    def __init__(self, batch: pa.RecordBatch):
        self.cls, self.comp, self.n, self.side = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("cls", "comp", "n", "side"))
        col = batch.column(batch.schema.get_field_index("sketch"))
        self.at = col.offsets.to_numpy().astype(np.int64)
        self.words = np.diff(self.at)
        self.flat = col.values.to_numpy().view(np.uint64)  # unsigned, for the bit count
        self.small = np.empty((len(self.cls), SKETCH), np.uint64)
        for w in np.unique(self.words):
            rows = np.flatnonzero(self.words == w)
            self.small[rows] = fold(self.whole(rows), SKETCH)

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """Sketches of rows of one size."""
        w = int(self.words[rows[0]])
        return self.flat[self.at[rows][:, None] + np.arange(w)]

    def near(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs may link: other components, sizes and sketches near enough."""
        ok = np.flatnonzero((self.comp[p] != self.comp[q]) & (self.n[p] * NUM <= self.n[q] * DEN) & (self.n[q] * NUM <= self.n[p] * DEN))
        most = (self.n[p] + self.n[q]) * (DEN - NUM) // (DEN + NUM)
        ok = ok[np.bitwise_count(self.small[p[ok]] ^ self.small[q[ok]]).sum(1, dtype=np.int64) <= most[ok]]
        keep = np.ones(len(ok), bool)
        u, v = self.words[p[ok]], self.words[q[ok]]
        for x, y in {*zip(u.tolist(), v.tolist(), strict=True)}:
            if min(x, y) > SKETCH:  # larger ones tell more
                k = np.flatnonzero((u == x) & (v == y))
                a, b = fold(self.whole(p[ok[k]]), min(x, y)), fold(self.whole(q[ok[k]]), min(x, y))
                keep[k] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= most[ok[k]]
        return ok[keep]


def _nearest_pairs(batches):
    """Of each two components in a tile the pair that is nearest by its sketches."""
    return _tiles(batches, True)


def _all_pairs(batches):
    return _tiles(batches, False)


def _tiles(batches, nearest: bool):
    """Rows sorted by tile: pairs of each tile that may link. A tile is bounded, and so is what is held."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([batch.column(k).to_numpy() for k in range(3)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        cut = int(new[-1]) if len(new) else 0
        held = batch.slice(cut)
        if cut:
            yield _compared(batch.slice(0, cut), new[:-1], nearest)
    if held is not None and len(held):
        yield _compared(held, np.zeros(0, np.int64), nearest)


def _compared(batch: pa.RecordBatch, new: np.ndarray, nearest: bool) -> pa.RecordBatch:
    """new: first rows of all tiles but the first."""
    x = _Light(batch)
    start = np.concatenate(([0], new))
    size = np.diff(np.append(start, len(x.cls)))
    tile = np.repeat(np.arange(len(start)), size)
    found_p, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        hit = x.near(p, q)
        found_p.append(p[hit])
        found_q.append(q[hit])

    small = size <= SMALL_TILE
    order = np.flatnonzero(small)[np.argsort(size[small], kind="stable")]
    for lo in range(0, len(order), 256):  # tiles of like size together
        s, k = start[order[lo : lo + 256]], size[order[lo : lo + 256]]
        m = int(k.max())
        at = np.minimum(s[:, None] + np.arange(m), len(x.cls) - 1)
        ok = np.arange(m) < k[:, None]
        i, j = np.triu_indices(m, 1)
        p, q = at[:, i], at[:, j]
        hit = ok[:, i] & ok[:, j] & ((x.side[p] == 2) | (x.side[p] != x.side[q]))
        compare(p[hit], q[hit])
    for t in np.flatnonzero(~small):
        rows = np.arange(start[t], start[t] + size[t])
        left, right = rows[x.side[rows] != 1], rows[x.side[rows] != 0]
        same = x.side[rows[0]] == 2
        for i in left:
            at = right[right > i] if same else right
            compare(np.full(len(at), i), at)
    p, q = np.concatenate(found_p), np.concatenate(found_q)
    if nearest and len(p):
        d = np.bitwise_count(x.small[p] ^ x.small[q]).sum(1, dtype=np.int64)
        c, e = np.minimum(x.comp[p], x.comp[q]), np.maximum(x.comp[p], x.comp[q])
        order = np.lexsort((d, e, c, tile[p]))
        t, c, e = tile[p][order], c[order], e[order]
        first = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (e[1:] != e[:-1])))
        p, q = p[order[first]], q[order[first]]
    a, b = x.cls[p], x.cls[q]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)  # once a batch, whatever the signatures
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR)


def _plausible(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link; drops no pair that links."""
    left = light.select(F.col("cls").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("p"))
    right = light.select(F.col("cls").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("q"))
    pairs = pairs.join(left, "a").join(right, "b").filter((F.col("p") * NUM <= F.col("q") * DEN) & (F.col("q") * NUM <= F.col("p") * DEN))
    m = F.least(F.size("x"), F.size("y"))
    xor = lambda u, v: u.bitwiseXOR(v)
    # Sets of linkable sizes have sketches of one size, or one is twice as large and folds.
    folded = lambda c: F.when(F.size(c) > m, F.zip_with(F.slice(c, 1, m), F.slice(c, m + 1, m), xor)).otherwise(F.col(c))
    near = F.aggregate(F.zip_with(folded("x"), folded("y"), xor), F.lit(0), lambda s, d: s + F.bit_count(d))
    return pairs.filter(near <= F.floor((F.col("p") + F.col("q")) * (DEN - NUM) / (DEN + NUM))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by exact intersection of their sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(both * DEN >= (F.size("x").cast("long") + F.size("y") - both) * NUM).select("a", "b")


# ---------------------------------------------------------------- the join


class _Sets:
    """Shingle sets of classes, read from the text of one document of each."""

    def __init__(self, texts: DataFrame, members: DataFrame):
        self.texts = texts
        self.owners = H.settle(members.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "jj-owners")  # null: no copy has an id
        self.unique = members.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()

    def of(self, pairs: DataFrame, label: str) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        owner = H.settle(self.owners.join(wanted, "cls", "left_semi"), "jj-owner")
        ids = owner.filter("doc_id is not null").select("doc_id").distinct()
        rows = self.texts.join(F.broadcast(ids) if owner.count() <= SMALL_IDS else ids, "doc_id").select("text")
        if not self.unique and not owner.filter("doc_id is null").isEmpty():
            rows = rows.union(self.texts.filter("doc_id is null").select("text"))
        sets = rows.mapInArrow(_set_rows, "cls long, members array<long>")
        if not self.unique:  # documents that share an id may hold other sets
            sets = sets.join(owner, "cls", "left_semi").dropDuplicates(["cls"])
        return H.settle(sets, label)


def _linked(pairs: DataFrame, sets: _Sets, label: str) -> tuple[DataFrame, DataFrame]:
    """(pairs that link, pairs that were verified)."""
    pairs = H.settle(pairs, "jj-plausible")
    H.release()
    held = sets.of(pairs, "jj-sets")
    out = H.settle(_verified(pairs, held), label)
    H.discard(held)
    return out, pairs


def join_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, cls, n per row of docs; links between classes as node -> component, roots left out)."""
    texts = H.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = H.settle(texts.mapInArrow(_classes, _CLASSES_DDL), "jj-members")
    sigs = members.select("cls", F.explode("sigs").alias("sig"))
    met = sigs.groupBy("sig").agg(F.min("cls").alias("p"), F.max("cls").alias("q")).filter("p <> q").select("sig")
    met = H.settle(met, "jj-met")
    H.release()
    groups = H.settle(sigs.join(met, "sig").distinct(), "jj-groups")  # several tasks may hold copies of a class
    H.discard(met)
    members = members.select("doc_id", "cls", "n", "sketch")
    lead = groups.groupBy("sig").agg(F.min("cls").alias("lead"))
    star = groups.join(lead, "sig").filter("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    light = members.groupBy("cls").agg(F.first("sketch", ignorenulls=True).alias("sketch"), F.first("n").alias("n"))
    light = H.settle(light.join(groups.select("cls").distinct(), "cls", "left_semi"), "jj-light")
    H.release()
    sets = _Sets(texts, members)
    first, tried = _linked(_plausible(star, light), sets, "jj-star")
    H.release()
    parts = H.settle(H.components(first), "jj-parts")
    links = first
    for step in (_nearest_pairs, _all_pairs):
        near = _dealt(groups, parts, light).mapInArrow(step, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        more, verified = _linked(near, sets, "jj-near")
        tried = tried.union(verified)
        if not more.isEmpty():
            links = links.union(more)
            parts = H.settle(H.components(links), "jj-parts")
        H.release()
    return members, parts


def _dealt(groups: DataFrame, parts: DataFrame, light: DataFrame) -> DataFrame:
    """Members of signatures that lie in several components, dealt to tiles (sig, i, j) of up to about 2 * TILE rows."""
    placed = groups.join(parts, F.col("cls") == F.col("node"), "left").select("sig", "cls", F.coalesce("component", "cls").alias("comp"))
    names = [F.bit_xor(F.xxhash64(F.lit(i), "cls")).alias(f"h{i}") for i in (1, 2)]
    several = placed.groupBy("sig").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("k"), *names).filter("p <> q and k > 2")
    several = several.groupBy("k", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig", "k")  # equal groups are compared once
    rows = placed.join(several, "sig").join(light, "cls").withColumn("tiles", F.ceil(F.col("k") / TILE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(
        "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp", "n", "sketch",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")


def placed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, cls (its set) and root (its component; classes that link with nothing are their own)."""
    members, parts = join_classes(docs)
    parts = parts.select(F.col("node").alias("cls"), "component")
    return H.join_facts(members.select("doc_id", "n", "cls"), parts, "cls").select("doc_id", "n", "cls", F.coalesce("component", "cls").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included)."""
    filled = H.settle(placed(docs), "jj-placed")
    least = H.settle(filled.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "jj-least")
    return H.join_facts(filled, least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _classed_rows(at: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(*_texts(batch.column(0).field(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.names()), pa.array(sets.size)], names=["row", "cls", "n"])

    return run


def with_class(docs: DataFrame) -> DataFrame:
    """Rows of docs as a struct `row` of c0, c1, ..., with the class of each text and the size of its set."""
    packed = H.in_small_batches(docs).select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    return packed.mapInArrow(_classed_rows(docs.columns.index("text")), f"row {packed.schema['row'].dataType.simpleString()}, cls long, n long")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The same result for a small fixture: all pairs, sets of word tuples."""
    import re

    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} if w else set()
    at = {d: d for d in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x = len(sets[a] & sets[b])
            if x and DEN * x >= NUM * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(a), find(b)
                at[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets.items())
