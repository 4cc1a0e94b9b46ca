"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte is removed when some string of `threshold` bytes that covers it also starts earlier: in a document of
smaller id, or in the same document at an earlier byte. Strings are judged on the input.

Method: prefix doubling. Spark sorts pairs (rank, rank further on) of positions by range, documents of a pair in
order; a pair's place gives the position its new rank. Positions whose rank is unique leave, those that are not the
first of their rank past the threshold are repeats, and the others go on at a larger offset.

1. Inside a task, names of 1, 2, 4, ... `GRAM` bytes are made by doubling. In each window of `threshold`
   bytes one gram stands for the window (the least name, leftmost), so equal windows have equal standing
   grams, and about one position in 35 takes part in the distributed rounds.
2. Ranks of GRAM bytes are counted; positions with a unique rank leave before any sort.
3. First sort: the offset grows to the whole stretch of windows that a gram stands for. Positions with equal
   pairs (gram rank, stretch rank) hold equal windows: all but those of the least document are repeats.
4. Second sort, where one gram has several stretches: the offset grows to threshold - 5 bytes, the part that
   six neighbouring windows share. Windows whose part has a unique rank leave; equal pairs (part, six windows)
   are settled as before.
5. Third sort, past the threshold: what is left is ranked window by window, as the pair (rank of 64 bytes at i,
   rank of 64 bytes at i + threshold - 64), and again all but the least document's are repeats.

Two things differ from the textbook form. Not every byte is a position: sorting pairs of all of them takes far more
disk than the input (figures in the README), so one position stands for about 35 windows. And the ranks that enter a
sort are 64-bit names of the bytes (equal strings have equal names) in place of numbers dealt out by the round before:
the ranks further on are then known where the text is, without a join for each offset.

A sort splits by document what is equal in rank, so a passage in a third of all documents is spread over tasks.
Classes that go on across partitions are put together from one row a partition. What a document's list holds is
bounded by its own length.

Defined results: null text is empty. A null doc_id counts as later than all others. Rows that share a doc_id
count as documents in the order of a hash of their texts; equal rows are judged alike, each against smaller ids
and itself. Texts shorter than the threshold keep all bytes.
Columns of the input other than doc_id and text are ignored by `repeated_spans` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as H

THRESHOLD = 100
GRAM = 32
BLOCK = 1 << 17
GROUP = 6
_LAST = 2**63 - 1


def _names(b: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Names of all substrings of `width` bytes, a power of two, by doubling."""
    h, w = codes[b], 1
    while w < width:
        h = H.doubled(h, w)
        w *= 2
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by doubling."""
    m, w = keys, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    rest = width - w
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def stretches(b: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, ...]:
    """(gram name, stretch name, first window, number of windows, gram - first) of each standing gram of the bytes b."""
    out = []
    for lo in range(0, max(0, len(b) - threshold + 1), BLOCK):
        part = b[lo : lo + BLOCK + threshold - 1]
        grams = H.splitmix(_names(part, H.BYTE_CODES, GRAM))
        at = np.arange(len(grams), dtype=np.uint64)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at
        stand = (_least(keys, threshold - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(stand[1:] != stand[:-1]) + 1))
        count = np.diff(np.append(first, len(stand)))
        sums = H.prefix_sums(H.BYTE_CODES_2[part])
        whole = H.spans_hash(sums, first, first + count + threshold - 1)
        offset = (stand[first] - first).astype(np.uint64)
        whole = H.splitmix(whole ^ H.splitmix(offset * np.uint64(1 << 20) + count.astype(np.uint64)))
        out.append((grams[stand[first]].view(np.int64), whole.view(np.int64), first + lo, count, stand[first] - first))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """UTF-8 bytes of a string column without decoding."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    for i in range(len(col)):
        yield data[offsets[i] : offsets[i + 1]] if col[i].is_valid else data[:0]


_COUNTS = pa.schema([("g", pa.int64()), ("n", pa.int64())])
#: A position in the race: rank, rank of all its windows, document, first window, number of windows, distance
#: from the first window to the standing gram; local: repeats inside one document, settled where they are found.
_ROWS = pa.schema([("r", pa.int64()), ("w", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("m", pa.int16()), ("off", pa.int16()), ("local", pa.bool_())])
_ROWS_DDL = "r long, w long, doc long, first int, m short, off short, local boolean"


def _flush(rows: list, schema: pa.Schema, limit: int = 0) -> Iterator[pa.RecordBatch]:
    if rows and sum(len(r[0]) for r in rows) > limit:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()


def _gram_counts(threshold: int):
    def run(batches):
        rows: list = []
        for batch in batches:
            for b in _texts(batch, "text"):
                g = stretches(b, threshold)[0]
                if len(g):
                    rows.append((g,))
            if sum(len(r[0]) for r in rows) > 500_000:
                yield _counted(rows)
        if rows:
            yield _counted(rows)

    return run


def _counted(rows: list) -> pa.RecordBatch:
    """Combine before the shuffle: a gram is one row however often this task met it."""
    g, n = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], schema=_COUNTS)


def _entries(doc: int, r: np.ndarray, w: np.ndarray, first: np.ndarray, m: np.ndarray, off: np.ndarray) -> list[tuple]:
    """Rows of one document: the first of equal (r, w) enters the race, the others are local repeats."""
    again = np.ones(len(r), bool)
    again[np.unique(H.splitmix(r.view(np.uint64)) ^ w.view(np.uint64), return_index=True)[1]] = False
    new = ~again
    k = int(new.sum())
    rows = [(r[new], w[new], np.full(k, doc), first[new], m[new], off[new], np.zeros(k, bool))]
    if again.any():
        lo, hi = _merged(first[again], first[again] + m[again])
        n = -(-(hi - lo) // 30_000)  # m is a short
        at = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * 30_000
        size = np.minimum(np.repeat(hi, n) - at, 30_000)
        rows.append((at, at, np.full(len(at), doc), at, size, np.zeros(len(at), np.int64), np.ones(len(at), bool)))
    return rows


def _stretch_rows(threshold: int):
    def run(batches):
        rows: list = []
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc")).to_numpy(zero_copy_only=False)
            for doc, b in zip(docs, _texts(batch, "text"), strict=True):
                g, c, first, m, off = stretches(b, threshold)
                if len(g):
                    rows += _entries(doc, g, c, first, m, off)
            yield from _flush(rows, _ROWS, 200_000)
        yield from _flush(rows, _ROWS)

    return run


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [lo, hi) as maximal ones; touching ones join."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


def _todo_rows(threshold: int, step):
    """Rows that `step` makes of the stretches still to be settled, document by document in bounded pieces."""

    def run(batches):
        rows: list = []
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc")).to_numpy(zero_copy_only=False)
            todo = batch.column(batch.schema.get_field_index("todo"))
            for i, (doc, b) in enumerate(zip(docs, _texts(batch, "text"), strict=True)):
                x = todo[i].values
                first, m, off = (x.field(k).to_numpy().astype(np.int64) for k in range(3))
                order = np.argsort(first, kind="stable")
                rows += _entries(doc, *step(b, first[order], m[order], off[order], threshold))
            yield from _flush(rows, _ROWS, 200_000)
        yield from _flush(rows, _ROWS)

    return run


def _ranges(m: np.ndarray) -> np.ndarray:
    return np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)


def six_windows(b: np.ndarray, first: np.ndarray, m: np.ndarray, off: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Stretches cut into groups of up to GROUP windows, on a grid that starts at the standing gram."""
    at = first + off
    low, high = (off - m + 1) // GROUP, off // GROUP
    n = high - low + 1
    k = np.repeat(low, n) + _ranges(n)
    at, lo_all, hi_all = np.repeat(at, n), np.repeat(first, n), np.repeat(first + m, n)
    lo, hi = np.maximum(lo_all, at - k * GROUP - GROUP + 1), np.minimum(hi_all, at - k * GROUP + 1)
    sums = H.prefix_sums(H.BYTE_CODES[b])
    shared = H.spans_hash(sums, at - k * GROUP, at - k * GROUP - GROUP + 1 + threshold)
    whole = H.spans_hash(H.prefix_sums(H.BYTE_CODES_2[b]), lo, hi - 1 + threshold)
    shape = ((at - lo) * 4096 + (hi - lo)).astype(np.uint64)
    r = H.splitmix(shared ^ H.splitmix(k.astype(np.uint64)))
    return r.view(np.int64), H.splitmix(whole ^ H.splitmix(shape)).view(np.int64), lo, hi - lo, at - lo


def single_windows(b: np.ndarray, first: np.ndarray, m: np.ndarray, off: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Every window with the ranks of its first and its last 64 bytes."""
    at = np.repeat(first, m) + _ranges(m)
    sums = H.prefix_sums(H.BYTE_CODES_2[b])
    r, w = H.splitmix(H.spans_hash(sums, at, at + 64)), H.splitmix(H.spans_hash(sums, at + threshold - 64, at + threshold))
    return r.view(np.int64), w.view(np.int64), at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a column __doc that orders documents: doc_id where ids are unique, else a rank by (doc_id, text)."""
    plain = H.in_small_batches(docs).withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    if plain.groupBy("__doc").count().filter("count > 1").isEmpty():
        return plain
    key = ["__none", "__doc", "__hash"]  # documents without an id come behind the largest id
    hashed = plain.withColumns({"__none": F.col("doc_id").isNull(), "__hash": F.xxhash64("text")})
    order = hashed.select(*key).distinct().orderBy(*key).withColumn("__rank", F.monotonically_increasing_id())
    order = H.settle(order, "sa-order")  # monotone in (doc_id, hash); written once, so every later pass sees the same ranks
    return hashed.join(order, key, "left").drop(*key).withColumnRenamed("__rank", "__doc")


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows (doc, start, stop): byte intervals to remove; they may overlap. docs comes from `keyed`."""
    if not GRAM * 2 <= threshold <= 128:
        raise ValueError("threshold must be 64 to 128 bytes")
    texts = docs.select(F.col("__doc").alias("doc"), "text").filter(F.octet_length("text") >= threshold)
    many = H.settle(
        texts.select("text").mapInArrow(_gram_counts(threshold), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g"), "sa-grams"
    )
    H.release()
    rows = texts.mapInArrow(_stretch_rows(threshold), _ROWS_DDL)
    live = H.settle(rows.join(many.select(F.col("g").alias("r"), F.lit(True).alias("hit")), "r", "left").filter("local or hit").drop("hit"), "sa-live")
    H.discard(many)
    spans, todo = _settled(live, threshold)
    for step in (six_windows, single_windows):
        later = H.settle(texts.join(todo, "doc").select("doc", "text", "todo").mapInArrow(_todo_rows(threshold, step), _ROWS_DDL), "sa-later")
        H.release()
        more, todo = _settled(later, threshold, step is single_windows)
        spans = spans.union(more)
    return spans


#: What a partition of the sorted pairs tells of its ends: its first pair and document, its last pair, the document
#: with which the last pair's class begins here, whether that class is the only one here, and whether the ranks at
#: either end have several classes here.
_ENDS = pa.struct([("r0", pa.int64()), ("w0", pa.int64()), ("doc0", pa.int64()), ("r1", pa.int64()), ("w1", pa.int64()), ("doc1", pa.int64()), ("one", pa.bool_()), ("several0", pa.bool_()), ("several1", pa.bool_())])
_RANKED = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("first", pa.int32()), ("m", pa.int16()), ("off", pa.int16()), ("late", pa.bool_()), ("several", pa.bool_()), ("edge", pa.int8()), ("ends", _ENDS)])
_RANKED_DDL = (
    "part int, doc long, first int, m short, off short, late boolean, several boolean, edge byte, "
    "ends struct<r0:long,w0:long,doc0:long,r1:long,w1:long,doc1:long,one:boolean,several0:boolean,several1:boolean>"
)
_FIRST_CLASS, _FIRST_RANK, _LAST_RANK = 1, 2, 4  # bits of edge: what the neighbouring partitions may hold, too


def _reranked(batches):
    """Sorted pairs (r, w) of a partition: which rows are late in their class, and which ranks r have several classes.

    Rows that are first in the only class of their rank have a unique rank, or are the first of their kind, and leave,
    unless the class or rank may go on in another partition. Only such first rows wait for the end of their rank.
    """
    part = TaskContext.get().partitionId()
    ends: dict | None = None
    r1 = w1 = least1 = 0
    several1, classes = False, 0
    waiting: list[tuple[np.ndarray, ...]] = []

    def rows(columns: tuple[np.ndarray, ...], late, several, edge) -> pa.RecordBatch:
        n = len(columns[0])
        full = lambda x, t: pa.array(np.broadcast_to(x, n).astype(t))
        cols = [full(part, np.int32), *(pa.array(c) for c in columns), full(late, bool), full(several, bool), full(edge, np.int8), pa.nulls(n, _ENDS)]
        return pa.RecordBatch.from_arrays(cols, schema=_RANKED)

    def released(several: bool, last: bool) -> Iterator[pa.RecordBatch]:
        for *columns, edge in waiting:
            edge = edge | (_LAST_RANK if last else 0)
            keep = np.broadcast_to(several, len(edge)) | (edge > 0)
            if keep.any():
                yield rows(tuple(c[keep] for c in columns), False, several, edge[keep])
        waiting.clear()

    for batch in batches:
        if not len(batch):
            continue
        r, w, doc, first, m, off = (batch.column(i).to_numpy() for i in range(6))
        begins = ends is None
        if begins:
            ends = {"r0": int(r[0]), "w0": int(w[0]), "doc0": int(doc[0])}
        new_rank = np.append(begins or r[0] != r1, r[1:] != r[:-1])
        new_class = new_rank | np.append(begins or w[0] != w1, w[1:] != w[:-1])
        head = np.maximum.accumulate(np.where(new_class, np.arange(len(r)), -1))
        least = np.where(head < 0, least1, doc[head])
        group = np.cumsum(new_rank)  # 0: the rank goes on from the batch before
        started = np.bincount(group, weights=new_class, minlength=group[-1] + 1)
        several = started >= 2
        several[0] = several1 or started[0] >= 1
        number = classes + np.cumsum(new_class)  # 1 in the partition's first class
        if waiting and (several[0] or group[-1] > 0):
            yield from released(bool(several[0]), False)
        late = doc > least
        edge = np.where(number == 1, _FIRST_CLASS, 0) | np.where(r == ends["r0"], _FIRST_RANK, 0)
        wait = ~late & (group == group[-1]) & ~several[group[-1]]
        if wait.any():
            waiting.append(tuple(c[wait] for c in (doc, first, m, off, edge)))
        keep = ~wait & (late | several[group] | (edge > 0))
        if keep.any():
            yield rows(tuple(c[keep] for c in (doc, first, m, off)), late[keep], several[group][keep], edge[keep])
        r1, w1, least1, several1, classes = r[-1], w[-1], least[-1], bool(several[group[-1]]), int(number[-1])
        if "several0" not in ends and group[-1] > int(begins):  # the first rank has ended
            ends["several0"] = bool(several[int(begins)])
    if ends is not None:
        yield from released(several1, True)
        ends |= {"r1": int(r1), "w1": int(w1), "doc1": int(least1), "one": classes == 1, "several1": several1}
        ends.setdefault("several0", several1)
        cols = [pa.array([part], pa.int32()), *(pa.nulls(1, f.type) for f in list(_RANKED)[1:-1]), pa.array([ends], _ENDS)]
        yield pa.RecordBatch.from_arrays(cols, schema=_RANKED)


def _across(ends: list) -> list[tuple[int, int | None, bool, bool]]:
    """(part, least document of its first class in earlier partitions or None, whether its first rank, its last rank has several classes) of partitions in order."""
    several0, several1 = [e.several0 for _, e in ends], [e.several1 for _, e in ends]
    carry: list[int | None] = [None] * len(ends)
    for i in range(1, len(ends)):
        before, e = ends[i - 1][1], ends[i][1]
        if before.r1 == e.r0:
            if before.w1 == e.w0:
                carry[i] = carry[i - 1] if before.one and carry[i - 1] is not None else before.doc1
            known = several1[i - 1] or several0[i] or before.w1 != e.w0
            several0[i] = known
            several1[i] = several1[i] or (known and e.r0 == e.r1)
    for i in range(len(ends) - 2, -1, -1):
        e, after = ends[i][1], ends[i + 1][1]
        if e.r1 == after.r0:
            several1[i] = several1[i] or several0[i + 1]
            several0[i] = several0[i] or (several1[i] and e.r0 == e.r1)
    return [(p, carry[i], several0[i], several1[i]) for i, (p, _) in enumerate(ends)]


def _settled(rows: DataFrame, threshold: int, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(intervals found to be repeats, per document the positions that only a longer rank can settle)."""
    spark, order = rows.sparkSession, ["r", "w", "doc", "first"]
    race = rows.filter("not local").select("r", "w", "doc", "first", "m", "off")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = H.settle(race.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_reranked, _RANKED_DDL), "sa-ranked")
    H.release()
    # One row a partition comes to the driver: what lies on both sides of a boundary.
    ends = sorted(((x.part, x.ends) for x in ranked.filter("ends is not null").select("part", "ends").collect()), key=lambda x: (x[1].r0, x[1].w0, x[1].doc0))
    facts = spark.createDataFrame(_across(ends), "part int, carry long, several0 boolean, several1 boolean")
    bit = lambda b: F.col("edge").bitwiseAND(F.lit(b).cast("byte")) > 0
    ruled = ranked.filter("ends is null").join(F.broadcast(facts), "part")
    ruled = ruled.withColumn("late", F.col("late") | (bit(_FIRST_CLASS) & F.coalesce(F.col("doc") > F.col("carry"), F.lit(False))))
    ruled = ruled.withColumn("several", F.col("several") | (bit(_FIRST_RANK) & F.col("several0")) | (bit(_LAST_RANK) & F.col("several1")))
    gone = rows.filter("local").select("doc", "first", "m").union(ruled.filter("late").select("doc", "first", "m"))
    todo = ruled.filter("not late and several").groupBy("doc").agg(F.collect_list(F.struct("first", "m", "off")).alias("todo"))
    return gone.select("doc", F.col("first").alias("start"), (F.col("first") + F.col("m") + (threshold - 1)).alias("stop")), todo


def _cut(columns: list[str], whole_characters: bool):
    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans"))
            out = []
            for i, b in enumerate(_texts(batch, "text")):
                s = spans[i].values if spans[i].is_valid else None
                if s is None or not len(s):
                    out.append((len(b), 0, 0, b.tobytes()))
                    continue
                lo, hi = _merged(s.field(0).to_numpy().astype(np.int64), s.field(1).to_numpy().astype(np.int64))
                hi = np.minimum(hi, len(b))
                lo, hi = lo[lo < hi], hi[lo < hi]
                if whole_characters:  # a character stays if any of its bytes does
                    lead = np.append((b & 0xC0) != 0x80, True)
                    heads = np.flatnonzero(lead)
                    lo, hi = heads[np.searchsorted(heads, lo)], heads[np.searchsorted(heads, hi, side="right") - 1]
                    lo, hi = lo[lo < hi], hi[lo < hi]
                raw = b.tobytes()
                edges = np.concatenate(([0], np.stack([lo, hi], 1).ravel(), [len(raw)]))
                kept = b"".join(raw[int(x) : int(y)] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), int((hi - lo).sum()), len(lo), kept))
            n, gone, k, kept = zip(*out, strict=True) if out else ((), (), (), ())
            more = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64())]
            if whole_characters:
                more.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()))
            else:
                more.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + more, names=columns + ["n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _with_spans(docs: DataFrame, threshold: int) -> DataFrame:
    docs = keyed(docs)
    lists = repeated_spans(docs, threshold).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    lists = H.settle(lists, "sa-lists")
    return docs.join(lists.withColumnRenamed("doc", "__doc"), "__doc", "left")


def digest(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    joined = _with_spans(docs.select("doc_id", "text"), threshold).select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(["doc_id"], False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string").withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with text cut to whole kept characters; all other columns stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("__row"))
    joined = _with_spans(packed, threshold).select("text", "spans", "__row")
    row_type = packed.schema["__row"].dataType.simpleString()
    cut = joined.mapInArrow(_cut(["__row"], True), f"__row {row_type}, n_bytes long, n_removed long, n_spans long, kept string")
    return cut.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"__row.c{others.index(c)}").alias(c) for c in docs.columns])


def brute_force(rows: list[tuple[int, str | None]], threshold: int = THRESHOLD) -> list[tuple]:
    """The same digest for a small fixture, by looking at every window in order."""
    seen: dict[bytes, int] = {}
    out = []
    data = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda x: x[0])
    for doc, raw in data:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - threshold + 1):
            w = raw[i : i + threshold]
            if w in seen:
                gone[i : i + threshold] = True
            else:
                seen[w] = doc
        runs = int(((gone[1:].astype(int) - gone[:-1].astype(int)) == 1).sum() + gone[0])
        out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return out
