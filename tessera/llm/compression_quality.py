"""Quality by compression: two zstandard dictionaries, one of good and one of bad text, and a calibrated difference.

A whole text is cut into blocks of BLOCK bytes, so that what a dictionary knows counts as much at the end of a long
text as at its beginning. Each block is compressed with the dictionary of good text and with that of bad text. The
difference of the two sums (bad less good), divided by the bytes of the text, is its normalised compressed-size
difference: the higher, the more the text is like the good ones. Sizes are whole bytes, so that a short text shows little:
each text counts EVIDENCE bytes more, of the difference that all labelled texts have together. Calibration turns it into the probability of label 1: an
isotonic fit (pool adjacent violators, linear in between) with a logistic one (Platt) mixed in, so that texts keep their
order where the isotonic fit is flat. Both only rise.

Learning takes a bounded sample, the rest nothing: of each label the PER_LABEL documents of least hash of doc_id, over
all rows, as many of them in that order as CLASS_BYTES hold; texts of more than LONGEST bytes aren't learned
from. Two of three build the dictionaries, the third calibrates, weighed by how often the labels are among all labelled
rows. These bounds are parameters. Every text is scored, whole.

Defined results: null and empty texts have that common difference and its score. doc_ids with two labels, with a null or another
label than 0 and 1, and rows without doc_id aren't learned from; of rows that share a doc_id one text is. With one label
only, it is the score of every text; with none, 0.5. Equal texts get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as H

PER_LABEL, CLASS_BYTES, LONGEST = 2_000, 8 << 20, 256 << 10
DICTIONARY, SAMPLE, BLOCK, LEVEL = 32_768, 256, 512, 3  # bytes of a dictionary, of what it is trained on, of a block
EVIDENCE = 128  # bytes of the common difference that each text begins with
HELD_OUT = 5  # crc32(doc_id) mod this is 0: never learned from
GOOD = 0.3  # least score that is predicted as 1
ISOTONIC = 0.85  # its share of the score


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT))


def trained(texts: list[bytes]) -> bytes:
    """A dictionary of texts; where there is too little to train on, their last bytes as they are."""
    pieces = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


class Difference:
    """Normalised compressed-size difference by two dictionaries; common: what a text without evidence has."""

    def __init__(self, good: bytes, bad: bytes, common: float = 0.0):
        self.packers, self.common = [], common
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def saved(self, text: bytes) -> int:
        good, bad = self.packers
        view = memoryview(text)
        return sum(len(bad.compress(view[i : i + BLOCK])) - len(good.compress(view[i : i + BLOCK])) for i in range(0, len(text), BLOCK))

    def __call__(self, text: bytes) -> float:
        return (self.saved(text) + EVIDENCE * self.common) / (len(text) + EVIDENCE)


class Calibration:
    """Probability of label 1 by a value; weights: of each row."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        order = np.lexsort((y, x))
        x, y, weight = x[order], y[order].astype(float), weight[order] / weight.mean()
        base = float((y * weight).sum() / weight.sum())
        blocks: list[list[float]] = []  # ones, rows, from, to
        for xi, yi, wi in zip(x, y, weight, strict=True):
            blocks.append([yi * wi, wi, xi, xi])
            while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
                ones, rows, _, to = blocks.pop()
                blocks[-1] = [blocks[-1][0] + ones, blocks[-1][1] + rows, blocks[-1][2], to]
        self.at = np.array([e for b in blocks for e in b[2:]])
        self.p = np.maximum.accumulate(np.repeat([(b[0] + base) / (b[1] + 1) for b in blocks], 2))  # one more row of the base rate
        self.mid, self.scale = float(x.mean()), float(x.std()) or 1.0
        z = np.stack([(x - self.mid) / self.scale, np.ones(len(x))], 1)
        w = np.zeros(2)
        for _ in range(50):  # Newton, with a small ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (weight * (y - p)) - 1e-2 * w)
        self.slope, self.shift = max(0.0, float(w[0])), float(w[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        smooth = 1 / (1 + np.exp(-np.clip((x - self.mid) / self.scale * self.slope + self.shift, -30, 30)))
        return ISOTONIC * np.interp(x, self.at, self.p) + (1 - ISOTONIC) * smooth


class Model:
    """Dictionaries and calibration learned from texts of both labels, in an order of their own; counts: of all labelled rows."""

    def __init__(self, good: list[bytes], bad: list[bytes], counts: tuple[int, int]):
        build = [[t for i, t in enumerate(texts) if i % 3 < 2] for texts in (good, bad)]
        judge = [[t for i, t in enumerate(texts) if i % 3 == 2] or texts for texts in (good, bad)]
        self.dictionaries = tuple(trained(texts) for texts in build)
        plain = Difference(*self.dictionaries)
        # Of each label by what a byte of it shows, together by how often the labels are.
        shown = [sum(map(plain.saved, texts)) / max(1, sum(map(len, texts))) for texts in judge]
        self.common = (counts[0] * shown[0] + counts[1] * shown[1]) / sum(counts)
        difference = Difference(*self.dictionaries, self.common)
        x = np.array([difference(t) for texts in judge for t in texts])
        y = np.repeat([1, 0], [len(t) for t in judge])
        self.calibration = Calibration(x, y, np.repeat([n / len(t) for n, t in zip(counts, judge, strict=True)], [len(t) for t in judge]))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        difference = Difference(*self.dictionaries, self.common)
        return np.clip(self.calibration(np.array([difference(t) for t in texts], float)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | float:
    """A model, or the one score that all texts have."""
    spark = docs.sparkSession
    q = F.col("quality")
    one = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min(q).alias("quality"), F.max(q).alias("other")).filter("quality = other")
    known = one.filter(remainder(F.col("doc_id")) != 0).join(docs.select("doc_id").distinct(), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64(F.lit("quality sample"), "doc_id").alias("draw"))
    known = H.settle(known, "known")
    counts = dict(map(tuple, known.groupBy("quality").count().collect()))
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    # Under these bounds are several times as many rows of a label as are drawn, so that the windows are small.
    below = spark.createDataFrame([(k, -(2**63) + min(2**64 - 1, int(2**64 * (4 * per_label + 50) / n))) for k, n in counts.items()], "quality int, bound long")
    place = F.row_number().over(Window.partitionBy("quality").orderBy("draw", "doc_id"))
    drawn = known.join(F.broadcast(below), "quality").filter("draw <= bound").withColumn("place", place).filter(F.col("place") <= per_label).select(F.col("doc_id").alias("id"), "quality", "draw")
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).filter((F.octet_length("text") > 0) & (F.octet_length("text") <= LONGEST))
    sample = H.settle(texts.groupBy("id", "quality", "draw").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "quality", "draw", "t.text"), "sample")
    chosen, used = [], {0: 0, 1: 0}
    for r in sorted(map(tuple, sample.select("draw", "id", "quality", F.octet_length("text")).collect())):  # per_label rows a label
        used[r[2]] += r[3]
        if used[r[2]] <= CLASS_BYTES:
            chosen.append(r[1])
    got: dict[int, list[tuple]] = {0: [], 1: []}
    for r in sample.filter(F.col("id").isin(chosen)).select("quality", "draw", "text").collect() if chosen else []:
        got[r[0]].append((r[1], r[2].encode()))
    H.remove(known, sample)
    if not got[0] or not got[1]:
        return counts[1] / (counts[0] + counts[1])
    good, bad = (list(dict.fromkeys(t for _, t in sorted(got[k]))) for k in (1, 0))  # copies count once
    return Model(good, bad, (counts[1], counts[0]))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its text alone."""
    rows = H.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    if isinstance(model, float):
        scored = rows.select("doc_id", "held_out", F.lit(model).alias("score"))
    else:

        def run(batches):
            for batch in batches:
                texts = batch.column(2).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(texts), pa.float64())], names=["doc_id", "held_out", "score"])

        scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
