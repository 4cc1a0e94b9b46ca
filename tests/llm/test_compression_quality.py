"""The compression classifier: held-out accuracy, scores against a plain loop, calibration, edges."""

import os
import random

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import compression_quality as Q  # noqa: E402
from tessera.llm import queries, shared  # noqa: E402

KIND = "doc_id long, text string, lang string, score int, predicted string"


def some_docs(seed, n=600):
    """Good ones are prose, bad ones shout."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "do", "ki", "lu", "me", "nor", "st"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        q = 0 if r.random() < 0.2 else 1
        ws = [r.choice(words) for _ in range(r.randint(5, 80))]
        rows.append((i, " ".join(ws) + "." if q else " ".join(w.upper() + "!!" for w in ws), q))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, "x") for d, t, _ in rows], KIND).repartition(3), spark.createDataFrame([(d, q, 0) for d, _, q in rows if q is not None], "doc_id long, quality int, toxic int")


def test_learned_scores(spark):
    rows = some_docs(1)
    docs, labels = frames(spark, rows)
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    quality = {d: q for d, _, q in rows}
    held = [r for r in got.values() if r.held_out]
    assert len(got) == len(rows) and 60 < len(held) < 180 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.97
    # The same by a loop over whole texts and blocks.
    import zstandard

    packs = []
    for raw in model.dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=3)
        packs.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    for doc_id, text, _ in rows[:40]:
        raw = text.encode()
        good, bad = (sum(len(p.compress(raw[i : i + 512])) for i in range(0, len(raw), 512)) for p in packs)
        assert got[doc_id].score == pytest.approx(float(np.clip(model.calibration(np.array([(bad - good + 128 * model.common) / (len(raw) + 128)])), 0, 1)[0]))
    again = Q.fit(docs.repartition(5), labels.repartition(2))
    assert again.dictionaries == model.dictionaries and (again.calibration.p == model.calibration.p).all()


def test_whole_texts_count(spark):
    """Bad text behind much good text moves the score, however far back it stands."""
    rows = some_docs(2)
    model = Q.fit(*frames(spark, rows))
    good, bad = (" ".join(t for _, t, q in rows if q == k).encode() for k in (1, 0))
    a, b, c = model.scores([good * 8, good * 8 + bad * 60, bad * 60])
    d = Q.Difference(*model.dictionaries)
    assert a > c and d(good * 8) > d(good * 8 + bad * 60) > d(bad * 60) and b <= a


def test_short_texts_show_little(spark):
    """A few bytes more or less decide nothing: short texts stay near the common difference, long ones have their own."""
    model = Q.fit(*frames(spark, some_docs(2)))
    empty, short = model.scores([b"", b"Ba."])
    assert empty == model.scores([b""])[0] and short >= 0.3 and empty >= 0.3
    d = Q.Difference(*model.dictionaries, model.common)
    assert d(b"") == pytest.approx(model.common)


def test_held_out_rows_and_other_columns_are_not_learned_from(spark):
    rows = some_docs(3)
    docs, labels = frames(spark, rows)
    turned = labels.withColumn("quality", Q.F.when(Q.remainder(Q.F.col("doc_id")) == 0, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality"))).withColumn("toxic", Q.F.lit(1))
    assert Q.fit(docs, turned).dictionaries == Q.fit(docs.withColumn("lang", Q.F.lit(None).cast("string")), labels).dictionaries


def test_calibration_rises_and_agrees_with_rates():
    r = np.random.default_rng(4)
    x = np.concatenate((r.normal(1, 1, 3000), r.normal(-1, 1, 1000)))
    y = np.repeat([1, 0], [3000, 1000])
    c = Q.Calibration(x, y, np.repeat([1.0, 3.0], [3000, 1000]))  # weighed so that both are as many
    at = np.linspace(-4, 4, 400)
    p = c(at)
    assert (np.diff(p) > 0).all() and p.min() >= 0 and p.max() <= 1
    assert abs(p[np.searchsorted(at, 0.0)] - 0.5) < 0.06 and abs(c(np.array([0.5]))[0] - 1 / (1 + np.exp(-1.0))) < 0.08


def test_quality_edges(spark):
    docs, labels = frames(spark, [(1, None, 1), (2, "", 0), (None, "x", None), (3, "a" * 300_000, 1), (3, "b", None)])
    got = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels.limit(0))).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (4, None), (7, 3)], "doc_id long, quality int")
    some = spark.createDataFrame([(i, f"text {i}", "en", 1, "x") for i in range(20)], KIND)
    assert {(r.score, r.predicted) for r in Q.score(some, Q.fit(some, ones)).collect()} == {(1.0, 1)}
    assert Q.score(docs.limit(0), Q.fit(docs.limit(0), labels)).count() == 0
    both = spark.createDataFrame([(i, q) for i in range(20) for q in (0, 1)], "doc_id long, quality int")
    assert Q.fit(some, both) == 0.5  # two labels of one document say nothing
    few = Q.score(some, Q.fit(some, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))).collect()
    assert len(few) == 20 and all(0 <= r.score <= 1 for r in few)


def test_quality_of_the_table(spark, sf):
    where = sf.replace("sf0.001", "sf0.01")
    if not os.path.exists(where):
        pytest.skip("the larger table isn't here")
    got = queries.op11_compression_quality(spark, where).collect()
    labels = {r.doc_id: r.quality for r in shared.table(spark, where, "labels").collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == shared.table(spark, where, "documents").count()
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.93
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) >= 0.98
    assert np.mean([1 - r.predicted for r in held if labels[r.doc_id] == 0]) >= 0.8
