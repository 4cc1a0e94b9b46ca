"""Phrase collocations against a brute-force version, by both ways of counting, and the minimal perfect hash."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import collocations, queries  # noqa: E402


def brute(rows, least, longest, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out, cands = [], {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    holders = {}
    for (lang, ph), c in cands.items():
        for k in range(2, len(ph)):
            for i in range(len(ph) - k + 1):
                key = (lang, ph[i : i + k])
                holders[key] = max(holders.get(key, 0), c)
    for (lang, ph), a in cands.items():
        if holders.get((lang, ph), 0) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ph[:i]] * f[lang, ph[i:]]), i) for i in range(1, len(ph))]
        score, i = min(cuts)
        out.append((lang, " ".join(ph), a, f[lang, ph[:i]], f[lang, ph[i:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, got = Counter(), []
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            got.append((x[0], rank[x[0]], *x[1:]))
    return got


LONG = ["é" * 9, "abcdefgh" * 3 + "x", "abcdefgh" * 3 + "y", "w" * 600, "w" * 601, "a", "B", "b", "Ü", "\x01", "naïve", "abcdefgh", "日本語の単語です"]


def some_rows(seed, n=80):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [r.choice(LONG) for _ in range(r.randint(0, 60))]
        rows.append((r.choice(["en", "de", None, "und"]), "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for w in words)))
    return [*rows, ("en", None), ("en", ""), (None, " \t "), *[("en", "The quick brown fox. The Quick brown fox")] * 7]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_random(spark, seed, monkeypatch):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(i, t, g, 1, 2) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, score int, word int").repartition(5)
    for top in (7, 2_000):
        want = brute(rows, 6, 5, top)
        assert want and [tuple(x) for x in collocations.collocations(docs, least=6, top=top).orderBy("lang", "rank").collect()] == want
    assert [tuple(x) for x in collocations.collocations(docs, least=6, most=3).orderBy("lang", "rank").collect()] == want  # by the shuffle


def test_collocations_of_texts_cut_anywhere():
    """Long texts are cut into stretches between words; pieces and words go on as if they weren't."""
    r = random.Random(5)
    texts = ["".join(r.choice(["word ", "Wörter ", "a", ". ", "\t", ",", "x" * 40, ""]) for _ in range(r.randint(0, 200))).encode() for _ in range(20)] + [b"", b"", b"z"]
    edge = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    seen = {}
    for piece in (1 << 22, 64, 7):
        collocations.PIECE, was = piece, collocations.PIECE
        try:
            got = [(int(f + w.lo), int(s), bool(n), int(x)) for w in collocations.stretches(data, edge) for f, s, n, x in zip(w.first, w.size, w.new, w.name, strict=True)]
        finally:
            collocations.PIECE = was
        seen[piece] = got
    assert seen[64] == seen[7] == seen[1 << 22]
    assert len({(x[3]) for x in seen[7]}) == len({data[f : f + s].tobytes().lower() for f, s, _, _ in seen[7]})


def test_slots_are_minimal_and_refuse_strangers():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 62, 50_000).astype(np.uint64))
    slots = collocations.Slots(keys)
    at = slots.find(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (slots.keys[at] == keys).all()
    assert (slots.find(keys + np.uint64(1 << 63)) == -1).all()
    assert len(collocations.Slots(keys[:0])) == 0 and (collocations.Slots(keys[:0]).find(keys[:5]) == -1).all()


def test_counts_are_summed_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FAN", 2)
    monkeypatch.setattr(collocations, "BLOCK", 4)
    rows = [(None, b, p, [p + b] * (4 if b < 2 else 1)) for p in range(9) for b in range(3)]
    got = collocations.tree_sum(spark.createDataFrame(rows, collocations._COUNTED), 9)
    assert got.tolist() == [36] * 4 + [45] * 4 + [54]


def test_products_beyond_64_bits():
    """a n 1000 passes 2^63: scores stay exact."""
    import pyarrow as pa

    one = collocations.Level(None, np.array([3 * 10**12, 7 * 10**12]), None)
    two = collocations.Level(np.array([1], np.uint64), np.array([2 * 10**12 + 1]), one)
    shared = type("B", (), {"value": ([one, two], pa.array(["x", "y"]), pa.array(["en", "en"]), {"en": 10**13 + 7})})
    row = next(collocations._scores(shared, 100)(iter([pa.record_batch([pa.array([0], pa.int64())], names=["id"])]))).to_pylist()[0]
    assert row["phrase"] == "x y" and row["score"] == 1000 * (2 * 10**12 + 1) * (10**13 + 7) // (3 * 10**12 * 7 * 10**12)


def test_collocations_edges(spark):
    kind = "doc_id long, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], kind)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None, None), (1, "a b c", "en")], kind)).count() == 0
    got = collocations.collocations(spark.createDataFrame([(1, "a a " * 60, None)], kind)).collect()
    assert [(x.lang, x["rank"], x.phrase, x.a, x.n) for x in got] == [("und", 1, "a a", 119, 120), ("und", 2, "a a a", 118, 120), ("und", 3, "a a a a", 117, 120), ("und", 4, "a a a a a", 116, 120)]


def test_collocations_query(spark, sf, duck):
    got = sorted(map(tuple, queries.op13_phrase_collocations(spark, sf).collect()))
    assert got == sorted(duck.execute(queries.ORACLES["op13_phrase_collocations"]).fetchall())
