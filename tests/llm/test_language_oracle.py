"""Language identification recomputed in plain Python: features, a refit of every SVM in double precision, and each prediction."""

import math
import zlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import language_id as L  # noqa: E402
from tessera.llm import queries, shared  # noqa: E402


def counts(text):
    out, last = bytearray(b" "), 32
    raw = text.encode()
    for i, b in enumerate(raw):
        if 65 <= b <= 90:
            b += 32
        elif b < 128 and not 97 <= b <= 122:
            b = 32
        elif b >= 128 and i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            b += 32
        if b == 32 and last == 32:
            if i:
                continue
            last = 32
            continue
        out.append(b)
        last = b
    out.append(32)
    found = {}
    for i in range(len(out) - 2):
        h = ((out[i] << 16 | out[i + 1] << 8 | out[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 19
        found[h] = found.get(h, 0) + 1
    return found


def vector(text):
    x = np.zeros(1 << 13)
    for h, n in counts(text).items():
        x[h] = math.sqrt(n)
    return x / max(np.linalg.norm(x), 1e-9)


def refit(x, y, lam=1e-4):
    """The same objective by plain gradient descent with momentum, far longer, in double precision."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(400):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = -2 * weight * y * slack
        g = np.append(x.T @ pull + lam * v[:-1], pull.sum())
        nxt = v - g / (4 + lam)
        v, w = nxt + step / (step + 3) * (nxt - w), nxt
    return w


def test_predictions_of_the_table_by_a_plain_refit(spark, sf):
    docs = shared.table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.op3_language_id(spark, sf).collect()}
    learn = [r for r in docs if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text and any(c.isalpha() for c in r.text)]
    langs = [r.lang for r in learn]
    assert max(langs.count(k) for k in set(langs)) <= L.PER_LANGUAGE  # so that all of them are learned from
    x, names = np.stack([vector(r.text) for r in learn]), sorted(set(langs))
    of = {k: next((f for f, ks in L.FAMILIES.items() if k in ks), k) for k in names}
    families = sorted(set(of.values()))
    fam = {f: refit(x, np.array([1.0 if of[k] == f else -1.0 for k in langs])) for f in families} if len(families) > 1 else {}
    pairs = {}
    for i, p in enumerate(names):
        for q in names[i + 1 :]:
            if of[p] == of[q]:
                rows = np.array([k in (p, q) for k in langs])
                pairs[p, q] = refit(x[rows], np.array([1.0 if k == p else -1.0 for k in langs if k in (p, q)]))
    same = clear = 0
    for r in docs:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        v = np.append(vector(r.text), 1.0)
        best = max(families, key=lambda f: fam[f] @ v) if fam else families[0]
        mine = [k for k in names if of[k] == best]
        wins = dict.fromkeys(mine, 0)
        for (p, q), w in pairs.items():
            if p in wins:
                wins[p if w @ v >= 0 else q] += 1
        near = min([abs(w @ v) for w in fam.values()] + [abs(w @ v) for (p, _), w in pairs.items() if p in wins])
        clear += near > 0.15
        same += near > 0.15 and got[r.doc_id].lang_pred == max(mine, key=wins.get)
    assert clear > 0.7 * len(docs) and same == clear


@pytest.mark.parametrize("text", ["Hello, World!!  ÀÉÎß ñ 12 x", "", "...", "Ä", "日本 語", " a  b", "x1y2z3"])
def test_features_by_bytes(text):
    at = L.trigrams(text.encode())
    assert {int(k): int(n) for k, n in zip(*np.unique(at, return_counts=True), strict=True)} == counts(text)
