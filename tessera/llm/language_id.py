"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside the family.

Features of a whole text: counts of hashed byte trigrams of its letters (folded to lower case, every run of other
characters one space), square-rooted and scaled to length one. A linear SVM per language family (one against the
rest) chooses the family; inside it, every pair of languages has a linear SVM of its own, and the language with
most pair wins (then the larger sum of margins, then the smaller code point order) is predicted. Closely related
languages are thus told apart by models that saw only these languages.

The models are fitted on the driver on a sample bounded by `PER_LANGUAGE` rows a language and `ROWS` in all (both
documented parameters: of each language the rows of least hash of doc_id over all rows, so that the sample depends
on the rows alone and not on how they lie in files; of more than `ROWS` values of lang, those with most rows).
Prediction reads the text only.

Families come from FAMILIES; a language that isn't listed is a family of its own.

Defined results: lang_pred is `und` with score 0 where text is null or has no letter, or where there is no
labelled row to learn from. Rows with a null doc_id are predicted and never learned from. Equal texts get equal
predictions. One learned language: it is predicted with score 1. Other columns are ignored.

`keep_identified` also measures the fit: the mean log ratio, over a text's trigrams, of their share in the learned
languages (mixed in equal parts) to a uniform one. Below `floor` no learned language fits, however many families
there are. The floor is 0, or lower where the lowest hundredth of the labelled rows, each measured without itself,
lies lower; with too few of them, or for texts of fewer than `JUDGED` trigrams, nothing is rejected by it. A text
below the floor is measured again without its words that hold a digit (keys, addresses and numbers belong to no
language), each other word weighing the same however long, and stays if that fits or is short; it goes if no letter
is left.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as H

BITS = 13
PER_LANGUAGE = 300
ROWS = 2_400
UNKNOWN = "und"
#: Texts of fewer trigrams are too short to say that no language fits; so many labelled rows at least set the floor.
JUDGED, CALIBRATED = 20, 20

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "uz"],
    "uralic": ["et", "fi", "hu"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}

_CODED, _LETTER = re.compile(rb"\S*[0-9]\S*"), re.compile(rb"[A-Za-z\x80-\xff]")

_FOLD = np.full(256, 32, np.uint8)  # letters of ASCII folded, bytes of longer characters kept, the rest spaces
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def folded(raw: bytes) -> np.ndarray:
    """The bytes of a text with letters in lower case, every run of other characters one space, a space at either end."""
    b = _FOLD[np.frombuffer(raw, np.uint8)]
    upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)) + 1  # Latin-1 capitals in UTF-8
    b[upper] += 0x20
    if len(b):
        b = b[~((b == 32) & np.concatenate(([True], b[:-1] == 32)))]
    return np.concatenate(([32], b, [32])).astype(np.uint32)


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed byte trigrams of a text, one for each place."""
    return _hashed(folded(raw))


def _hashed(b: np.ndarray) -> np.ndarray:
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def features(raw: bytes) -> np.ndarray:
    x = np.sqrt(np.bincount(trigrams(raw), minlength=1 << BITS)).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, steps: int = 80) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient descent; y is +1 or -1, classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v, t = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), 1.0
    rate = 1 / (2 * 2.0 + lam)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = -2 * weight * y * slack
        grad = np.append(x.T @ pull, pull.sum()).astype(np.float32)
        grad[:-1] += lam * v[:-1]
        nxt = v - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = nxt + np.float32((t - 1) / t2) * (nxt - w)
        w, t = nxt, t2
    return w[:-1], float(w[-1])


class Model:
    """Families, languages, and the weights of all SVMs as columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(k) for k in self.langs})
        self.members = {f: [k for k in self.langs if family(k) == f] for f in self.families}
        lab, fam = np.array(langs, object), np.array([family(k) for k in langs], object)
        self.keys: list[tuple] = []
        w, b = [], []
        todo: list[tuple] = [("family", f) for f in self.families] if len(self.families) > 1 else []
        todo += [("pair", p, q) for f in self.families for p, q in combinations(self.members[f], 2)]
        for key in todo:
            rows = np.ones(len(lab), bool) if key[0] == "family" else (lab == key[1]) | (lab == key[2])
            y = np.where((fam if key[0] == "family" else lab)[rows] == key[1], 1.0, -1.0).astype(np.float32)
            wk, bk = fit_svm(x if rows.all() else x[rows], y)
            self.keys.append(key)
            w.append(wk)
            b.append(bk)
        self.w = np.stack(w, 1) if w else np.zeros((1 << BITS, 0), np.float32)
        self.b = np.array(b, np.float32)
        self.odds, self.floor = np.zeros(1 << BITS, np.float32), -np.inf

    def calibrate(self, langs: list[str], idx: list[np.ndarray], cnt: list[np.ndarray]) -> None:
        """Set odds and floor from the labelled rows: language, trigrams and their counts."""
        place = {k: i for i, k in enumerate(self.langs)}
        seen = np.zeros((len(place), 1 << BITS))
        for k, i, n in zip(langs, idx, cnt, strict=True):
            seen[place[k], i] += n
        total = seen.sum(1, keepdims=True)
        mixed = lambda c, t: np.log(((c + 0.5) / (t + 0.5 * (1 << BITS))).mean(0) * (1 << BITS))
        self.odds = mixed(seen, total).astype(np.float32)
        fits = []
        for k, i, n in zip(langs, idx, cnt, strict=True):
            if n.sum() < JUDGED:
                continue
            c, t = seen[:, i], total.copy()
            c[place[k]] -= n
            t[place[k]] -= n.sum()
            fits.append(float(n @ mixed(c, t) / n.sum()))
        if len(fits) >= CALIBRATED:
            self.floor = min(0.0, float(np.quantile(fits, 0.01)))

    def fits(self, raw: bytes) -> bool:
        at = trigrams(raw)
        if len(at) < JUDGED or float(self.odds[at].mean()) >= self.floor:
            return True
        rest = _CODED.sub(b" ", raw)
        if not _LETTER.search(rest):
            return False
        b = folded(rest)
        at, inside = _hashed(b), b[1:-1] != 32
        word = np.cumsum(~inside)[inside]
        many, sums = np.bincount(word), np.bincount(word, self.odds[at[inside]])
        return len(at) < JUDGED or float((sums[many > 0] / many[many > 0]).mean()) >= self.floor

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        at = dict(zip(self.keys, margins.tolist(), strict=True))
        sure = lambda z: 1 / (1 + np.exp(-4 * z))
        score, fam = 1.0, self.families[0]
        if len(self.families) > 1:
            fam = max(self.families, key=lambda f: at["family", f])
            score = sure(at["family", fam])
        langs = self.members[fam]
        wins, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for p, q in combinations(langs, 2):
            z = at["pair", p, q]
            wins[p if z >= 0 else q] += 1
            sums[p] += z
            sums[q] -= z
        best = max(langs, key=lambda k: (wins[k], sums[k]))
        if len(langs) > 1:
            score *= min(sure(at["pair", p, q] * (1 if p == best else -1)) for p, q in combinations(langs, 2) if best in (p, q))
        return best, float(min(1.0, max(0.0, score)))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sparse(batches):
    for batch in batches:
        idx, cnt = [], []
        for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
            i, n = np.unique(trigrams(raw), return_counts=True)
            idx.append(i.astype(np.int32))
            cnt.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], names=["lang", "idx", "cnt"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Model | None:
    """Learn from labelled rows that aren't held out: a sample by hash of doc_id, at most `rows` of them."""
    known = H.in_small_batches(docs).filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 2))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows)  # the languages with most rows
    counts = [(r["lang"], r["n"]) for r in counts.collect()]
    if not counts:
        return None
    each = max(1, min(per_language, rows // len(counts)))
    # The `each` rows of least hash of each language: first all under a bound that leaves several times as many.
    below = [(k, -(2**63) + min(2**64 - 1, int(2**64 * (4 * each + 50) / n))) for k, n in counts]
    bounds = docs.sparkSession.createDataFrame(below, "lang string, bound long")
    drawn = known.withColumn("draw", F.xxhash64(F.lit("language sample"), "doc_id")).join(F.broadcast(bounds), "lang").filter(F.col("draw") <= F.col("bound")).filter(has_letter(F.col("text")))
    least = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"), "text")
    sample = drawn.select("lang", "draw", "text").withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= each).select("lang", "text")
    got = sample.mapInArrow(_sparse, "lang string, idx array<int>, cnt array<int>").toArrow()
    if not len(got):
        return None
    got = got.combine_chunks()
    langs = got["lang"].to_pylist()
    idx, cnt = ([v.values.to_numpy() for v in got[c]] for c in ("idx", "cnt"))  # views of the counts as they came
    order = sorted(range(len(langs)), key=lambda i: (langs[i], idx[i].tobytes(), cnt[i].tobytes()))  # arrival doesn't matter
    x = np.zeros((len(order), 1 << BITS), np.float32)
    for i, k in enumerate(order):
        x[i, idx[k]] = np.sqrt(cnt[k])
        x[i] /= max(float(np.linalg.norm(x[i])), 1e-9)
    model = Model(x, [langs[k] for k in order])
    model.calibrate(*([c[k] for k in order] for c in (langs, idx, cnt)))
    return model


def _predictor(model: Model, text_of, letters_at: int, keep: list[int], names: list[str], reject: bool = False):
    def run(batches):
        for batch in batches:
            lang, score = [], []
            ok = batch.column(letters_at)
            for raw, letters in zip(text_of(batch).cast(pa.large_binary()), ok, strict=True):
                if not letters.as_py() or (reject and not model.fits(raw.as_py())):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                k, s = model.predict(features(raw.as_py()) @ model.w + model.b)
                lang.append(k)
                score.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone."""
    base = H.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text", has_letter(F.col("text")).alias("letters"))
    if model is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    run = _predictor(model, lambda batch: batch.column(2), 3, [0, 1], ["doc_id", "held_out", "lang_pred", "score"])
    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """Rows of docs that a learned language fits and whose language is identified with a score of `least` or more; columns stay as they are."""
    docs = H.in_small_batches(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), has_letter(F.col("text")).alias("letters"))
    if model is None:
        return docs.limit(0)
    row_type = packed.schema["row"].dataType.simpleString()
    at = docs.columns.index("text")
    run = _predictor(model, lambda batch: batch.column(0).field(at), 1, [0], ["row", "lang_pred", "score"], reject=True)
    seen = packed.mapInArrow(run, f"row {row_type}, lang_pred string, score double")
    return seen.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
