"""Vector expressions in double precision over array columns; all inside the JVM."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: Spark computes a higher-order function anew wherever it is named."""
    return F.transform(F.array(value), use)[0]


def norm(v: Column) -> Column:
    """Euclidean norm; null for empty, zero and non-finite vectors."""
    return _once(dot(v, v), lambda s: F.when((F.size(v) > 0) & (s > 0) & ~F.isnan(s) & (s < float("inf")), F.sqrt(s)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows, summed in order of position as `dot` does, so that equal vectors score equally."""
    out = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        out += x[i] * y[j]
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    every = np.arange(len(x))
    return np.sqrt(_dots(x, x, every, every))


PIECE, MARGIN = 2_048, 1e-9  # rows a side of a product; how far a product may be off the sum in order


def closest(q, t, qid, tid, k=None, floor=-np.inf, ask=None, rank=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in q, places in t, cosines) of pairs of unlike ids: per query the k best (all, if None) of a cosine of floor or more.

    Vectors are valid ones of one length; rank is the order of tid, which decides ties, unless t is in that order; floor may be one a query. ask(slice of q, slice of t)
    limits what is met: (places in the slice of q, which of these meet which of t, or None for all). Matrix products nominate with a margin, sums in order decide.
    """
    qn, tn = _norms(q), _norms(t)
    floor, out = np.broadcast_to(np.asarray(floor, float), len(q)), []
    for a in range(0, len(q), PIECE):
        part = slice(a, a + PIECE)
        unit, least = q[part] / qn[part, None], floor[part].copy()
        every, parts = np.arange(len(unit)), []
        got = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
        for b in range(0, len(t), PIECE):
            here = slice(b, b + PIECE)
            on, mask = (every, None) if ask is None else ask(part, here)
            if not len(on):
                continue
            near = unit[on] @ (t[here] / tn[here, None]).T
            near[qid[part][on, None] == tid[None, here]] = -np.inf
            if mask is not None:
                near[~mask] = -np.inf
            need = least[on]
            if k is not None and near.shape[1] > k:
                open_ = np.isneginf(need)
                if open_.any():
                    need[open_] = np.partition(near[open_], -k, axis=1)[:, -k]
            i, j = np.nonzero((near >= need[:, None] - MARGIN) & ~np.isneginf(near))
            i, j = on[i] + a, j + b
            s = _dots(q, t, i, j) / (qn[i] * tn[j])
            keep = s >= floor[i]
            found = i[keep].astype(np.int32), j[keep].astype(np.int32), s[keep]
            if k is None:
                parts.append(found)
                continue
            got = tuple(np.concatenate([x, y]) for x, y in zip(got, found, strict=True))
            order = np.lexsort((got[1] if rank is None else rank[got[1]], -got[2], got[0]))
            i, j, s = (x[order] for x in got)
            first = np.searchsorted(i, i)
            place = np.arange(len(i)) - first
            kept = place < k
            last = place == k - 1
            least[i[last] - a] = np.maximum(least[i[last] - a], s[last])
            got = i[kept], j[kept], s[kept]
        out += parts or [got]
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_by_groups(q, t, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in t, cosine) for each two groups, of which the places are the first: their best cosine. Rows are in order of their groups a and b; as in `closest`, sums decide."""
    qn, tn = _norms(q), _norms(t)
    _, q_first, qa = np.unique(a, return_index=True, return_inverse=True)
    _, t_first, tb = np.unique(b, return_index=True, return_inverse=True)
    near_best, best = (np.full((len(q_first), len(t_first)), -np.inf) for _ in range(2))
    starts = lambda code: np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    for sure in (False, True):
        for x in range(0, len(q), PIECE):
            for y in range(0, len(t), PIECE):
                at, to = qa[x : x + PIECE], tb[y : y + PIECE]
                near = (q[x : x + PIECE] / qn[x : x + PIECE, None]) @ (t[y : y + PIECE] / tn[y : y + PIECE, None]).T
                if not sure:
                    here = np.ix_(at[starts(at)], to[starts(to)])
                    most = np.maximum.reduceat(np.maximum.reduceat(near, starts(to), axis=1), starts(at), axis=0)
                    near_best[here] = np.maximum(near_best[here], most)
                else:
                    i, j = np.nonzero(near >= near_best[at][:, to] - MARGIN)
                    i, j = i + x, j + y
                    np.maximum.at(best, (qa[i], tb[j]), _dots(q, t, i, j) / (qn[i] * tn[j]))
    i, j = np.nonzero(best > -np.inf)
    return q_first[i], t_first[j], best[i, j]


def matrix(column) -> np.ndarray:
    """An Arrow column of valid vectors of one length, in double precision."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def project_prefix(v: Column, dimensions: int) -> Column:
    """The first components, at unit length, each rounded to single precision once."""
    head = F.slice(v, 1, dimensions)
    return _once(norm(head), lambda n: F.transform(head, lambda x: (x.cast("double") / n).cast("float")))


def is_unit(v: Column, dimensions: int, within: float = 1e-3) -> Column:
    """The vector has the dimensions, finite components and unit length."""
    return (F.size(v) == dimensions) & ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (F.abs(norm(v) - 1) < within)


def centroid_parts(v: Column) -> Column:
    """(pos, val) rows for a mean by position."""
    return F.posexplode(v)


def encoded(v: Column) -> Column:
    """A vector as little-endian bytes of single precision, four a component; null stays null, non-finite ones are refused."""
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            a = np.asarray(x, "<f4")
            if not np.isfinite(a).all():
                raise ValueError("a vector's components are finite")
            return a.tobytes()

        return rows.map(one)

    return run(v)


def decoded(b: Column) -> Column:
    """The vector of such bytes; a length that is no multiple of four is refused."""
    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if len(x) % struct.calcsize("<f"):
                raise ValueError("not whole components")
            return np.frombuffer(x, "<f4")

        return rows.map(one)

    return run(b)
