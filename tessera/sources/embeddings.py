"""Embedding requests and their cache: the network call is a parameter, everything around it is the engine's."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 128


def request_body(model: str, dimensions: int, texts: list[str]) -> bytes:
    return json.dumps({"model": model, "dimensions": dimensions, "input": texts}, ensure_ascii=False, separators=(",", ":")).encode()


def parse_response(body: bytes, n: int, dimensions: int, within: float = 1e-3) -> list[list[float]]:
    """Vectors of a response; a wrong count, dimension, order, value or length is an error, never a gap."""
    data = sorted(json.loads(body)["data"], key=lambda x: x["index"])
    if [x["index"] for x in data] != list(range(n)):
        raise ValueError("the response doesn't answer each text once")
    out = []
    for x in data:
        v = [float(y) for y in x["embedding"]]
        if len(v) != dimensions or not all(map(math.isfinite, v)):
            raise ValueError("a vector has the wrong dimensions or a value that isn't finite")
        if abs(math.sqrt(sum(y * y for y in v)) - 1) > within:
            raise ValueError("a vector isn't of unit length")
        out.append(v)
    return out


def embed(texts: DataFrame, call: Callable[[bytes], bytes], model: str, dimensions: int) -> DataFrame:
    """(key, vector) of texts (key, text), in batches; `call` sends a body and gives the response's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), BATCH):
                part = f.iloc[lo : lo + BATCH]
                got = parse_response(call(request_body(model, dimensions, part["text"].tolist())), len(part), dimensions)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": got})

    return texts.select("key", "text").mapInPandas(run, f"key {dict(texts.dtypes)['key']}, vector array<float>")


def winners(proposals: DataFrame) -> DataFrame:
    """The first valid proposal of each (spec, input) stays; proposals with other token receipts are refused by name.

    proposals: spec, input, sequence, vector, tokens.
    """
    first = proposals.groupBy("spec", "input").agg(F.min_by(F.struct("vector", "tokens"), "sequence").alias("w"), F.count_distinct("tokens").alias("receipts"))
    return first.select("spec", "input", F.col("w.vector").alias("vector"), F.col("w.tokens").alias("tokens"), F.when(F.col("receipts") > 1, "receipts_disagree").alias("error"))


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Inputs to ask for: those that the cache doesn't hold, once each."""
    return wanted.select("spec", "input").distinct().join(cache, ["spec", "input"], "left_anti")
