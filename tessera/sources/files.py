"""Connectors for source trees: inventories, package metadata, configuration, docstrings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


DETAIL = _rows(section=T.StringType(), field=T.StringType(), value=T.StringType())


def inventory(spark: SparkSession, root: str, glob: str = "*", content: bool = True) -> DataFrame:
    """One row per file below root: path (relative), content, byte_len, content_id. Content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1]
    out = files.select(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.lit("^" + base + "/"), F.lit("")).alias("path"), F.col("length").alias("byte_len"), *(["content"] if content else []))
    return out.withColumn("content_id", F.sha2("content", 256)) if content else out


def corpus(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """Documents that any of the globs selects, once each."""
    parts = [inventory(spark, root, g) for g in globs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path"])


@F.pandas_udf(DETAIL)
def header_fields(content: pd.Series) -> pd.Series:
    """Mail-style metadata headers; a body becomes the field Description. Lines that are no header are skipped."""
    from email.parser import Parser

    def rows(b):
        if b is None:
            return None
        m = Parser().parsestr(bytes(b).decode("utf-8", "replace"))
        out = [("metadata", k, v) for k, v in m.items()]
        body = m.get_payload()
        return out + ([("metadata", "Description", body)] if isinstance(body, str) and body.strip() else [])

    return content.map(rows)


@F.pandas_udf(DETAIL)
def ini_entries(content: pd.Series) -> pd.Series:
    """Entry points: one row per line of each group; a malformed file gives one row of section `error`."""
    import configparser

    def rows(b):
        if b is None:
            return None
        p = configparser.ConfigParser(delimiters=("=",), strict=False, interpolation=None)
        p.optionxform = str
        try:
            p.read_string(bytes(b).decode("utf-8", "replace"))
        except configparser.Error as e:
            return [("error", type(e).__name__, str(e))]
        return [(s, k, v) for s in p.sections() for k, v in p.items(s)]

    return content.map(rows)


@F.pandas_udf(DETAIL)
def toml_fields(content: pd.Series) -> pd.Series:
    """Leaves of a TOML file: section is the dotted table, value is JSON."""
    import json
    import tomllib

    def leaves(node, at):
        if isinstance(node, dict):
            for k, v in node.items():
                yield from leaves(v, [*at, k])
        else:
            yield ".".join(at[:-1]), at[-1], json.dumps(node, default=str, ensure_ascii=False)

    def rows(b):
        if b is None:
            return None
        try:
            return list(leaves(tomllib.loads(bytes(b).decode("utf-8", "replace")), []))
        except tomllib.TOMLDecodeError as e:
            return [("error", "TOMLDecodeError", str(e))]

    return content.map(rows)


@F.pandas_udf(_rows(name=T.StringType(), version=T.StringType(), needs=T.ArrayType(T.StringType())))
def lock_packages(content: pd.Series) -> pd.Series:
    """Packages of a lock file with their dependencies' names."""
    import tomllib

    def rows(b):
        if b is None:
            return None
        data = tomllib.loads(bytes(b).decode("utf-8", "replace"))
        out = []
        for p in data.get("package", []):
            needs = p.get("dependencies", [])
            names = list(needs) if isinstance(needs, dict) else [n["name"] if isinstance(n, dict) else str(n).split()[0] for n in needs]
            out.append((p["name"], p.get("version"), sorted(names)))
        return out

    return content.map(rows)


@F.pandas_udf(_rows(owner=T.StringType(), text=T.StringType(), start=T.IntegerType(), stop=T.IntegerType()))
def docstrings(content: pd.Series) -> pd.Series:
    """Docstrings of modules, classes and functions with the lines they span. Sources that don't parse give none."""
    import ast

    def walk(node, name):
        body = getattr(node, "body", [])
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and body:
            e = body[0]
            if isinstance(e, ast.Expr) and isinstance(e.value, ast.Constant) and isinstance(e.value.value, str):
                yield name, e.value.value, e.lineno, e.end_lineno
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                yield from walk(child, f"{name}.{child.name}" if name else child.name)

    def rows(b):
        if b is None:
            return None
        try:
            return list(walk(ast.parse(bytes(b)), ""))
        except (SyntaxError, ValueError):
            return []

    return content.map(rows)


def byte_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Original bytes of ranges (path, start, stop); a range outside its file is refused with the row's error."""
    joined = ranges.join(files.select("path", "content", "byte_len"), "path", "left")
    bad = F.col("content").isNull() | (F.col("start") < 0) | (F.col("stop") > F.col("byte_len")) | (F.col("start") > F.col("stop"))
    cut = F.when(~bad, F.substring(F.col("content"), F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")))
    return joined.select("path", "start", "stop", cut.alias("bytes"), F.when(bad, "outside").alias("error"))
