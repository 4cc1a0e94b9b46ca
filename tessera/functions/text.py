"""Text functions: identifiers, names, lexical analysis, framed ids, line windows."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- names


def is_dotted(name: Column) -> Column:
    """An ASCII dotted identifier."""
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")


def is_distinctive(name: Column) -> Column:
    """An underscore inside, or two or more capitals with a lower-case letter: not an everyday word."""
    inner = name.rlike("[^_]_+[^_]")
    capitals = F.length(F.regexp_replace(name, "[^A-Z]", ""))
    return inner | ((capitals >= 2) & name.rlike("[a-z]"))


def normal_name(name: Column) -> Column:
    """Distribution name: lower case, runs of - _ . as one hyphen."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def identifiers(text: Column) -> Column:
    """All dotted ASCII identifiers in order."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), 1)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("name", T.StringType())]))


_IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*")
SPAN_BYTES = 1 << 20  # of text that is cut at a time


def _spans_of(texts: pa.Array) -> pa.Array:
    kinds = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string())])
    start, stop, name, sizes = array("i"), array("i"), [], []
    for t in texts.cast(pa.binary()).to_pylist():
        if t is None:
            sizes.append(None)
            continue
        before = len(name)
        for m in _IDENTIFIER.finditer(t):
            start.append(m.start())
            stop.append(m.end())
            name.append(m[0])
        sizes.append(len(name) - before)
    offsets = pa.array(np.cumsum([0, *[n or 0 for n in sizes]]), pa.int32())
    items = pa.StructArray.from_arrays([pa.array(np.array(start, "i4")), pa.array(np.array(stop, "i4")), pa.array(name, pa.binary()).cast(pa.string())], fields=list(kinds))
    return pa.ListArray.from_arrays(offsets, items, mask=pa.array([n is None for n in sizes], pa.bool_()))


@F.arrow_udf(_SPANS)
def identifier_spans(text: pa.Array) -> pa.Array:
    """Dotted identifiers with byte offsets [start, stop) in UTF-8; offsets have no JVM expression.

    Spans are Arrow columns, and Python has objects of a megabyte of text at a time, however long a batch is.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) // SPAN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(text)]
    return pa.concat_arrays([_spans_of(text.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])


def analyzed(text: Column) -> Column:
    """Search terms: split where the character class or the case changes, lower-cased."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def instructed(query: Column, task: str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


# ---------------------------------------------------------------- identity


def framed(*fields: Column) -> Column:
    """Fields as text, each behind its length, so that no two lists of fields give one string."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.when(f.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s, F.lit(";"))))
    return F.concat(*parts)


def framed_id(tag: str, *fields: Column) -> Column:
    """128-bit id in hex of a tagged, framed key."""
    return F.substring(F.sha2(F.concat(F.lit(f"{len(tag)}:{tag};"), framed(*fields)), 256), 1, 32)


def content_id(content: Column) -> Column:
    return F.sha2(content, 256)


# ---------------------------------------------------------------- windows


def line_windows(text: str, cap: int) -> Iterator[str]:
    """Whole lines up to `cap` bytes a window; longer lines are cut between characters; the pieces add up to text."""
    if cap < 4:
        raise ValueError("a window must hold the longest character: cap is 4 bytes at least")
    held, size, any_ = [], 0, False
    for line in _lines(text):
        n = len(line.encode())
        if held and size + n > cap:
            yield "".join(held)
            held, size, any_ = [], 0, True
        if n <= cap:
            held.append(line)
            size += n
            continue
        piece, width = [], 0
        for ch in line:
            w = len(ch.encode())
            if width + w > cap:
                yield "".join(piece)
                any_ = True
                piece, width = [], 0
            piece.append(ch)
            width += w
        held, size = ["".join(piece)], width
    if held or not any_:
        yield "".join(held)


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def windows_udf(cap: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else list(line_windows(t, cap)))

    return cut


# ---------------------------------------------------------------- paths and values


def path_relation(path: Column, other: Column) -> Column:
    """rest: other starts with path; shorter: path starts with other; disjoint; unknown where one is null."""
    n = F.least(F.size(path), F.size(other))
    same = F.slice(path, 1, n) == F.slice(other, 1, n)
    return (
        F.when(path.isNull() | other.isNull(), "unknown").when(n == 0, F.when(F.size(path) <= F.size(other), "rest").otherwise("shorter"))
        .when(same & (F.size(path) <= F.size(other)), "rest").when(same, "shorter").otherwise("disjoint")
    )


def finite(value: Column) -> Column:
    """The value with one zero; refuses NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error("not finite").cast("double")).otherwise(value + F.lit(0.0))


#: The grammar of dependency lines (PEP 508), markers without their nesting.
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
_EXTRAS = rf"\[\s*(?:{_NAME}\s*(?:,\s*{_NAME}\s*)*)?\]"
_VERSION = r"(?:===|~=|==|!=|<=|>=|<|>)\s*[A-Za-z0-9._*+!-]+"
_VERSIONS = rf"{_VERSION}\s*(?:,\s*{_VERSION}\s*)*,?"
_MARKER_VALUE = r"(?:python_version|python_full_version|os_name|sys_platform|platform_release|platform_system|platform_version|platform_machine|platform_python_implementation|implementation_name|implementation_version|extra|'[^']*'|\"[^\"]*\")"
_MARKER_TEST = rf"[\s(]*{_MARKER_VALUE}\s*(?:===|~=|==|!=|<=|>=|<|>|not\s+in\b|in\b)\s*{_MARKER_VALUE}[\s)]*"
_MARKER = rf"{_MARKER_TEST}(?:\b(?:and|or)\b{_MARKER_TEST})*"
_REQUIREMENT = rf"^\s*({_NAME})\s*({_EXTRAS})?\s*(?:@\s*([^\s;]\S*)(?:\s+|$)|({_VERSIONS}|\(\s*{_VERSIONS}\s*\))?\s*)(?:;\s*({_MARKER}))?$"


def parsed_requirement(text: Column) -> Column:
    """name, extras, url, specifier, marker and error of a dependency line; a line outside the grammar has an error and nothing else.

    Of a marker's parentheses only the numbers are compared. An url ends at white space.
    """
    whole = F.coalesce(text.rlike(_REQUIREMENT), F.lit(False))
    part = lambda i: F.trim(F.regexp_extract(text, _REQUIREMENT, i))
    marker = part(5)
    bare = F.regexp_replace(marker, "'[^']*'|\"[^\"]*\"", "")
    paired = F.length(F.regexp_replace(bare, "[^(]", "")) == F.length(F.regexp_replace(bare, "[^)]", ""))
    names = F.filter(F.split(F.regexp_replace(part(2), r"[\[\]\s]", ""), ","), lambda x: x != "")
    spec = F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(part(4), r"[()\s]", ""), ","), lambda x: x != "")), ",")
    ok = whole & paired
    keep = lambda c, n: F.when(ok, c).alias(n)
    return F.struct(
        keep(normal_name(part(1)), "name"), keep(F.array_join(F.array_sort(F.array_distinct(F.transform(names, normal_name))), ","), "extras"), keep(part(3), "url"), keep(spec, "specifier"), keep(marker, "marker"),
        F.when(text.isNotNull() & ~ok, "invalid").alias("error"),
    )
