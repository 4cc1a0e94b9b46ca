"""Pages: keysets, cursors bound to their request, and packing under a byte limit."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.parts import ranked, running
from tessera.sources.sql import Refused

DEFAULT, MOST = 20, 100


def page(df: DataFrame, key: str, limit: int = DEFAULT, after=None) -> DataFrame:
    """The next rows by key, with how many come after them. The key filter reaches the scan."""
    limit = min(limit, MOST)
    rest = df.filter(F.col(key) > F.lit(after)) if after is not None else df
    head = rest.orderBy(key).limit(limit)
    return head.crossJoin(F.broadcast(rest.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))))


def nested_pages(df: DataFrame, parent: str, key: str, limit: int) -> DataFrame:
    """The first rows of each parent, with how many each leaves out."""
    w = Window.partitionBy(parent).orderBy(key)
    n = F.count("*").over(Window.partitionBy(parent))
    return df.withColumn("place", F.row_number().over(w)).withColumn("omitted", F.greatest(n - limit, F.lit(0))).filter(F.col("place") <= limit)


def packed(df: DataFrame, order: list[Column], size: Column, limit: int) -> DataFrame:
    """Rows in order while their sizes add up to the limit at most."""
    return running(df, size, *order).filter(F.col("running") <= limit)


def packed_by(df: DataFrame, by: str, order: list[Column], size: Column, limit: int) -> DataFrame:
    """As `packed`, for each group on its own."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= limit)


def fitted(requests: DataFrame, sections: DataFrame, rows: DataFrame, limit: int, margin: int = 1024) -> DataFrame:
    """Replies cut to their limit: (request, sections_kept, rows_kept, next_offset, bytes, status).

    requests: request, core, offset; sections: request, ordinal, bytes (optional, the last goes first); rows: request, rank, bytes.
    While a reply is larger than limit - margin, one optional section goes, and once none is left the last ranked row,
    but never the only one. What then is still too large is refused, never cut. next_offset follows the last row kept.
    """
    room = limit - margin

    def sums(parts: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy("request").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return parts.select("request", F.row_number().over(Window.partitionBy("request").orderBy(order)).alias("n"), F.sum("bytes").over(w).alias("upto"))

    s, r = sums(sections, "ordinal"), sums(rows, "rank")
    totals = requests.join(r.groupBy("request").agg(F.max("n").alias("all_rows"), F.max("upto").alias("row_bytes")), "request", "left").na.fill(0, ["all_rows", "row_bytes"])
    kept = s.join(totals, "request").filter(F.col("core") + F.col("row_bytes") + F.col("upto") <= room).groupBy("request").agg(F.max("n").alias("sections_kept"), F.max("upto").alias("section_bytes"))
    at = totals.join(kept, "request", "left").na.fill(0, ["sections_kept", "section_bytes"])
    fits = r.join(totals, "request").filter((F.col("core") + F.col("upto") <= room) | (F.col("n") == 1)).groupBy("request").agg(F.max("n").alias("rows_kept"), F.max("upto").alias("kept_bytes"))
    out = at.join(fits, "request", "left").na.fill(0, ["rows_kept", "kept_bytes"]).withColumn("bytes", F.col("core") + F.col("section_bytes") + F.col("kept_bytes"))
    ok = F.col("bytes") <= room
    keep = lambda c: F.when(ok, F.col(c))
    more = F.when(ok & (F.col("rows_kept") < F.col("all_rows")), F.col("offset") + F.col("rows_kept"))
    return out.select("request", keep("sections_kept").alias("sections_kept"), keep("rows_kept").alias("rows_kept"), more.alias("next_offset"), keep("bytes").alias("bytes"), F.when(ok, "fits").otherwise("refused").alias("status"))


def _binding(request: dict, snapshot: str) -> str:
    return hashlib.sha256(json.dumps([request, snapshot], sort_keys=True).encode()).hexdigest()


def cursor(request: dict, snapshot: str, after) -> str:
    """A token for the rows after a key, good for this request and snapshot only."""
    return base64.urlsafe_b64encode(json.dumps({"after": after, "for": _binding(request, snapshot)}).encode()).decode()


def resume(token: str, request: dict, snapshot: str):
    """The key that a cursor stands for; one made for something else is refused."""
    try:
        got = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise Refused("not a cursor") from e
    if got.get("for") != _binding(request, snapshot):
        raise Refused("the cursor belongs to another request")
    return got["after"]


# ---------------------------------------------------------------- rankings that are kept for their pages

BUCKET_ROWS = 8_192  # rows of a ranking that lie together; pages end where a bucket does


def retain(sections: dict[str, tuple[DataFrame, list[Column | str]]], path: str, request: dict, snapshot: str) -> str:
    """Rank each section's rows (rows, order) once and keep them under path, keyed by request and snapshot. Returns the folder.

    A section's rows lie in buckets of rank; a manifest, written last, has their numbers, and a ranking without one is
    not served. One that is there already is served as it is.
    """
    where = f"{path.rstrip('/')}/{_binding(request, snapshot)}"
    if not sections:
        raise Refused("a ranking has a section")
    spark = next(iter(sections.values()))[0].sparkSession
    if _manifest(spark, where) is not None:
        return where
    sizes = []
    for name, (rows, order) in sections.items():
        placed = ranked(rows, *order).withColumn("bucket", F.floor(F.col("rank") / BUCKET_ROWS))
        placed.repartition("bucket").sortWithinPartitions("bucket", "rank").write.mode("overwrite").partitionBy("bucket").parquet(f"{where}/section={name}")
        sizes.append((name, spark.read.schema("rank long, bucket long").parquet(f"{where}/section={name}").count(), placed.schema.json()))
    spark.createDataFrame(sizes, "section string, n long, columns string").coalesce(1).write.mode("overwrite").parquet(f"{where}/manifest")
    return where


def _manifest(spark, where: str) -> dict | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/manifest/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return {r["section"]: (r["n"], StructType.fromJson(json.loads(r["columns"]))) for r in spark.read.parquet(f"{where}/manifest").collect()}


def retained_page(spark, path: str, request: dict, snapshot: str, section: str, limit: int = DEFAULT, token: str | None = None) -> tuple[DataFrame, str | None]:
    """(rows of the section's next page by rank, the cursor behind it or None at the end). Only one bucket is read.

    Cursors are for a section of a request and snapshot; others are refused, and so is a ranking that isn't there.
    """
    where = f"{path.rstrip('/')}/{_binding(request, snapshot)}"
    sizes = _manifest(spark, where)
    if sizes is None or section not in sizes:
        raise Refused("no such ranking is kept")
    at = resume(token, request | {"section": section}, snapshot) if token else 0
    bucket, (n, columns) = at // BUCKET_ROWS, sizes[section]
    stop = min(at + max(1, min(limit, MOST)), (bucket + 1) * BUCKET_ROWS, n)
    rows = spark.read.schema(columns).parquet(f"{where}/section={section}").filter((F.col("bucket") == bucket) & (F.col("rank") >= at) & (F.col("rank") < stop)).drop("bucket").orderBy("rank")
    return rows, cursor(request | {"section": section}, snapshot, stop) if stop < n else None
