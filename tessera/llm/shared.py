"""What the operators of this subpackage share: scratch tables, hashing kernels, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tessera.scratch", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")  # tests and local runs only
        spark.conf.set("spark.tessera.scratch", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """What is at the path now goes when the application ends, if not before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete settled tables that nothing reads any more, and let Spark drop shuffle files of finished work."""
    remove(*tables)
    release()


def remove(*tables: DataFrame | str) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_tessera_path", None)
        spark = SparkSession.getActiveSession()
        if path and spark is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Collect garbage on the driver, so that the context cleaner removes shuffle files of finished stages.

    Twice, as what the first round lets go of can hold more; the cleaner works beside us and gets a moment.
    """
    spark = SparkSession.getActiveSession()
    for _ in range(2):
        gc.collect()
        if spark is not None:
            spark._jvm.System.gc()
            time.sleep(float(spark.conf.get("spark.tessera.release.pause", "0.25")))


HOT_ROWS, HOT_SHARE = 1_000, 1_000  # a key is hot with so many rows, and a thousandth of all


def join_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join of rows with facts, which hold a key once at most, such that no key's rows have to meet in one task.

    Keys of a thousandth of the rows or more (so fewer than HOT_SHARE + 1) bring their facts by broadcast to where
    the rows are; the others meet by a shuffle. Both inputs are read more than once: settled tables.
    """
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).count()
    hot = [r[0] for r in sizes.filter(F.col("count") > max(HOT_ROWS, rows.count() // HOT_SHARE)).select(key).collect()]
    if not hot:
        return rows.join(facts, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), key, "left").unionByName(rows.filter(~is_hot).join(facts, key, "left"))


BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, for passing whole texts to Python: batches of Arrow hold fewer rows than the default, so that tasks need less memory.

    Sets the session's limit unless it is lower already. Results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing kernels (numpy, modulo 2**64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = splitmix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BYTE_CODES_2 = splitmix(BYTE_CODES ^ np.uint64(0x2545F4914F6CDD1D))
BASE = 0x9FB21C651E98DF25 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # by doubling: powers [done, 2 done) are powers [0, done) times base**done
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


class Powers:
    """Powers of the polynomial base and of its inverse, grown on demand."""

    up = _powers(BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def ensure(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(BASE, size), _powers(_INVERSE, size)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums s with hash(codes[a:b]) = (s[b] - s[a]) * BASE**-a."""
    Powers.ensure(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * Powers.up[: len(codes)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * Powers.down[start]


def doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Names of all substrings of 2*width symbols from names of those of width symbols."""
    return h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component) with component the least node reachable.

    Alternates large-star and small-star rounds until the edge set is a star forest. Every round writes its
    edges to the shared folder, so lineage stays short; all grouping is by partial aggregates (no node's
    neighbourhood is gathered into one row). Nodes without an edge to another node do not appear.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = settle(e, "cc")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low2 = big.groupBy("a").agg(F.min("b").alias("m"))
        joined = big.join(low2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        nxt = settle(small, "cc")
        # A star forest: no node is both a leaf and a root, and each leaf has one root.
        sides = nxt.groupBy("a").agg(F.count("*").alias("k"), F.lit(0).alias("root")).union(nxt.select(F.col("b"), F.lit(0).cast("long"), F.lit(1)).distinct())
        stable = sides.groupBy("a").agg(F.sum("k").alias("k"), F.count("*").alias("roles")).filter("k > 1 or roles > 1").isEmpty()
        discard(e)
        e = nxt
        if stable:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")
