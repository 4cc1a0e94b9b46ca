"""Snapshots: written whole, sealed, selected by a pointer, backed up, restored and retired."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sql import Refused


@dataclass(frozen=True)
class Store:
    """A folder of snapshots on any Hadoop file system. A reader sees a snapshot in full or not at all."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _write(self, path: str, text: str) -> None:
        """Write beside, then rename: the name appears with its whole content."""
        fs, p = self._fs(path)
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"could not publish {path}")

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        rows = self.spark.read.text(path, wholetext=True).collect()
        return rows[0][0] if rows else None

    def publish(self, relations: dict[str, DataFrame], select: bool = True) -> str:
        """Write all relations under a new name; only then write the manifest, and only then move the pointer."""
        name = uuid.uuid4().hex
        counts = {}
        for k, df in relations.items():
            df.write.parquet(f"{self.root}/{name}/{k}")
            counts[k] = self.spark.read.parquet(f"{self.root}/{name}/{k}").count()
        self._write(f"{self.root}/{name}/manifest.json", json.dumps({"relations": counts}, sort_keys=True))
        if select:
            self._write(f"{self.root}/selected", name)
        return name

    def selected(self) -> str | None:
        return self._read(f"{self.root}/selected")

    def manifest(self, name: str) -> dict:
        text = self._read(f"{self.root}/{name}/manifest.json")
        if text is None:
            raise Refused(f"snapshot {name} is not sealed")
        return json.loads(text)

    def read(self, relation: str, name: str | None = None) -> DataFrame:
        name = name or self.selected()
        if name is None or relation not in self.manifest(name)["relations"]:
            raise Refused(f"no sealed relation {relation}")
        return self.spark.read.parquet(f"{self.root}/{name}/{relation}")

    def backup(self, name: str, target: str) -> dict:
        """Copy a sealed snapshot to a new place; an existing place is refused. Returns the receipt."""
        fs, p = self._fs(target)
        if fs.exists(p):
            raise Refused(f"{target} exists")
        relations = self.manifest(name)["relations"]
        receipt = {"snapshot": name, "relations": {}}
        for k in relations:
            df = self.read(k, name)
            df.write.parquet(f"{target}/{k}")
            receipt["relations"][k] = {"rows": relations[k], "digest": digest(df)}
        self._write(f"{target}/receipt.json", json.dumps(receipt, sort_keys=True))
        return receipt

    def restore(self, source: str, select: bool = True) -> str:
        """Admit a backup again as data only: what differs from its receipt is refused before anything is published."""
        text = self._read(f"{source}/receipt.json")
        if text is None:
            raise Refused("no receipt")
        found = {}
        for k, want in json.loads(text)["relations"].items():
            df = self.spark.read.parquet(f"{source}/{k}")
            if df.count() != want["rows"] or digest(df) != want["digest"]:
                raise Refused(f"{k} differs from its receipt")
            found[k] = df
        return self.publish(found, select)

    def retire(self, name: str) -> None:
        if name == self.selected():
            raise Refused("the selected snapshot can't be retired")
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)


def digest(df: DataFrame) -> str:
    """Order-free digest of a relation: two sums over row hashes."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    g = F.xxhash64(F.lit("second"), *cols).cast("decimal(38,0)")
    row = df.agg(F.sum(h).alias("a"), F.sum(g).alias("b"), F.count("*").alias("n")).first()
    return f"{row['a'] or 0}:{row['b'] or 0}:{row['n']}"


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
