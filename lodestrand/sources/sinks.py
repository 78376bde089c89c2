"""Tables on plain Parquet: upserts, deletes, updates, compaction and snapshots.

A table is a folder of numbered snapshots with a pointer file; a write makes a new snapshot from the old one and moves the
pointer last, so readers never see half a write and an executor's loss only repeats tasks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORBIDDEN = {"entity_id": "id", "chunk_id": "id", "relationship_type": "type", "entity_type": "type"}


def last_of_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an explicit order column."""
    newest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return df.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of new replace rows of old with the same key, others are added. Keys compare null-safe."""
    test = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = test[0]
    for t in test[1:]:
        condition = condition & t
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), condition, "left_anti").select("o.*")
    return kept.unionByName(new, allowMissingColumns=True)


def without_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def without_files(df: DataFrame, paths: list[str], project: str) -> DataFrame:
    """Rows of other projects or other files."""
    return df.filter(~((F.col("project_id") == project) & F.coalesce(F.col("file_path").isin(paths), F.lit(False))))


def without_entities(entities: DataFrame, relationships: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships after some entities and every link at them are gone."""
    links = without_ids(without_ids(relationships, ids, "source_id"), ids, "target_id")
    return without_ids(entities, ids), links


def updated(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition with new values."""
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def with_sentinels(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nulls replaced by the table's sentinels."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in values.items() if k in df.columns})


def checked(df: DataFrame, schema: StructType, strict: bool = True) -> DataFrame:
    """Columns of the schema in order, cast; a missing required column, a forbidden alias or, if strict, an unknown column is
    an error at once, and a null in a required column when the rows are read."""
    for alias, name in FORBIDDEN.items():
        if alias in df.columns:
            raise ValueError(f"column {alias} should be called {name}")
    known = {f.name for f in schema}
    if strict and (unknown := sorted(set(df.columns) - known)):
        raise ValueError(f"unknown columns: {unknown}")
    if missing := sorted(f.name for f in schema if not f.nullable and f.name not in df.columns):
        raise ValueError(f"missing columns: {missing}")
    out = []
    for f in schema:
        column = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if not f.nullable:
            column = F.when(column.isNull(), F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType)).otherwise(column)
        out.append(column.alias(f.name))
    return df.select(*out)


class SnapshotTable:
    """A table at `path`: read, write, upsert, delete, compact, roll back. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or ["id"]
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_pointer(self) -> dict:
        target = self._path(f"{self.path}/current.json")
        if not self._fs.exists(target):
            return {"versions": []}
        stream = self._fs.open(target)
        try:
            data = bytes(b & 255 for b in self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return json.loads(data)

    def _write_pointer(self, state: dict) -> None:
        fresh, target = self._path(f"{self.path}/.{uuid.uuid4().hex}"), self._path(f"{self.path}/current.json")
        stream = self._fs.create(fresh)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        self._fs.delete(target, False)
        self._fs.rename(fresh, target)

    def versions(self) -> list[str]:
        return self._read_pointer()["versions"]

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int = -1) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[version]}")

    def write(self, df: DataFrame) -> None:
        """A new snapshot; the pointer moves when it is complete."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._write_pointer({"versions": [*self.versions(), name]})

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        new = last_of_key(new, self.keys, order).drop(order) if order else new.dropDuplicates(self.keys)
        self.write(merged(self.read(), new, self.keys) if self.exists() else new)

    def append(self, new: DataFrame) -> None:
        """Rows whose key is there already are left out; others of the batch are kept."""
        new = new.dropDuplicates(self.keys)
        self.write(self.read().unionByName(new.join(self.read().select(*self.keys), self.keys, "left_anti")) if self.exists() else new)

    def delete(self, condition: Column) -> int:
        """Remove rows; how many."""
        rows = self.read()
        gone = rows.filter(condition).count()
        if gone:
            self.write(rows.filter(~F.coalesce(condition, F.lit(False))))
        return gone

    def compact(self, rows_per_file: int = 1_000_000) -> None:
        """Rewrite into files of about so many rows, sorted by key within each."""
        rows = self.read()
        files = max(1, -(-rows.count() // rows_per_file))
        self.write(rows.repartition(files, *self.keys).sortWithinPartitions(*self.keys))

    def expire(self, keep: int = 1) -> int:
        """Delete all but the newest snapshots; how many went."""
        versions = self.versions()
        old = versions[:-keep] if keep else versions
        self._write_pointer({"versions": versions[len(old) :]})
        for name in old:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return len(old)

    def rollback(self) -> None:
        """Back to the snapshot before the last."""
        versions = self.versions()
        if len(versions) < 2:
            raise ValueError("no earlier snapshot")
        self._write_pointer({"versions": versions[:-1]})
        self._fs.delete(self._path(f"{self.path}/{versions[-1]}"), True)

    def statistics(self) -> DataFrame:
        """By file of the current snapshot: rows and bytes."""
        return self.read().groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))


def expire_branches(df: DataFrame, active: list[str], now: Column) -> DataFrame:
    """Rows of branches no longer active marked inactive, with the time it was noticed first."""
    gone = ~F.col("branch").isin(active)
    return updated(df, gone, {"is_active": F.lit(False), "expired_at": F.coalesce("expired_at", now)})


def prune_branches(df: DataFrame, cutoff: Column) -> DataFrame:
    return df.filter("expired_at is null").unionByName(df.filter(F.col("expired_at") >= cutoff))


def without_file_links(relationships: DataFrame, entities: DataFrame, path: str, project: str) -> DataFrame:
    """Relationships of all projects but for those of `project` with an end among its entities of a file."""
    own = entities.filter((F.col("file_path") == path) & (F.col("project_id") == project)).select("id").distinct()
    ids = own.select(F.col("id").alias("source_id"), F.lit(True).alias("__s"))
    ends = own.select(F.col("id").alias("target_id"), F.lit(True).alias("__t"))
    rows = relationships.join(ids, "source_id", "left").join(ends, "target_id", "left")
    gone = (F.col("__s").isNotNull() | F.col("__t").isNotNull()) & F.coalesce(F.col("project_id") == project, F.lit(False))
    return rows.filter(~gone).select(*relationships.columns)
