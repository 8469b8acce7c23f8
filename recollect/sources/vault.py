"""A vault as a folder of parquet tables.

Parquet has no update, so a save appends a version and a load takes each id's latest.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of a source's content that are stored.
STORED_CHARS = 10_000

EVIDENCE = "array<struct<id:string,source_id:string,text:string,weight:double,timestamp:double,path:string,lines:string>>"
TABLES = {
    "sources": "id string, title string, content string, source_type string, path string, url string, ingested_at double, claims_extracted array<string>, entities_extracted array<string>, umsf string",
    "claims": f"id string, text string, confidence double, status string, polarity string, evidence {EVIDENCE}, created_at double, updated_at double, entity_id string, tags array<string>, durability string",
    "entities": "id string, name string, aliases array<string>, entity_type string, backlinks array<string>, created_at double, updated_at double, summary string",
    "timeline": "id string, entity_id string, source_id string, date string, title string, body string, timestamp double",
    "foresight": "id string, entity_id string, text string, valid_until double, source_id string, status string",
    "events": "id string, source_id string, session_id string, agent string, ts double, type string, role string, name string, content string, args_json string, result string, error string, path string, metadata_json string",
    "pull_state": "id string, adapter string, fingerprint string",
    "hook_counts": "id string, hook string, fired bigint",
}
VERSION = "version bigint, deleted boolean"


class Vault:
    """Tables under ``root``, which may be any path Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, lang: str = "zh"):
        self.spark, self.root, self.lang = spark, root.rstrip("/"), lang

    def _schema(self, name: str) -> StructType:
        return StructType.fromDDL(f"{TABLES[name]}, {VERSION}")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @property
    def is_initialized(self) -> bool:
        return all(self._exists(self._path(n)) for n in TABLES)

    def init(self) -> Vault:
        """The tables, empty; those that exist stay as they are."""
        for name in TABLES:
            if not self._exists(self._path(name)):
                self.spark.createDataFrame([], self._schema(name)).write.parquet(self._path(name))
        return self

    def versions(self, name: str) -> DataFrame:
        """All stored versions of a table's rows."""
        return self.spark.read.schema(self._schema(name)).parquet(self._path(name))

    def load(self, name: str) -> DataFrame:
        """The latest version of each row; order is undefined, so sort what you show."""
        latest = Window.partitionBy("id").orderBy(F.col("version").desc())
        rows = self.versions(name).withColumn("__n", F.row_number().over(latest)).where("__n = 1 and not coalesce(deleted, false)")
        return rows.drop("__n", "version", "deleted")

    def get(self, name: str, id: str) -> DataFrame:
        """One row by id; the filter reaches the scan."""
        rows = self.versions(name).where(F.col("id") == id).orderBy(F.col("version").desc()).limit(1)
        return rows.where("not coalesce(deleted, false)").drop("version", "deleted")

    def save(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        """Append versions; missing columns are null, unknown ones are dropped."""
        schema = StructType.fromDDL(TABLES[name])
        have = set(rows.columns)
        columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        if name == "sources" and "content" in have:
            columns = [F.substring("content", 1, STORED_CHARS).alias("content") if f.name == "content" else c for f, c in zip(schema, columns)]
        version = time.time_ns()
        rows.select(*columns, F.lit(version).cast("bigint").alias("version"), F.lit(deleted).alias("deleted")).write.mode("append").parquet(self._path(name))

    def delete(self, name: str, rows: DataFrame) -> None:
        """Rows that no longer load."""
        self.save(name, rows, deleted=True)

    def compact(self, name: str) -> None:
        """Rewrite a table to its latest rows; readers keep the old files until it is swapped."""
        jvm = self.spark._jvm
        fresh = f"{self._path(name)}__{uuid.uuid4().hex[:8]}"
        live = self.load(name).withColumn("version", F.lit(0).cast("bigint")).withColumn("deleted", F.lit(False))
        live.write.parquet(fresh)
        old, new = jvm.org.apache.hadoop.fs.Path(self._path(name)), jvm.org.apache.hadoop.fs.Path(fresh)
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def stats(self) -> dict[str, int]:
        """Rows of each table."""
        return {name: self.load(name).count() for name in TABLES}

    def cached(self, name: str) -> DataFrame:
        """The latest rows, kept in the session's cache until it is cleared."""
        return self.load(name).persist()
