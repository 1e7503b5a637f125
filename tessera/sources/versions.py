"""A table as files with a list of them for each version: writes by key rewrite only the files that hold a key, and readers see one version whole.

    folder/data/<write>/part-*.parquet    files, which are never changed
    folder/versions/<number>              the schema, and the files that make up this version, a line each

A write reads the keys' column to find the files that it touches, writes their rows anew, and puts the next version beside the last one. What it is given
is written first: Spark then knows its size and sends few keys to the table's rows, rather than all of them through a shuffle. Where two
writers meet, the second one's version is there already: it fails and may try again. Files of old versions stay for their readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import keyed

from .readers import kept


class Table:
    """A table of versions below folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return sorted(x.getPath().getName() for x in self._files.listStatus(path)) if self._files.exists(path) else []

    def version(self) -> int:
        """The number of the last version; 0 if there is none."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def files(self, version: int | None = None) -> tuple[StructType, list[str]]:
        """Schema and files (below data) of a version, the last one unless given."""
        place = f"{self.folder}/versions/{version or self.version():012d}"
        schema, *names = [r[0] for r in self.spark.read.text(place, wholetext=True).collect()][0].rstrip("\n").split("\n")
        return StructType.fromJson(json.loads(schema)), names

    def _read(self, schema: StructType, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(*self.files(version))

    def _write(self, rows: DataFrame) -> list[str]:
        """New files of rows; files without a row are left out."""
        write = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{write}")
        names = [f"{write}/{n}" for n in self._names(f"data/{write}") if n.endswith(".parquet")]
        if not names:
            return []
        full = self._read(rows.schema, names).select(F.regexp_extract("_metadata.file_path", "([^/]*/[^/]*)$", 1).alias("f")).distinct().collect()
        return sorted(r["f"] for r in full)

    def _commit(self, number: int, schema: StructType, names: list[str]) -> int:
        place, waiting = self._path(f"{self.folder}/versions/{number:012d}"), self._path(f"{self.folder}/versions/_{uuid.uuid4().hex}")
        out = self._files.create(waiting, False)
        out.write(bytearray("\n".join([schema.json(), *names, ""]).encode()))
        out.close()
        if self._files.exists(place) or not self._files.rename(waiting, place):
            self._files.delete(waiting, False)
            raise RuntimeError(f"version {number} has been written meanwhile")
        return number

    def create(self, rows: DataFrame) -> int:
        """The first version, of these rows."""
        return self._commit(1, rows.schema, self._write(rows))

    def insert(self, rows: DataFrame) -> int:
        """More rows, in files of their own."""
        last = self.version()
        schema, names = self.files(last)
        return self._commit(last + 1, schema, names + self._write(rows.select(schema.names)))

    def _rewrite(self, keys: DataFrame, key: str, change) -> int:
        last = self.version()
        schema, names = self.files(last)
        rows = self._read(schema, names)
        held = rows.select(key, F.col("_metadata.file_path").alias("f")) if names else rows.select(key, F.lit("").alias("f"))
        touched = {"/".join(r["f"].split("/")[-2:]) for r in held.join(keys.select(key), key, "left_semi").select("f").distinct().collect()}
        if not touched:
            return last
        new = change(self._read(schema, sorted(touched))).select(schema.names)
        return self._commit(last + 1, schema, [n for n in names if n not in touched] + self._write(new))

    def update_by_key(self, changes: DataFrame, key: str) -> int:
        """Columns of changes replace those of the rows with its keys, each of which it holds once; keys that no row has change nothing. The version after it."""
        changes = kept(changes)
        return self._rewrite(changes, key, lambda rows: keyed.update_by_key(rows, changes, key))

    def delete_by_key(self, keys: DataFrame, key: str) -> int:
        """Takes away the rows with these keys. The version after it."""
        keys = kept(keys.select(key))
        return self._rewrite(keys, key, lambda rows: rows.join(keys, key, "left_anti"))

    def upsert_ignore(self, rows: DataFrame, key: str) -> int:
        """Adds the rows whose key isn't there. The version after it."""
        rows = kept(rows)
        there = self.read().select(key).join(rows.select(key), key, "left_semi")
        return self.insert(rows.join(kept(there), key, "left_anti"))
