"""What the operators of this subpackage share: shared folders, shipping the package, Arrow batch size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to a Python worker; keeps a batch of whole texts in bounded memory.
BATCH_ROWS = 500
#: Bytes of such a batch, so that very long texts go a few at a time.
BATCH_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and the package on the executors' path where PYTHONPATH doesn't provide it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    name = "tessera-package.zip"
    if any(str(f).endswith(name) for f in sc.listFiles):
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / name
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "tessera").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """conf within the block, what was set before it afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a session in one local process gets a folder of its own; any other raises, as its executors would not see that.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["saved_at"] = path
    return table


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes saved tables (or folders of shared_folder) that nothing reads any more: what came from them is written itself."""
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.__dict__["saved_at"])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it while a column is already called so (in any case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
