"""Helpers shared by the corpus operators: tables, staging in the shared folder, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 1024
#: Text bytes of one task where a job sorts or packs whole texts.
TASK_BYTES = 64 << 20
#: Folders of local runs without a shared folder, by application.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local run (one machine) has a
    temporary folder of its own; on a cluster it is an error, as executors share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return _OWN[context.applicationId]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage durably,
    so that a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for staged in tables:
        spark = staged.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(docs: DataFrame, text_col: str = "text", task_bytes: int = TASK_BYTES) -> int:
    """Partitions for a sort of whole texts: the session's number, or more so that a task holds
    about task_bytes."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + text_bytes(docs, text_col) // task_bytes)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with marks in front until no column of docs has it (case aside)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo: the fold of a document (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in the whole table, from one narrow pass."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def struct_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
