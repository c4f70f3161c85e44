"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only where Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir().rstrip("/") + "/agentguard-shared"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder once and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove tables of `stage` that nothing reads any more: whatever was made from them is itself staged."""
    for df in staged:
        spark, path = df.sparkSession, df._staged_at
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many lines after it as it takes to differ from the columns of `df`."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_address(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The documents with a column that tells each row from all others, whenever it is read, and that column's name.

    It is the place of the row in the Parquet files: 128 bits of the file's name and the row's number in it.
    A table that is more than columns and filters of such files is staged first.
    """
    name = free_name(docs, "_row_address")
    files = docs if _only_files(docs) else stage(docs, label)
    return files.withColumn(name, _place(files)), name


def _only_files(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, and the same rows come whenever it is read."""
    node = docs._jdf.queryExecution().analyzed()
    while node.deterministic() and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.deterministic() and node.nodeName() == "LogicalRelation" and node.toString().split()[-1] == "parquet"


def _place(files: DataFrame):
    at = files.metadataColumn("_metadata")
    file = at["file_path"]
    return F.struct(F.xxhash64(file).alias("file"), F.xxhash64(F.lit("file"), file).alias("more"), at["row_index"].alias("row"))


def with_order(docs: DataFrame, id_col: str, label: str) -> tuple[DataFrame, str]:
    """The documents with a value of its own for each row that sorts by id, null ids last; and that column's name."""
    placed, name = with_address(docs, label)
    return placed.withColumn(name, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(name).alias("row"))), name


def rows_that_stay(docs: DataFrame, order: str, stay: DataFrame) -> DataFrame:
    """The rows of `with_order` whose value is in the only column of `stay`, without that value."""
    chosen = stay.select(F.col(stay.columns[0])["row"].alias(order + "stays"))
    return docs.join(chosen, docs[order]["row"] == chosen[order + "stays"], "left_semi").drop(order)


#: Bytes of a batch of texts between Spark and its Python workers.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, with its session's batches to Python bounded in bytes, whatever the length of texts; a smaller bound stays."""
    conf = df.sparkSession.conf
    held = conf.get(_BATCH, None) or ""
    bound = int("".join(filter(str.isdigit, held)) or 0) if held.rstrip("bB").isdigit() else 0
    if not 0 < bound <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism
