"""Session settings shared by the tests, the bench and interactive use."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results (time zone) or keep plans healthy at any size.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Settings that only a new session takes. Rule packs build thousands of column objects:
#: skip the call-site capture for each.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "agentguard", master: str | None = None, **conf: str) -> SparkSession:
    """Get a session; `master` and further settings are for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they can import it from anywhere."""
    key = spark.conf.get("spark.app.id", "")
    if key in _shipped:
        return
    _shipped.add(key)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="agentguard-")) / "agentguard.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.addArtifacts(str(archive), pyfile=True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back: what is used twice is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, shared by driver and executors.

    Where it is unset, a temporary folder is used only if Spark runs in one process; on a cluster that is
    an error, as executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir().rstrip("/") + "/agentguard-shared"
