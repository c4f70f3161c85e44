"""Decisions, their calls and refused rows written as one unit, by a Python data source with one commit.

Each task writes Parquet files under names of its own, one per kind of row that it meets. Nothing of them counts until the
driver puts the manifest of the batch in place, a single rename: it names the files of all kinds. Readers
follow manifests, so they see a batch whole or not at all; files of tasks that failed, or of a batch that was
written before, are never named. A batch is known by its name, and the first commit of it stands.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

KINDS = ("decisions", "tool_calls", "refused")


def _store(uri: str):
    """File system and path of a shared folder; without a scheme it is a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, str]
    rows: dict[str, int]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, batch: str):
        self.folder, self.batch = folder, batch

    def write(self, iterator) -> _Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, base = _store(self.folder)
        own, writers, files, rows = uuid.uuid4().hex, {}, {}, {}
        store.create_dir(posixpath.join(base, "files"), recursive=True)
        try:
            for batch in iterator:
                for kind in KINDS:
                    part = batch.filter(pc.equal(batch.column("kind"), kind))
                    if not part.num_rows:
                        continue
                    held = pa.RecordBatch.from_struct_array(part.column(kind))
                    if kind not in writers:
                        files[kind] = f"files/{self.batch}-{own}-{kind}.parquet"
                        writers[kind] = pq.ParquetWriter(posixpath.join(base, files[kind]), held.schema, filesystem=store)
                    writers[kind].write_batch(held)
                    rows[kind] = rows.get(kind, 0) + held.num_rows
        finally:
            for w in writers.values():
                w.close()
        return _Written(files, rows)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base = _store(self.folder)
        target = posixpath.join(base, "manifests", f"{self.batch}.json")
        if store.get_file_info(target).type != fs.FileType.NotFound:
            return self.abort(messages)
        done = [m for m in messages if m is not None]
        entry = {"batch": self.batch, "files": {k: [m.files[k] for m in done if k in m.files] for k in KINDS},
                 "rows": {k: sum(m.rows.get(k, 0) for m in done) for k in KINDS}}
        store.create_dir(posixpath.join(base, "manifests"), recursive=True)
        fresh = posixpath.join(base, f"manifest-{uuid.uuid4().hex}")
        with store.open_output_stream(fresh) as out:
            out.write(json.dumps(entry).encode() + b"\n")
        store.move(fresh, target)

    def abort(self, messages) -> None:
        store, base = _store(self.folder)
        for m in messages:
            for file in (m.files.values() if m is not None else ()):
                store.delete_file(posixpath.join(base, file))


class AuditLog(DataSource):
    """Sink `audit_log` with options `path` and `batch`; its rows come from `write_batch`."""

    @classmethod
    def name(cls) -> str:
        return "audit_log"

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["path"], self.options["batch"])


def write_batch(decisions: DataFrame, calls: DataFrame | None, path: str, batch: str, valid: Column | None = None) -> None:
    """Commit decisions and their calls as one batch. Decisions for which `valid` is not true go to `refused`, read once with the others.

    A failed write leaves nothing that a reader sees, and a batch that is written again changes nothing.
    """
    spark = decisions.sparkSession
    if not batch or any(not (c.isalnum() or c in "-_.") for c in batch):
        raise ValueError(f"the name of a batch has letters, digits, -, _ and . only, not {batch!r}")
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    whole = F.struct(*[F.col(f"`{c}`") for c in decisions.columns])
    rows = decisions.select(F.when(ok, "decisions").otherwise("refused").alias("kind"), F.when(ok, whole).alias("decisions"), F.when(~ok, whole).alias("refused"))
    if calls is not None:
        own = calls.select(F.lit("tool_calls").alias("kind"), F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("tool_calls"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    else:
        rows = rows.withColumn("tool_calls", F.lit(None).cast("struct<none:int>"))
    spark.dataSource.register(AuditLog)
    rows.write.format("audit_log").option("path", path).option("batch", batch).mode("append").save()


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of all batches that were committed, by name of batch."""
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(posixpath.join(base, "manifests"), allow_not_found=True))
    out = []
    for info in found:
        with store.open_input_stream(info.path) as f:
            out.append(json.loads(f.read()))
    return sorted(out, key=lambda m: m["batch"])


def read_kind(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """Rows of a kind in all committed batches."""
    files = [f"{path}/{f}" for m in manifests(spark, path) for f in m["files"][kind]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
