"""A sink whose writes are seen whole or not at all, and files written by tasks.

Every task writes one file of its own and hands its name, rows and bytes over as a commit
message; when all have succeeded, one manifest that names the files is written last, under a
name of its own. Readers open the files of the manifests and no others, so what a failed or
repeated task left behind is never read. A failed write takes its files away where it can.

Paths are opened with pyarrow's file systems in the tasks (file, hdfs, s3, gs, abfs and the like).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from millrace.plans.registry import pieces

FORMATS = ("parquet", "json")
#: Folders that a writing task remembers.
FOLDERS = 10_000
READ = "path string, bytes long"


def opened(path: str):
    """The file system of an address, and the path in it. A plain path is one of this machine."""
    from pyarrow import fs

    path = re.sub("^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    size: int


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.base, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "parquet"), overwrite
        if self.kind not in FORMATS:
            raise ValueError(f"unknown kind: {self.kind}")

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.parquet as pq

        name, rows, writer = f"data/{uuid.uuid4().hex}.{self.kind}", 0, None
        files, place = opened(f"{self.base}/{name}")
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(place) as out:
            for batch in iterator:
                rows += batch.num_rows
                if self.kind == "json":
                    out.write("".join(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode())
                else:
                    writer = writer or pq.ParquetWriter(out, batch.schema)
                    writer.write_table(pa.Table.from_batches([batch]))
            if writer:
                writer.close()
        if not rows:
            files.delete_file(place)
            return Written("", 0, 0)
        return Written(name, rows, files.get_file_info(place).size)

    def commit(self, messages) -> None:
        told = [m for m in messages if m is not None and m.file]
        files, place = opened(f"{self.base}/manifests/{time.time_ns():020d}-{uuid.uuid4().hex}.json")
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        manifest = {"kind": self.kind, "replaces": self.overwrite, "rows": sum(m.rows for m in told), "files": [[m.file, m.rows, m.size] for m in told]}
        # under another name until it is whole
        with files.open_output_stream(f"{place}.draft") as out:
            out.write(json.dumps(manifest).encode())
        files.move(f"{place}.draft", place)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.file:
                files, place = opened(f"{self.base}/{m.file}")
                if files.get_file_info(place).type.name == "File":
                    files.delete_file(place)


class ManifestSink(DataSource):
    """Options: path, kind (parquet or json, a line a row without its nulls)."""

    @classmethod
    def name(cls):
        return "manifest"

    def schema(self):
        return READ

    def writer(self, schema, overwrite):
        return ManifestWriter(self.options, overwrite)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append") -> None:
    """mode: append, or overwrite: readers then see what this and later writes wrote."""
    df.sparkSession.dataSource.register(ManifestSink)
    df.write.format("manifest").option("kind", kind).mode(mode).save(path)


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The manifests that count, oldest first: from the last one that replaces what was before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifests")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    told = sorted(spark.read.text(f"{path.rstrip('/')}/manifests/*.json", wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()) if fs.listStatus(hadoop) else []
    out: list[dict] = []
    for row in told:
        one = json.loads(row["value"])
        out = [one] if one["replaces"] else [*out, one]
    return out


def read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """The rows of all writes that have been committed."""
    files = [f"{path.rstrip('/')}/{f[0]}" for m in manifests(spark, path) for f in m["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.json(files) if kind == "json" else reader.parquet(*files)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """rows: tail (a path below root) and content. Each task writes its rows' files, whole or not at all; tail, bytes and error of each. A repeated tail is written again, null contents are empty files."""

    def run(batches):
        import pyarrow as pa

        files, base = opened(root.rstrip("/"))
        made: set[str] = set()  # folders that this task knows to be there
        for b in pieces(batches):
            sizes, errors = [], []
            for tail, content in zip(b.column("tail").to_pylist(), b.column("content").to_pylist()):
                try:
                    place = f"{base}/{tail}"  # a tail is a path as it is, not part of an address
                    folder = place.rsplit("/", 1)[0]
                    if folder not in made:
                        files.create_dir(folder, recursive=True)
                        if len(made) >= FOLDERS:
                            made.clear()
                        made.add(folder)
                    draft = f"{folder}/.{uuid.uuid4().hex}"  # no listing shows it
                    with files.open_output_stream(draft) as out:
                        out.write(content or b"")
                    files.move(draft, place)
                    sizes.append(len(content or b""))
                    errors.append(None)
                except OSError as e:
                    sizes.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("tail"), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["tail", "bytes", "error"])

    return rows.select("tail", "content").mapInArrow(run, "tail string, bytes long, error string")
