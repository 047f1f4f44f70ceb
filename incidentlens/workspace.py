"""Tables that cut lineage between jobs, kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "_step.json"


@dataclass(frozen=True)
class SavedTable:
    """A written table and its exact row count."""

    df: DataFrame
    rows: int


def input_marks(df: DataFrame) -> list:
    """What tells one input from another: its files, or a mark of its own for rows that come from no file."""
    paths = df.inputFiles()
    return Files(df.sparkSession).marks(paths) if paths else [uuid.uuid4().hex]


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may go without the setting; it gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


class Workspace:
    """One run's folder of intermediate Parquet tables.

    Lost executors cost at most the current job: every finished step is on shared storage and
    never recomputed. Results returned to the caller read from these tables, so ``close()``
    belongs after the results have been written.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, name: str | None = None):
        """``name``: of a run that may be taken up again; its steps are found by later runs of that name."""
        self.spark = spark
        self.path = f"{folder or checkpoint_folder(spark)}/incidentlens-{name or uuid.uuid4().hex}"
        self.named = name is not None
        self._tables = 0
        self.last: str | None = None  # folder of the table written last

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """``options``: of the Parquet writer."""
        self._tables += 1
        path = f"{self.path}/{self._tables:04d}-{name}"
        df.write.options(**options).parquet(path)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def save(self, df: DataFrame, name: str) -> SavedTable:
        table = self.write(df, name)
        return SavedTable(table, table.count())  # answered from the file footers

    def step(self, name: str, identity: dict, make: Callable[[Workspace], DataFrame]) -> SavedTable:
        """A table with a name, made once.

        ``make`` gets a workspace of its own, whose tables are deleted as soon as the result is
        written. A manifest of ``identity`` (input and parameters), row count and schema is put beside the
        result at the end; a later run that finds it with the same identity takes the table as it is.
        """
        files, path = Files(self.spark), f"{self.path}/step-{name}"
        identity = json.loads(json.dumps(identity))
        if files.exists(f"{path}/{MANIFEST}"):
            known = json.loads(files.read(f"{path}/{MANIFEST}"))
            if known["identity"] == identity:
                schema = StructType.fromJson(known["schema"])
                return SavedTable(self.spark.read.schema(schema).parquet(path), known["rows"])
        files.delete(path)
        inside = Workspace(self.spark, f"{self.path}/in-{name}")
        made = make(inside)
        made.write.parquet(path)
        table = self.spark.read.schema(made.schema).parquet(path)
        saved = SavedTable(table, table.count())
        manifest = {"identity": identity, "rows": saved.rows, "schema": table.schema.jsonValue()}
        files.put(f"{path}/{MANIFEST}", json.dumps(manifest))
        inside.close()
        return saved

    def close(self) -> None:
        """Delete the run's tables."""
        self.remove(self.path)

    def remove(self, path: str) -> None:
        """Delete one table, once nothing that is still to run reads it."""
        Files(self.spark).delete(path)


class Files:
    """Folders in whatever file system their path names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        hadoop_path, system = self._at(path)
        return system.exists(hadoop_path)

    def delete(self, path: str) -> None:
        hadoop_path, system = self._at(path)
        system.delete(hadoop_path, True)

    def make(self, path: str) -> None:
        hadoop_path, system = self._at(path)
        system.mkdirs(hadoop_path)

    def rename(self, source: str, target: str) -> None:
        hadoop_path, system = self._at(source)
        if not system.rename(hadoop_path, self._at(target)[0]):
            raise OSError(f"{source} could not be renamed to {target}")

    def read(self, path: str) -> str:
        """A small file."""
        hadoop_path, system = self._at(path)
        stream = system.open(hadoop_path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def marks(self, paths: list[str]) -> list[list]:
        """Path, length and time of change of files."""
        out = []
        for path in sorted(paths):
            hadoop_path, system = self._at(path)
            status = system.getFileStatus(hadoop_path)
            out.append([path, status.getLen(), status.getModificationTime()])
        return out

    def put(self, path: str, text: str) -> None:
        """Write a small file."""
        hadoop_path, system = self._at(path)
        stream = system.create(hadoop_path, True)
        stream.write(bytearray(text.encode()))
        stream.close()
