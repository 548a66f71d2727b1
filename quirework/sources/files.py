"""A data source writer that makes one file of each row, with tasks that commit or leave nothing.

    spark.dataSource.register(FileSink)
    df.select("name", "content").write.format("files").mode("append").save(folder)

A task writes into a folder of its attempt, with a list of its files. When all tasks are done, the driver moves the files of
each task's one successful attempt to their places, a list at a time, as Spark's own committer does; a failed attempt's folder goes with
the job's. When the job fails, nothing has been moved."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import scratch

STAGED = "_attempts-"
#: Files that the driver moves at a time.
MOVES = 16
#: Rounds that files are written in, at least; files of a round, about, at most.
ROUNDS, ROUND = 4, 1 << 15
#: Rows in a file of the table that rounds are taken from, at most.
STORED = 1 << 11
#: How small files are read: what opening one counts for when they are dealt to tasks, in bytes (Spark's own 4 MB makes a task
#: of a few), and no listing of them kept in the driver, as they are listed once.
SMALL = {"spark.sql.files.openCostInBytes": str(1 << 16), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


@dataclass
class Written(WriterCommitMessage):
    files: int
    folder: str


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


class FileWriter(DataSourceWriter):
    """Rows (name, content): names are paths below the folder, made different by the caller; a null content is an empty file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def _at(self, *parts: str) -> str:
        return "/".join([self._root, *parts])

    @property
    def _root(self) -> str:
        return self._opened()[1]

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        system, _ = self._opened()
        own = f"{STAGED}{self.job}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(self._at(own), recursive=True)
        names = []
        for name, content in iterator:
            if name is None or not name or name.startswith(("/", STAGED)) or ".." in name.split("/") or "\n" in name:
                raise ValueError(f"no file can be called {name}")
            with system.open_output_stream(self._at(own, str(len(names)))) as f:
                f.write((content or "").encode())
            names.append(name)
        with system.open_output_stream(self._at(own, "names")) as f:
            f.write("\n".join(names).encode())
        return Written(len(names), own)

    def _clean(self) -> None:
        from pyarrow import fs

        system, _ = self._opened()
        staged = self._at(f"{STAGED}{self.job}")
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._opened()
        system.create_dir(root, recursive=True)
        made = {""}
        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is None or not m.files:
                    continue
                with system.open_input_file(self._at(m.folder, "names")) as f:
                    names = f.read().decode().split("\n")
                for folder in {n.rpartition("/")[0] for n in names} - made:
                    system.create_dir(self._at(folder), recursive=True)
                    made.add(folder)
                list(pool.map(lambda x: system.move(self._at(m.folder, str(x[0])), self._at(x[1])), enumerate(names)))
        with system.open_output_stream(self._at("_SUCCESS")):
            pass
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()


def write_documents(docs: DataFrame, name: Column, content: str, path: str) -> None:
    """A file of each row of ``docs`` under ``path``. Rows are as many as before; their number of partitions is the number of tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this module
    docs.sparkSession.dataSource.register(FileSink)
    docs.select(name.alias("name"), F.col(content).alias("content")).write.format("files").mode("append").save(path)


def written_and_read(docs: DataFrame, name: Column, content: str, path: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in a folder with a file of each row of ``docs``. All are written and read back, in rounds: a round's files
    go when what was read of them is written, so the disk holds the rows as one compressed table, and a quarter of the files."""
    spark, table, found = docs.sparkSession, f"{path}/table", f"{path}/found"
    scratch.put(docs.select(name.alias("name"), F.col(content).alias("content")), table, compression="zstd", maxRecordsPerFile=STORED)
    rows = spark.read.schema("name string, content string").parquet(table)
    parts, n = [unquote(x) for x in sorted(rows.inputFiles())], rows.count()
    each = max(1, len(parts) * min(-(-n // ROUNDS), ROUND) // max(1, n))
    for first in range(0, len(parts), each):
        folder = f"{path}/{first}"
        write_documents(spark.read.schema(rows.schema).parquet(*parts[first : first + each]), F.col("name"), "content", folder)
        with scratch.settings(spark, SMALL):
            got = read(folder)
            scratch.put(got, found, "append")
        scratch.drop(spark, folder)
    scratch.drop(spark, table)
    return spark.read.schema(got.schema).parquet(found)


def base_name(stem: Column) -> Column:
    return F.concat(F.regexp_replace(stem, r"\.[^.]*$", ""), F.lit(".json"))


def translation_name(stem: Column, target: str) -> Column:
    return F.concat(F.regexp_replace(stem, r"\.[^.]*$", ""), F.lit(f".{target}.json"))
