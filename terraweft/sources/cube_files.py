"""Data source of small text files: one file per row, all in one folder, on any file system that pyarrow reaches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Python workers get the source itself, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "cube_files"
SCHEMA = "file string, value string"
#: Files of one task.
FILES = 1_000
DONE = "_SUCCESS"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    # "file:/x" is how Spark writes what a URI calls "file:///x"
    return fs.FileSystem.from_uri("file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path)


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    """Every file of the folder as a row; names with a leading dot or underscore are no data."""

    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[Files]:
        system, folder = _place(self.path)
        found = system.get_file_info(fs.FileSelector(folder))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")
        return [Files(names[k : k + self.files]) for k in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = _place(self.path)
        values = []
        for name in partition.names:
            with system.open_input_stream(f"{folder}/{name}") as stream:
                values.append(stream.read().decode())
        yield pa.RecordBatch.from_arrays([pa.array(partition.names, pa.string()), pa.array(values, pa.string())], names=["file", "value"])


class Writer(DataSourceArrowWriter):
    """A file per row. A file appears under its name once it is whole, so a repeated task replaces files by equal ones."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = _place(self.path)
        system.create_dir(folder)
        for batch in iterator:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as stream:
                    stream.write(value.encode())
                system.move(draft, f"{folder}/{name}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder)
        system.open_output_stream(f"{folder}/{DONE}").close()


class CubeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the files of a folder."""
    spark.dataSource.register(CubeFiles)
    return spark.read.format(NAME).load(path)


def write_files(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (file, value) as one file per row; file names must be unique. ``mode`` is errorifexists, append or overwrite."""
    spark = df.sparkSession
    spark.dataSource.register(CubeFiles)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "errorifexists" and system.exists(target):
        raise FileExistsError(f"{path} already exists")
    if mode == "overwrite":
        system.delete(target, True)
    df.select("file", "value").write.format(NAME).mode("append").save(path)
