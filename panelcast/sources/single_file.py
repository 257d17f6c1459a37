"""A CSV sink that publishes one file with one header, or nothing.

Tasks write the rows of their partition to part files beside the target. Only when all have succeeded are the parts joined
in partition order behind the header and moved to the target's name; a failed job removes them. Of a task that runs
twice only the attempt that Spark accepts is used.
"""

from __future__ import annotations

import csv
import io
import shutil
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from panelcast.operators.storage import qualified

FORMAT = "one_csv_file"
LINES = 1000


def _lines(rows: Sequence[Sequence]) -> bytes:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    return text.getvalue().encode()


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class OneFileWriter(DataSourceWriter):
    def __init__(self, target: str, columns: Sequence[str]):
        self.target, self.columns = target, list(columns)
        self.parts = f"{target}.parts-{uuid.uuid4().hex}"

    def write(self, rows) -> Part:
        system, folder = fs.FileSystem.from_uri(self.parts)
        system.create_dir(folder, recursive=True)
        number = TaskContext.get().partitionId()
        path, held = f"{folder}/{number:06d}-{uuid.uuid4().hex}", []
        with system.open_output_stream(path) as out:
            for row in rows:
                held.append(tuple(row))
                if len(held) == LINES:
                    out.write(_lines(held))
                    held.clear()
            out.write(_lines(held))
        return Part(number, path)

    def commit(self, messages) -> None:
        system, target = fs.FileSystem.from_uri(self.target)
        whole = f"{fs.FileSystem.from_uri(self.parts)[1]}/whole"
        system.create_dir(whole.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(whole) as out:
            out.write(_lines([self.columns]))
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with system.open_input_stream(part.path) as rows:
                    shutil.copyfileobj(rows, out, 1 << 20)
        system.move(whole, target)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = fs.FileSystem.from_uri(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class OneCsvFile(DataSource):
    """Write only; option ``path`` is the file's address with its scheme."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options["path"], [f.name for f in schema.fields])


def write_one_csv(df: DataFrame, path: str) -> None:
    """Write ``df`` as one CSV file with a header, rows in the order of its partitions.

    ``path`` must not exist; its folder is created. Without a scheme it lies on the session's file system. The driver
    copies the joined parts through a buffer, so it holds none of them.
    """
    address = qualified(df.sparkSession, path)
    system, target = fs.FileSystem.from_uri(address)
    if system.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} exists already")
    df.sparkSession.dataSource.register(OneCsvFile)
    df.write.format(FORMAT).mode("append").option("path", address).save()
