"""A data source of small named text records, one file ``<name>_metrics.txt`` each, with a commit.

Tasks write into a folder of the job's own. When all are done the driver writes
the job's list of files under a name that appears at once: from then on the job
counts, and readers take the listed files in place of older ones. Then the files
get their final names, each by one replacing move, and the list goes. A driver
lost in between leaves the list, and whoever writes next finishes the moves. A
job that fails before its list is there leaves nothing to be read.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "record_files"
SUFFIX = "_metrics.txt"
_LIST, _JOBS = ".committed-", ".jobs"
#: Files of one reading task.
FILES_PER_TASK = 256


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _listed(system: fs.FileSystem, folder: str, recursive: bool = False) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))


def _is_file(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).is_file


def _records(system: fs.FileSystem, folder: str) -> dict[str, str]:
    """Final files below ``folder`` by their place in it."""
    found = {}
    for info in _listed(system, folder, recursive=True):
        below = info.path[info.path.rindex(folder.rstrip("/")) + len(folder.rstrip("/")) + 1 :]
        if info.is_file and below.endswith(SUFFIX) and not below.startswith("."):
            found[below] = info.path
    return found


def _lists(system: fs.FileSystem, folder: str) -> list[tuple[str, dict]]:
    """Jobs that count but whose files may not have their final names yet, oldest first."""
    found = []
    for info in _listed(system, folder):
        if info.base_name.startswith(_LIST):
            with system.open_input_stream(info.path) as f:
                found.append((info.path, json.loads(f.read())))
    return sorted(found, key=lambda x: x[1]["order"])


def _finish(system: fs.FileSystem, folder: str) -> None:
    """Give the files of committed jobs their final names."""
    for path, job in _lists(system, folder):
        for place, final in job["files"]:
            if _is_file(system, f"{folder}/{place}"):
                system.move(f"{folder}/{place}", f"{folder}/{final}")
        for final in job["removed"]:
            if _is_file(system, f"{folder}/{final}"):
                system.delete_file(f"{folder}/{final}")
        system.delete_file(path)
        _forget(system, folder, job["job"])


def _forget(system: fs.FileSystem, folder: str, job: str) -> None:
    if system.get_file_info(f"{folder}/{_JOBS}/{job}").type == fs.FileType.Directory:
        system.delete_dir(f"{folder}/{_JOBS}/{job}")
    if system.get_file_info(f"{folder}/{_JOBS}").type == fs.FileType.Directory and not _listed(system, f"{folder}/{_JOBS}"):
        system.delete_dir(f"{folder}/{_JOBS}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # record name, place below the folder


class RecordWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, columns: Sequence[str]):
        missing = {"name", "value"} - set(columns)
        if missing:
            raise ValueError(f"records need columns name and value; there is no {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, folder = _opened(self.path)
        # A folder for each attempt, so that two attempts of a task never meet.
        below, files = f"{_JOBS}/{self.job}/{uuid.uuid4().hex}", []
        for i, row in enumerate(rows):
            if not row["name"] or row["value"] is None:
                raise ValueError("a record has a name and a value")
            if not files:
                system.create_dir(f"{folder}/{below}", recursive=True)
            with system.open_output_stream(f"{folder}/{below}/{i}") as f:
                f.write(row["value"].encode())
            files.append((row["name"].replace("/", "_"), f"{below}/{i}"))
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        _finish(system, folder)
        before, count, files = _records(system, folder), Counter(), []
        for name, place in sorted(f for m in messages if m is not None for f in m.files):
            count[name] += 1
            files.append((place, f"{name}{SUFFIX}" if count[name] == 1 else f"{name}-{count[name]}{SUFFIX}"))
        finals = {final for _, final in files}
        stale = [p for p in before if p not in finals and (self.overwrite or self._numbered(p, count))]
        # One writer at a time: lists are in the order of what was there before.
        job = {"job": self.job, "order": len(_lists(system, folder)), "files": files, "removed": stale}
        draft = f"{folder}/.draft-{self.job}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(job).encode())
        system.move(draft, f"{folder}/{_LIST}{self.job}")
        _finish(system, folder)

    @staticmethod
    def _numbered(place: str, count: Counter) -> bool:
        """A further record of a name that this job wrote, from a job that had more of them."""
        name, _, number = place.removesuffix(SUFFIX).rpartition("-")
        return number.isdigit() and int(number) > count[name] > 0

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        _forget(system, folder, self.job)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class RecordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        system, folder = _opened(self.path)
        records = _records(system, folder)
        for _, job in _lists(system, folder):
            records |= {final: f"{folder}/{place}" for place, final in job["files"] if _is_file(system, f"{folder}/{place}")}
            records = {final: path for final, path in records.items() if final not in job["removed"]}
        files = [(final.rsplit("/", 1)[-1].removesuffix(SUFFIX), path) for final, path in sorted(records.items())]
        return [Files(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, _ = _opened(self.path)
        for name, place in partition.files:
            with system.open_input_stream(place) as f:
                yield name, f.read().decode("utf-8", "replace")


class RecordSource(DataSource):
    """``spark.read.format("record_files").load(folder)`` and ``df.write.format("record_files").save(folder)``: columns ``name, value``.

    Records of one name in one job are all kept, the second as ``<name>-2`` and
    so on; a later job's record replaces those of its name.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, value string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
