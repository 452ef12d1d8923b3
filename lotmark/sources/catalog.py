"""Datasets as versions of Parquet tables under one root: publish, resolve, list, clean up. An unknown dataset is an error.

A version's tables are written to a folder of their own, which nothing points to until all of them are complete. Then
one small file, the commit, is put into the dataset's log under the next number, whole and only if no other writer has
taken that number. Readers take the highest commit, so they see all tables of a version or all of the one before, whenever a
writer fails; of two writers that started from one version, one gets an error and nothing of it is seen.
"""

from __future__ import annotations

import dataclasses
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"default|[0-9a-f]{32}")
COMMIT = re.compile(r"([0-9]{12})[.]json")


class UnknownDataset(LookupError):
    pass


class Conflict(RuntimeError):
    """Another writer has published since."""


@dataclasses.dataclass(frozen=True)
class Version:
    number: int
    folder: str
    tables: tuple[str, ...]


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def _write(spark: SparkSession, path: str, content: str) -> None:
    fs, at, _ = _files(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str:
    fs, at, jvm = _files(spark, path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replaced(spark: SparkSession, path: str, content: str) -> None:
    """Puts a small file in place of what was there: readers see the old or the new content, never a part. The new file is
    written beside it and renamed, which the file system does in one step."""
    pending = f"{path}.{uuid.uuid4().hex}.pending"
    _write(spark, pending, content)
    fs, at, jvm = _files(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(pending), at, options)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(pending), False)


def _claimed(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a file whole, unless there is one: of several that try at once, one does. A file system renames onto a name only if
    it's free; a local one would replace it, so there a second name is made for the finished file."""
    pending = f"{path}.{uuid.uuid4().hex}.pending"
    _write(spark, pending, content)
    fs, at, jvm = _files(spark, path)
    source = jvm.org.apache.hadoop.fs.Path(pending)
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            try:
                jvm.java.nio.file.Files.createLink(local(at), local(source))
                return True
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
        return not fs.exists(at) and bool(fs.rename(source, at))
    finally:
        fs.delete(source, False)


def _folder(root: str, dataset: str) -> str:
    if not NAME.fullmatch(dataset):
        raise ValueError(f"not a dataset id: {dataset!r}")
    return f"{root.rstrip('/')}/{dataset}"


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at, _ = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, root: str, dataset: str = "default") -> list[Version]:
    """All versions of a dataset, the oldest first."""
    folder = _folder(root, dataset)
    numbers = sorted(int(m[1]) for m in map(COMMIT.fullmatch, _children(spark, f"{folder}/log")) if m)
    said = [(n, json.loads(_read(spark, f"{folder}/log/{n:012d}.json"))) for n in numbers]
    return [Version(n, f"{folder}/versions/{x['version']}", tuple(x["tables"])) for n, x in said]


def current(spark: SparkSession, root: str, dataset: str = "default") -> Version:
    """The version that readers see. ValueError for a malformed id, UnknownDataset for one that isn't there."""
    folder = _folder(root, dataset)
    numbers = [int(m[1]) for m in map(COMMIT.fullmatch, _children(spark, f"{folder}/log")) if m]
    if not numbers:
        raise UnknownDataset(dataset)
    said = json.loads(_read(spark, f"{folder}/log/{max(numbers):012d}.json"))
    return Version(max(numbers), f"{folder}/versions/{said['version']}", tuple(said["tables"]))


def resolve(spark: SparkSession, root: str, dataset: str = "default") -> str:
    """The folder of the current version's tables, `<name>.parquet`."""
    return current(spark, root, dataset).folder


def listed(spark: SparkSession, root: str) -> list[str]:
    """The datasets that have a version."""
    return sorted(n for n in _children(spark, root) if NAME.fullmatch(n) and any(map(COMMIT.fullmatch, _children(spark, f"{root.rstrip('/')}/{n}/log"))))


def publish(spark: SparkSession, root: str, dataset: str, tables: dict[str, DataFrame], after: int | None = None, partitioned: dict[str, list[str]] | None = None) -> Version:
    """Writes the tables as the dataset's next version and makes it the current one, all at once.

    after: the number of the version that the tables were made from (0: none); the current one's, if None. Conflict if there is
    a later one, before or after the tables are written; then, as after any failure, what was written is removed and
    readers see what they saw before. partitioned: columns that a table's files are dealt out by.
    """
    folder = _folder(root, dataset)
    try:
        at = current(spark, root, dataset).number
    except UnknownDataset:
        at = 0
    if after is not None and after != at:
        raise Conflict(f"{dataset} is at {at}, not at {after}")
    name = uuid.uuid4().hex
    try:
        for table, df in tables.items():
            df.write.mode("errorifexists").partitionBy(*(partitioned or {}).get(table, [])).parquet(f"{folder}/versions/{name}/{table}.parquet")
        if not _claimed(spark, f"{folder}/log/{at + 1:012d}.json", json.dumps({"version": name, "tables": sorted(tables)})):
            raise Conflict(f"{dataset} has got a version {at + 1} meanwhile")
    except BaseException:
        fs, path, _ = _files(spark, f"{folder}/versions/{name}")
        fs.delete(path, True)
        raise
    return Version(at + 1, f"{folder}/versions/{name}", tuple(sorted(tables)))


def create(root: str, dataset: str, tables: dict[str, DataFrame]) -> str:
    """Publishes a new dataset; Conflict if there is one of that name."""
    spark = next(iter(tables.values())).sparkSession
    return publish(spark, root, dataset, tables, after=0).folder


def cleaned(spark: SparkSession, root: str, dataset: str, keep: int = 2) -> int:
    """Removes the files of all versions but the last `keep` that were published, and of writers that died before they
    published; gives the number of folders. No writer may be at work; the log keeps its numbers."""
    folder = _folder(root, dataset)
    kept = {v.folder.rpartition("/")[2] for v in versions(spark, root, dataset)[-max(keep, 1) :]}
    gone = [n for n in _children(spark, f"{folder}/versions") if n not in kept]
    for name in gone:
        fs, path, _ = _files(spark, f"{folder}/versions/{name}")
        fs.delete(path, True)
    return len(gone)
