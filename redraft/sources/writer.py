"""Writer of changed files: all files of a run are published together, or none.

Each task writes its files to a folder of its own attempt below the pending folder of the run, and tells the driver that
folder's name.  The commit gathers the folders of the attempts that counted, one rename each, and then publishes the run by renaming their folder to
`run=<run>`.  What failed or repeated attempts wrote is never gathered; an abort removes all that is pending.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "published_files"


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and how many files it holds."""

    folder: str
    files: int


def _store(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def _inside(file: str) -> str:
    """A file's path below the folder of its run: no scheme, no leading slash; one that would lead out of it is refused."""
    path = file.split("://", 1)[-1].removeprefix("file:").lstrip("/")
    if not path or ".." in path.split("/"):
        raise ValueError(f"not a path below the run: {file}")
    return path


class Publisher(DataSourceWriter):
    def __init__(self, root: str, run: str):
        if not run or "/" in run:
            raise ValueError("a run's name is one part of a path")
        self.root, self.run = root.rstrip("/"), run
        self.pending = f"{self.root}/_pending-{run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, count = f"{self.pending}/{uuid.uuid4().hex}", 0
        store, base = _store(folder)
        made = set()
        for row in iterator:
            path = f"{base}/{_inside(row['file'])}"
            parent = path.rsplit("/", 1)[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(path) as out:
                out.write((row["text"] or "").encode("utf-8", "surrogatepass"))
            count += 1
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        _, pending = _store(self.pending)
        from pyarrow import fs

        target = f"{root}/run={self.run}"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(f"run {self.run} is there already")
        ready = f"{pending}/ready"
        store.create_dir(ready, recursive=True)
        for number, told in enumerate(m for m in messages if m is not None and m.files):  # a rename for each task
            store.move(_store(told.folder)[1], f"{ready}/{number}")
        store.move(ready, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, pending = _store(self.pending)
        from pyarrow import fs

        if store.get_file_info(pending).type != fs.FileType.NotFound:
            store.delete_dir(pending)


class PublishedFiles(DataSource):
    """Data source `published_files`: writes rows (file, text) below options path and run."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> Publisher:
        if not {"file", "text"} <= set(schema.names):
            raise ValueError("rows need file and text")
        return Publisher(self.options["path"], self.options["run"])


def publish(files: DataFrame, root: str, run: str) -> None:
    """Write files (file, text) as run of a root folder that driver and executors share: `<root>/run=<run>/<task>/<file>`.  A run that is there already is left as it is, with an error."""
    spark = files.sparkSession
    spark.dataSource.register(PublishedFiles)
    files.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text")).write.format(FORMAT).option("path", root).option("run", run).mode("append").save()


def published(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(file, text) of a published run; empty files have no rows."""
    rows = spark.read.option("recursiveFileLookup", "true").text(f"{root.rstrip('/')}/run={run}", wholetext=True)
    return rows.select(F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"/run=[^/]+/[0-9]+/(.*)$", 1).alias("file"), F.col("value").alias("text"))
