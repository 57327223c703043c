"""A stored table of messages with saves that are whole or not at all.

The table is a folder of immutable data and a list of versions:

    data/<save>/bucket=<n>/*.parquet     the rows of the buckets that one save has touched
    versions/<number>                    for each bucket, the save that holds its rows

A save rewrites the buckets of the sessions it touches into a new data folder, then puts the next version in place by one
rename that fails if that version is there already. Readers take the newest version, so they see all of a save or none of
it; a save that fails leaves data that no version names, and ``vacuum`` removes it. Buckets that aren't touched keep their files.

The driver handles one line a bucket. Ids belong to one session: equal ids in different sessions are different rows.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.memory import save_turns
from tracemill.sources.tables import MESSAGES


class ConflictError(Exception):
    """Another save has come first; the whole save can be tried again."""


class MessageStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        root = self._hadoop.Path(f"{self.path}/versions")
        self._fs = root.getFileSystem(conf)
        self._fs.mkdirs(root)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), conf)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """The numbers of the versions there are, oldest first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(f"{self.path}/versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Where the rows of each bucket are, in a version or the newest one."""
        numbers = self.versions()
        if version is None and not numbers:
            return {}
        at = self._hadoop.Path(f"{self.path}/versions/{numbers[-1] if version is None else version}")
        stream = self._fs.open(at)
        try:
            lines = bytes(stream.readAllBytes()).decode().splitlines()
        finally:
            stream.close()
        return {int(b): save for b, save in (line.split("\t") for line in lines)}

    def _paths(self, folders: dict[int, str]) -> list[str]:
        return [f"{self.path}/data/{save}/bucket={b}" for b, save in sorted(folders.items())]

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        return self.spark.read.schema(MESSAGES).parquet(*self._paths(folders)) if folders else self.spark.createDataFrame([], MESSAGES)

    def read(self, version: int | None = None) -> DataFrame:
        """All messages of a version, or of the newest one."""
        return self._rows(self.folders(version))

    def read_sessions(self, sessions: DataFrame) -> DataFrame:
        """The messages of some sessions: only their buckets are read."""
        wanted = {r[0] for r in sessions.select(self._bucket()).distinct().collect()}
        rows = self._rows({b: save for b, save in self.folders().items() if b in wanted})
        return rows.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select(*rows.columns)

    def save(self, new: DataFrame, order: str = "write_seq") -> int:
        """Upserts messages by id, the highest ``order`` last, and returns the new version. Without rows nothing is saved."""
        number, before = (self.versions() or [0])[-1], self.folders()
        touched = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        if not touched:
            return number
        merged = save_turns(self._rows({b: save for b, save in before.items() if b in touched}), new, order=order)
        save = uuid.uuid4().hex
        dealt = merged.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "session_id", "seq")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{save}")
        self._commit(number + 1, before | dict.fromkeys(touched, save))
        return number + 1

    def _commit(self, number: int, folders: dict[int, str]) -> None:
        """Puts a version in place, or raises ConflictError."""
        temporary, final = self._hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{self.path}/versions/{number}")
        out = self._fs.create(temporary, False)
        try:
            out.write("".join(f"{b}\t{save}\n" for b, save in sorted(folders.items())).encode())
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        try:
            self._context.rename(temporary, final, options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConflictError(f"version {number} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the newest ``keep`` versions, and data that no version left names. Not while a save is running."""
        numbers = self.versions()
        for n in numbers[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/versions/{n}"), False)
        named = {save for n in numbers[-keep:] for save in self.folders(n).values()}
        data = self._hadoop.Path(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)
