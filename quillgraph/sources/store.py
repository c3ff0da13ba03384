"""Tables as versions of Parquet folders. A change writes its own rows and then names a new version current.

A version is a list of folders, each with the projects whose rows in it no longer count; so a change adds a folder, and
rows of other projects are neither read nor written. Versions are numbered; a writer makes the one after that which
it read, and if another was quicker it raises ``Conflict``. Readers of a version are never disturbed, and a job that
fails leaves the current one as it was. Numbering needs a file system that creates a file once only, as HDFS and local ones do.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.schemas import TABLES, conform, empty


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; removed when Python exits.

    A local folder stands in where that setting is unset and the master is local; on a cluster that raises.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        _FOLDERS[app] = f"{base.rstrip('/')}/quillgraph-{app}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes the folder if the JVM still answers; a cluster's folder policy does it otherwise."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """``df``, written once to the shared folder and reread.

    It cuts lineage, and what it holds outlives executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer made a new version of the table since it was read."""


#: Folders of a version beyond which a change rewrites the table as one.
MOST_FOLDERS = 24
#: Seconds after which a claimed version that never came may be claimed again.
CLAIM_SECONDS = 600


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._seen = threading.local()

    def _versions(self, table: str) -> list[int]:
        folder = self._path(f"{self.path}/{table}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit() and s.getLen())

    def _list(self, table: str, version: int) -> list[dict]:
        stream = self._fs.open(self._path(f"{self.path}/{table}/versions/{version:08d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self, table: str) -> list[dict]:
        """Folders of the current version, which this thread's next change follows."""
        version = (self._versions(table) or [0])[-1]
        self._seen.__dict__[table] = version
        return self._list(table, version) if version else []

    def _rows(self, table: str, folders: list[dict]) -> DataFrame:
        schema = empty(self.spark, table).schema
        by_gone: dict[tuple, list[str]] = {}
        for f in folders:
            by_gone.setdefault(tuple(f["without"]), []).append(f["path"])
        out = None
        for gone, paths in by_gone.items():
            rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{table}/{p}" for p in paths])
            rows = rows.where(F.col("project_id").isNull() | ~F.col("project_id").isin(*gone)) if gone else rows
            out = rows if out is None else out.unionByName(rows)
        return empty(self.spark, table) if out is None else out

    def read(self, table: str) -> DataFrame:
        """The current version, or an empty table."""
        return self._rows(table, self._current(table))

    def _put(self, table: str, rows: DataFrame) -> dict:
        name = f"rows-{uuid.uuid4().hex}"
        conform(rows, table).write.parquet(f"{self.path}/{table}/{name}")
        return {"path": name, "without": []}

    def _commit(self, table: str, folders: list[dict], after: int) -> DataFrame:
        target = self._path(f"{self.path}/{table}/versions/{after + 1:08d}")
        whole = self._path(f"{self.path}/{table}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(whole, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        try:  # the marker claims the number; the list follows by renaming
            claim = self._path(f"{self.path}/{table}/versions/{after + 1:08d}.claim")
            if self._fs.exists(claim) and not self._fs.exists(target) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                self._fs.delete(claim, False)  # its writer died
            try:
                self._fs.create(claim, False).close()
            except Exception as error:
                raise Conflict(f"{table}: version {after + 1} is another writer's") from error
            self._fs.rename(whole, target)
        finally:
            self._fs.delete(whole, False)
        self._seen.__dict__[table] = after + 1
        return self._rows(table, folders)

    def _before(self, table: str) -> tuple[int, list[dict]]:
        """The version that this thread has read, and its folders."""
        if table not in self._seen.__dict__:
            self._current(table)
        version = self._seen.__dict__[table]
        return version, self._list(table, version) if version else []

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """A new version that holds these rows alone; it becomes current when it is whole."""
        version, _ = self._before(table)
        return self._commit(table, [self._put(table, rows)], version)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """A new version with these rows besides the others, which aren't read."""
        version, folders = self._before(table)
        return self._compact(table, self._commit(table, [*folders, self._put(table, rows)], version))

    def replace(self, table: str, project_id: int, rows: DataFrame) -> DataFrame:
        """A new version in which these rows are all that the project has; other projects' aren't read."""
        version, folders = self._before(table)
        left = [f | {"without": sorted({*f["without"], project_id})} for f in folders]
        return self._compact(table, self._commit(table, [*left, self._put(table, rows)], version))

    def _compact(self, table: str, rows: DataFrame) -> DataFrame:
        _, folders = self._before(table)
        return self.write(table, rows) if len(folders) > MOST_FOLDERS else rows

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions but the last ``keep`` of each table, and folders that none of these lists; returns how many folders went. Not while others write."""
        gone = 0
        for table in TABLES:
            versions = self._versions(table)
            used = {f["path"] for v in versions[-keep:] for f in self._list(table, v)}
            for v in versions[:-keep]:
                self._fs.delete(self._path(f"{self.path}/{table}/versions/{v:08d}"), False)
            folder = self._path(f"{self.path}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if s.getPath().getName().startswith("rows-") and s.getPath().getName() not in used:
                    gone += bool(self._fs.delete(s.getPath(), True))
        work = self._path(f"{self.path}/work")
        if self._fs.exists(work):
            self._fs.delete(work, True)
        return gone

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in TABLES}

    def update(self, changed: dict[str, DataFrame]) -> None:
        for table, rows in changed.items():
            self.write(table, rows)
