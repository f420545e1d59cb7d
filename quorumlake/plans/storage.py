"""Where tables that outlive a query lie: the cluster's shared folder, small files beside them, and fingerprints of inputs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see. In local mode a temporary folder stands for it where
    it is unset; on a cluster that is an error, since a folder of the driver's machine would not do."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not available(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own[context.applicationId] = folder
    return folder.rstrip("/")


def available(spark: SparkSession) -> bool:
    """Whether there is a shared folder: it is set, or the master is local."""
    context = spark.sparkContext
    return bool(context.getConf().get("spark.checkpoint.dir")) or context.master.startswith("local") and not context.master.startswith("local-cluster")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, not yet made."""
    return f"{shared_root(spark)}/{name}/{uuid.uuid4().hex}"


class Files:
    """Small files and renames on whatever file system a path is of."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self.system = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self._path(folder)))

    def publish(self, path: str, value: object) -> bool:
        """Write value as JSON under path, whole or not at all; False if the file is there already."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        out = self.system.create(self._path(draft), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self.exists(path) and self.system.rename(self._path(draft), self._path(path)):
            return True
        self.system.delete(self._path(draft), False)
        return False

    def read(self, path: str) -> object:
        stream = self.system.open(self._path(path))
        data = self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        stream.close()
        return json.loads(bytes(data).decode())

    def delete(self, path: str) -> None:
        self.system.delete(self._path(path), True)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes when a file of the paths is added, removed or written again."""
    seen = []
    for path in paths:
        files = Files(spark, path)
        todo = [files._path(path)]
        while todo:
            for s in files.system.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:20]


def stored(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table called name in the shared folder, derived by build() where it isn't there for these sources' files yet."""
    path = f"{shared_root(spark)}/stored/{name}-{fingerprint(spark, sources)}"
    files = Files(spark, path)
    if not files.exists(f"{path}/ready"):
        frame = build()
        data = f"data-{uuid.uuid4().hex}"  # runs that build it at once don't write over each other
        frame.write.option("compression", "zstd").parquet(f"{path}/{data}")
        files.publish(f"{path}/ready", {"data": data, "schema": frame.schema.json()})
    held = files.read(f"{path}/ready")
    return spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(f"{path}/{held['data']}")
