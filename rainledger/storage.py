"""Reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="rainledger-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


class Folder:
    """Parquet tables and small text files under a path of any file system that Spark reaches. They stay."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, where: str, act):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return act(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs(self.path(name), lambda fs, path: fs.delete(path, True))

    def names(self, name: str) -> list[str]:
        """Names of what lies in a folder, hidden files apart; none if there is no such folder."""
        found = self._fs(self.path(name), lambda fs, path: [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else [])
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def write_text(self, name: str, text: str) -> None:
        """Written beside and then renamed, so a reader sees the whole file or none."""
        self._fs(self.path(name), lambda fs, path: fs.mkdirs(path.getParent()))

        def put(fs, path):
            out = fs.create(path, True)
            out.write(bytearray(text.encode()))
            out.close()

        self._fs(self.path(name) + ".tmp", put)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        self._fs(self.path(name) + ".tmp", lambda fs, path: (fs.delete(target, False), fs.rename(path, target)))

    def read_text(self, name: str) -> str:
        def get(fs, path):
            stream = fs.open(path)
            try:
                return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()

        return self._fs(self.path(name), get)


class Workspace(Folder):
    """Tables of one run, written as Parquet to the shared folder.

    A written table survives the loss of executors and ends the lineage. The whole workspace is
    deleted when the driver's JVM ends; `drop` frees a table earlier, `clear` all of them.
    """

    def __init__(self, spark: SparkSession, label: str):
        super().__init__(spark, f"{shared_root(spark)}/{label}-{uuid4().hex}")
        self._fs(self.root, lambda fs, path: fs.deleteOnExit(path))

    def clear(self) -> None:
        self._fs(self.root, lambda fs, path: fs.delete(path, True))
