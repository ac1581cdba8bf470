"""Numbered versions of a table in a folder, taken by whoever writes the number first.

Writers prepare data in folders of their own and then take the next number with a
small file that says where the data is.  The file is created only if it is absent
(a rename that fails on an existing target, as HDFS and object stores with
conditional writes give it), so of two writers one wins and the other
sees it and starts over on the new version.  A writer that stops halfway has taken no
number; what it wrote is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)]


class VersionLog:
    """The version files below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._dir = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        self._fs = self._dir.getFileSystem(self._conf)

    def latest(self) -> int | None:
        """The highest number taken."""
        if not self._fs.exists(self._dir):
            return None
        names = subfolders(self.spark, f"{self.path}/versions")
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=None)

    def read(self, version: int) -> dict:
        row = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()
        return json.loads(row.value)

    def take(self, version: int, content: dict) -> bool:
        """Whether ``version`` was still free and now has ``content``."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        draft = hadoop.Path(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(self._dir.toUri(), self._conf)
        target = hadoop.Path(f"{self.path}/versions/{version:012d}.json")
        try:
            context.rename(draft, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def publish(self, prepare: Callable[[int | None], dict | None], attempts: int = 10) -> int | None:
        """Take the next number with ``prepare(latest)``, again from the start where another was faster.

        ``prepare`` writes its data and returns the content of the version file, or None to leave
        things as they are.  Returns the number now in force.
        """
        for _ in range(attempts):
            last = self.latest()
            content = prepare(last)
            if content is None:
                return last
            if self.take(0 if last is None else last + 1, content):
                return 0 if last is None else last + 1
        raise RuntimeError(f"{attempts} attempts to publish below {self.path} were overtaken")
