"""Walking a script tree in tasks.

Unlike Spark's own listing, the walk sees hidden names.  It goes level by level: the
folders found in one round are dealt to the tasks of the next, so the driver lists
nothing and a wide level is walked by many tasks; there are as many rounds as the tree is deep.  What a
round finds is a table in the shared folder, so a lost executor costs one round at most.

Tasks reach the files themselves, through the operating system for local and mounted
paths and through pyarrow's file systems for other URIs (``hdfs://``, ``s3://``, ...).
Links aren't followed.  A name that isn't valid UTF-8 fails the walk.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.session import work_path

#: Bytes of content in one Arrow batch; a longer file makes a batch of its own.
BATCH_BYTES = 8 << 20
#: Entries of a listing in one Arrow batch.
BATCH_ROWS = 10_000


def _local(root: str) -> str | None:
    """``root`` as a path of the operating system, None for other stores."""
    parsed = urlparse(root)
    return root if not parsed.scheme else parsed.path if parsed.scheme == "file" else None


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path below the root, is folder, length) of what lies directly in a folder."""
    below = f"{folder}/" if folder else ""
    local = _local(root)
    if local is not None:
        with os.scandir(os.path.join(local, folder)) as found:
            for e in found:
                e.name.encode()  # a name that is not UTF-8 fails here
                if e.is_dir(follow_symlinks=False):
                    yield below + e.name, True, 0
                elif e.is_file(follow_symlinks=False):
                    yield below + e.name, False, e.stat().st_size
        return
    store, base = pafs.FileSystem.from_uri(root)
    for e in store.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"))):
        yield below + e.base_name, e.type == pafs.FileType.Directory, e.size or 0


def _content(root: str, path: str) -> bytes:
    local = _local(root)
    if local is not None:
        with open(os.path.join(local, path), "rb") as f:
            return f.read()
    store, base = pafs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base}/{path}") as f:
        return f.read()


def walk_tree(spark: SparkSession, root: str, suffix: str = ".sql") -> DataFrame:
    """``path`` (relative, ``/``) and ``length`` of all files below ``root`` whose name
    ends in ``suffix``, in any case; hidden names included."""
    root, suffix = root.rstrip("/"), suffix.lower()

    def listed(batches):
        kind = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64())])
        rows: list[tuple[str, bool, int]] = []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

        for b in batches:
            for folder in b["path"].to_pylist():
                for entry in _entries(root, folder):
                    if entry[1] or entry[0].lower().endswith(suffix):
                        rows.append(entry)
                    if len(rows) >= BATCH_ROWS:
                        yield ready()
                        rows.clear()
        if rows:
            yield ready()

    level = spark.createDataFrame([("",)], "path string")
    found: DataFrame | None = None
    while True:
        at = work_path(spark, "walk")
        level.repartition("path").mapInArrow(listed, "path string, is_folder boolean, length long").write.parquet(at)
        entries = spark.read.parquet(at)
        files = entries.filter(~F.col("is_folder")).select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = entries.filter("is_folder").select("path")
        if level.isEmpty():
            return found


def read_scripts(files: DataFrame, root: str) -> DataFrame:
    """``files`` (``path`` and more) with ``content``; dealt anew, so that one full folder
    is read by many tasks."""
    root = root.rstrip("/")

    def run(batches):
        for b in batches:
            paths = b["path"].to_pylist()
            start, size, held = 0, 0, []
            for i, path in enumerate(paths):
                held.append(_content(root, path))
                size += len(held[-1])
                if size >= BATCH_BYTES or i == len(paths) - 1:
                    rows = b.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], [*rows.schema.names, "content"])
                    start, size, held = i + 1, 0, []

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition("path").mapInArrow(run, f"{fields}, content binary")


def write_scripts(scripts: DataFrame, root: str) -> None:
    """One file per row (``path``, ``content``) below ``root``, a local or mounted folder.

    A file is renamed into place when it is whole, so a task that is repeated does no harm.
    """
    local = _local(root.rstrip("/"))
    if local is None:
        raise ValueError("scripts are written to local or mounted folders only")

    def run(rows):
        for r in rows:
            target = os.path.join(local, r.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = f"{target}.{uuid.uuid4().hex}"
            with open(draft, "wb") as f:
                f.write(r.content)
            os.replace(draft, target)

    scripts.select("path", F.col("content").cast("binary").alias("content")).foreachPartition(run)
