"""Copies of remote files on local disks, whole or not at all."""

from __future__ import annotations

import fcntl
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from loomscan.sources.files import copy_file, listing, remapped

REMOTE = ("s3://", "gs://", "az://")


def pull_files(path: str, target: str, allow: list[str] | None = None, ignore: list[str] | None = None, roots: dict[str, str] | None = None, spark: SparkSession | None = None, store: dict[str, str] | None = None) -> int:
    """Copy what lies below a remote prefix to a folder, keeping relative paths; how many files. Nothing that matches is no error.

    With a session the copies run as tasks, for a target that all executors share; a task that is tried again copies anew.
    """
    if not path.startswith(REMOTE):
        raise NotImplementedError(f"only object stores can be pulled from, not {path!r}")
    prefix = path.rstrip("/") + "/"
    found = listing(prefix, allow, ignore, recursive=True, roots=roots, store=store)
    pairs = [(f.path, os.path.join(target, f.path.removeprefix(prefix))) for f in found]
    if spark is None or len(pairs) < 2:
        for source, to in pairs:
            copy_file(source, to, roots, store=store)
        return len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [copy_file(source, to, roots, store=store) for source, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, type=pa.int64())], names=["size"])

    tasks = min(len(pairs), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(pairs, "source string, target string").repartition(tasks).mapInArrow(run, "size bigint").count()


class Materialized:
    """A context in which a remote prefix is pulled to a folder once, however many processes ask for it.

    A shared lock looks for the mark of a whole copy; without it an exclusive lock is taken (never by promotion, which can
    deadlock), the mark is looked for again, and what is there of an earlier attempt is removed. The mark is set only when the
    context ends without an error; an empty copy is an error.
    """

    MARK = ".loomscan_complete"

    def __init__(self, path: str, target: str, roots: dict[str, str] | None = None, store: dict[str, str] | None = None):
        if not path.startswith(REMOTE):
            raise ValueError(f"{path!r} is not an object-store path (expected s3://, gs:// or az://)")
        self.path, self.roots, self.store = path.rstrip("/") + "/", roots, store
        self.dir = target.rstrip("/") or "/"
        self.mark = os.path.join(self.dir, self.MARK)
        self.done = False
        os.makedirs(os.path.dirname(self.dir) or ".", exist_ok=True)
        self.lock = open(self.dir + ".lock", "a")  # noqa: SIM115
        try:
            self._begin()
        except BaseException:
            self._release()
            raise

    def _begin(self) -> None:
        fcntl.flock(self.lock, fcntl.LOCK_SH)
        if os.path.exists(self.mark):
            self.done = True
            return
        fcntl.flock(self.lock, fcntl.LOCK_UN)
        fcntl.flock(self.lock, fcntl.LOCK_EX)
        if os.path.exists(self.mark):
            self.done = True
            fcntl.flock(self.lock, fcntl.LOCK_SH)
            return
        shutil.rmtree(self.dir, ignore_errors=True)
        os.makedirs(self.dir)

    def _release(self) -> None:
        if not self.lock.closed:
            fcntl.flock(self.lock, fcntl.LOCK_UN)
            self.lock.close()

    def pull(self, allow: list[str] | None = None, ignore: list[str] | None = None) -> int:
        return 0 if self.done else pull_files(self.path, self.dir, allow, ignore, self.roots, store=self.store)

    def __enter__(self) -> Materialized:
        return self

    def __exit__(self, kind, value, trace) -> bool:
        try:
            if kind is None and not self.done:
                if not [f for f in os.listdir(self.dir) if f != self.MARK]:
                    raise RuntimeError(f"no files were copied to {self.dir!r}: is {self.path!r} right?")
                with open(self.mark, "w"):
                    pass
        finally:
            self._release()
        return False


def mocked(path: str, roots: dict[str, str]) -> str:
    """Where a remote path lies under a root map."""
    return remapped(path, roots)


def unmocked(path: str, roots: dict[str, str]) -> str:
    """The remote path of a file under a root map."""
    for prefix, root in roots.items():
        base = root.rstrip("/") + "/"
        if path.startswith(base):
            return prefix.rstrip("/") + "/" + path[len(base) :]
    return path
