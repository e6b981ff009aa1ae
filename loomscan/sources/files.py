"""Ranged reads, listings and copies over local paths and object stores, for drivers and executors alike.

Paths are plain local ones, file:// URIs, or s3://, gs:// and az:// URIs, which pyarrow's file systems serve under the settings
of loomscan.sources.storage. A root map (prefix to prefix) sends URIs elsewhere, such as to a local folder in tests.
"""

from __future__ import annotations

import fnmatch
import json
from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs

from loomscan.sources.options import Options
from loomscan.sources.storage import object_store

Roots = dict[str, str] | None
Store = dict[str, str] | None


class TensorFileError(ValueError):
    """A file that can't be read as asked: too short, not there, or not a valid tensor file."""


def remapped(path: str, roots: Roots) -> str:
    for prefix, root in sorted((roots or {}).items(), key=lambda x: -len(x[0])):
        if path.startswith(prefix):
            return root.rstrip("/") + "/" + path[len(prefix) :].lstrip("/")
    return path


def parse_roots(option: str | None) -> dict[str, str]:
    return json.loads(option) if option else {}


def scheme_of(path: str) -> str:
    """s3, gs, az, or file for everything else."""
    scheme = path.split("://", 1)[0] if "://" in path else ""
    return scheme if scheme in ("s3", "gs", "az") else "file"


def file_system(path: str, roots: Roots = None, store: Store = None) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    path = remapped(path, roots)
    scheme = scheme_of(path)
    if scheme != "file":
        return object_store(scheme, store), path.split("://", 1)[1]
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:  # hdfs:// and the like
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def check_range(path: str, offset: int, size: int) -> None:
    """A range must not begin before the file nor end before it begins, and offsets must fit a long."""
    if offset < 0 or size < 0 or offset + size >= 1 << 63:
        raise TensorFileError(f"Invalid request parameters: {path}: {size} bytes at {offset}")


class OpenFile:
    """A file open for ranged reads, from several threads at once."""

    def __init__(self, path: str, roots: Roots = None, store: Store = None):
        self.path = path
        system, local = file_system(path, roots, store)
        try:
            self.handle = system.open_input_file(local)
        except OSError as e:
            raise TensorFileError(f"File access error: {path}: {e}") from e

    def __enter__(self) -> OpenFile:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()

    def read(self, offset: int, size: int) -> bytes:
        """Exactly size bytes from offset; a file that ends before is an error. Of nothing, nothing is read."""
        check_range(self.path, offset, size)
        if size == 0:
            return b""
        try:
            data = self.handle.read_at(size, offset)
        except OSError as e:
            if offset > self.handle.size():
                raise TensorFileError(f"End of file reached: {self.path}: offset {offset} is beyond {self.handle.size()} bytes") from e
            raise TensorFileError(f"File access error: {self.path}: {e}") from e
        if len(data) != size:
            raise TensorFileError(f"End of file reached: {self.path}: {size} bytes at {offset} asked for, {len(data)} read")
        return data


def read_range(path: str, offset: int, size: int, roots: Roots = None, store: Store = None) -> bytes:
    """Exactly size bytes from offset; a file that ends before is an error."""
    with OpenFile(path, roots, store) as f:
        return f.read(offset, size)


def parts_of(size: int, part: int) -> list[tuple[int, int]]:
    """(offset, size) of the parts in which so many bytes are asked for: whole parts, the last with all that is left."""
    n = max(size // part, 1)
    return [(i * part, part if i < n - 1 else size - i * part) for i in range(n)]


def read_blocks(path: str, blocks: list[tuple[int, int]], roots: Roots = None, store: Store = None, options: Options | None = None) -> Iterator[pa.Buffer]:
    """The bytes of each (offset, size), in order, with one open. So many requests as concurrency says are under way at once, for
    parts of about block_bytes, and no more blocks are held than memory_limit allows (one at least)."""
    options = options or Options.read("file" if scheme_of(remapped(path, roots)) == "file" else "object")
    limit = options.memory_limit if options.memory_limit > 0 else max((n for _, n in blocks), default=0) if options.memory_limit == 0 else 1 << 62
    local = scheme_of(remapped(path, roots)) == "file"
    with OpenFile(path, roots, store) as f:
        # on disks a block is one request: they are read ahead; of object stores parts come side by side
        jobs = [(offset, size, [(0, size)] if local else parts_of(size, options.block_bytes)) for offset, size in blocks]
        if options.concurrency == 1 or sum(len(p) for _, _, p in jobs) < 2:
            for offset, size, _ in jobs:
                yield pa.py_buffer(f.read(offset, size))
            return
        with ThreadPoolExecutor(options.concurrency) as pool:
            waiting: deque[tuple[int, list[Future]]] = deque()
            held = requests = at = 0
            try:
                while at < len(jobs) or waiting:
                    while at < len(jobs) and (not waiting or held + jobs[at][1] <= limit and requests < 2 * options.concurrency):
                        offset, size, parts = jobs[at]
                        waiting.append((size, [pool.submit(f.read, offset + o, n) for o, n in parts]))
                        held, requests, at = held + size, requests + len(parts), at + 1
                    size, futures = waiting.popleft()
                    pieces = [x.result() for x in futures]
                    yield pa.py_buffer(pieces[0] if len(pieces) == 1 else b"".join(pieces))
                    held, requests = held - size, requests - len(futures)
            finally:
                for _, futures in waiting:
                    for x in futures:
                        x.cancel()


@dataclass(frozen=True)
class Found:
    path: str
    size: int


def wanted(name: str, allow: list[str] | None, ignore: list[str] | None) -> bool:
    """As column functions do it: directory markers go, then what no allow pattern matches, then what an ignore pattern matches."""
    if name.endswith("/") or allow is not None and not any(fnmatch.fnmatchcase(name, p) for p in allow):
        return False
    return not any(fnmatch.fnmatchcase(name, p) for p in ignore or [])


def listing(path: str, allow: list[str] | None = None, ignore: list[str] | None = None, recursive: bool = False, roots: Roots = None, store: Store = None) -> list[Found]:
    """Files below a folder or prefix, by path, in order. A folder that isn't there has none."""
    system, local = file_system(path, roots, store)
    base = local.rstrip("/")
    infos = system.get_file_info(fs.FileSelector(base, recursive=recursive, allow_not_found=True))
    prefix = path.rstrip("/") + "/"
    found = [Found(prefix + i.path[len(base) :].lstrip("/"), i.size) for i in infos if i.type == fs.FileType.File]
    return sorted((f for f in found if wanted(f.path, allow, ignore)), key=lambda f: f.path)


def list_tensor_files(path: str, roots: Roots = None, store: Store = None) -> list[str]:
    """Paths of the tensor files directly in a folder."""
    return [f.path for f in listing(path, allow=["*.safetensors"], roots=roots, store=store)]


def glob_files(pattern: str, roots: Roots = None, store: Store = None) -> list[Found]:
    """Files that match a pattern in which *, ? and [...] stand for characters other than /, and ** for any. The same for folders and for prefixes of stores."""
    parts = pattern.split("/")
    fixed = next(i for i, p in enumerate(parts) if any(c in p for c in "*?["))
    base, rest = "/".join(parts[:fixed]), parts[fixed:]

    def matches(names: list[str], patterns: list[str]) -> bool:
        if not patterns:
            return not names
        if patterns[0] == "**":
            return any(matches(names[i:], patterns[1:]) for i in range(len(names) + 1))
        return bool(names) and fnmatch.fnmatchcase(names[0], patterns[0]) and matches(names[1:], patterns[1:])

    found = listing(base or "/", recursive=len(rest) > 1, roots=roots, store=store)
    start = len(base.rstrip("/")) + 1
    return [f for f in found if matches(f.path[start:].split("/"), rest)]


def copy_file(source: str, target: str, roots: Roots = None, block: int = 8 << 20, store: Store = None) -> int:
    """Copy one file to a local path in blocks, under another name until it is whole; the bytes copied."""
    import os

    system, local = file_system(source, roots, store)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part, total = f"{target}.{os.getpid()}.part", 0
    with system.open_input_stream(local) as handle, open(part, "wb") as out:
        while data := handle.read(block):
            out.write(data)
            total += len(data)
    os.replace(part, target)
    return total
