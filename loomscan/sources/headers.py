"""Headers of tensor files: reading, checking, and making them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from loomscan.functions.dtypes import DTYPES
from loomscan.sources.files import OpenFile, Roots, Store, TensorFileError

HEADER_LIMIT = 100 * 1024 * 1024
LENGTH_BYTES = 8


@dataclass(frozen=True)
class Tensor:
    """One tensor of a file, with offsets in its data section, which begins at base."""

    index: int
    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int
    end: int
    base: int

    @property
    def size(self) -> int:
        return self.end - self.start


def parse_length(data: bytes) -> int:
    if len(data) < LENGTH_BYTES:
        raise TensorFileError("Corrupted file: truncated or empty")
    n = int.from_bytes(data[:LENGTH_BYTES], "little")
    if n > HEADER_LIMIT:
        raise TensorFileError(f"Corrupted file: header size {n} exceeds limit of {HEADER_LIMIT} bytes")
    return n


def element_count(shape: tuple[int, ...]) -> int:
    count = 1
    for x in shape:
        count *= x
    return count


def parse_header(body: bytes) -> list[Tensor]:
    """The checked tensors of a header, by start. They must leave no gap, not overlap, and begin at 0."""
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise TensorFileError("Corrupted header: not valid UTF-8") from e
    try:
        entries = json.loads(text)
    except ValueError as e:
        raise TensorFileError("Corrupted header: not valid JSON") from e
    if not isinstance(entries, dict):
        raise TensorFileError("Corrupted header: not valid JSON: no object")
    raw = []
    for name, entry in entries.items():
        if name == "__metadata__":
            continue
        if not isinstance(entry, dict) or any(k not in entry for k in ("data_offsets", "dtype", "shape")):
            missing = next((k for k in ("data_offsets", "dtype", "shape") if not isinstance(entry, dict) or k not in entry), "")
            raise TensorFileError(f"Corrupted header: tensor {name!r} is missing {missing}")
        dtype, shape, (start, end) = entry["dtype"], tuple(entry["shape"]), entry["data_offsets"]
        if dtype not in DTYPES:
            raise TensorFileError(f"Unsupported dtype {dtype!r} of tensor {name!r}")
        claimed = element_count(shape) * DTYPES[dtype].width
        if claimed != end - start:
            raise TensorFileError(f"Corrupted header: tensor {name!r}: Shape claims {claimed} bytes, but offsets reserve {end - start}")
        if start > end:
            raise TensorFileError(f"Corrupted Offset: tensor {name!r} starts at {start} and ends at {end}")
        raw.append((start, end, name, dtype, shape))
    raw.sort(key=lambda x: x[:2])
    at, before = 0, None
    for start, end, name, _, _ in raw:
        if start < at:
            raise TensorFileError(f"Corrupted header: tensor {before!r} overlaps with next tensor {name!r}")
        if start > at:
            raise TensorFileError(f"Corrupted header: gap of {start - at} bytes before tensor {name!r}")
        at, before = end, name
    base = LENGTH_BYTES + len(body)
    return [Tensor(i, name, dtype, shape, start, end, base) for i, (start, end, name, dtype, shape) in enumerate(raw)]


def header_of(f: OpenFile) -> list[Tensor]:
    """The tensors of an open file, by two small reads."""
    try:
        n = parse_length(f.read(0, LENGTH_BYTES))
    except TensorFileError as e:
        if "End of file" in str(e):
            raise TensorFileError(f"{f.path}: Corrupted file: truncated or empty") from e
        raise TensorFileError(f"{f.path}: {e}") from e
    try:
        return parse_header(f.read(LENGTH_BYTES, n))
    except TensorFileError as e:
        raise TensorFileError(f"{f.path}: {e}") from e


def read_header(path: str, roots: Roots = None, store: Store = None) -> list[Tensor]:
    """The tensors of a file."""
    with OpenFile(path, roots, store) as f:
        return header_of(f)


def make_header(entries: list[tuple[str, str, list[int], int]]) -> bytes:
    """The length and JSON of a file whose tensors (name, dtype, shape, bytes) follow each other."""
    at, found = 0, {}
    for name, dtype, shape, size in entries:
        found[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + size]}
        at += size
    body = json.dumps(found, separators=(",", ":")).encode()
    body += b" " * (-len(body) % 8)
    return len(body).to_bytes(LENGTH_BYTES, "little") + body
