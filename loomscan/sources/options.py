"""Settings of readers and planners, read strictly: those given to a scan or a step, then LOOMSCAN_… of the driver's environment.

concurrency       requests that a task keeps under way (16 on disks, 8 to object stores)
block_bytes       bytes of one request to an object store
memory_limit      bytes: of blocks that a task holds, and of one round of an iterator; -1 for no limit, 0 for the largest chunk
partition_policy  how a planned scan deals chunks to its parts: chunks, or files
batch_bytes       bytes of one batch of a broadcast schedule
alignment         where chunks may begin in a batch
scope             ranks that share what they read: those of a host (local), or all (global)
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from loomscan.functions.sizes import BLOCK_DEFAULT, BLOCK_FLOOR, CONCURRENCY

PREFIX = "LOOMSCAN_"
POLICIES = ("chunks", "files")
SCOPES = ("local", "global")


def whole_number(name: str, text: str, low: int | None = None, high: int | None = None) -> int:
    """The number that the whole of a text is; anything else, or a number out of range, is an error."""
    digits = text.removeprefix("-")
    if not (digits.isascii() and digits.isdigit()):
        raise ValueError(f"{name} must be a whole number, not {text!r}")
    value = int(text)
    if low is not None and value < low or high is not None and value > high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


@dataclass(frozen=True)
class Options:
    """memory_limit: -1 for none, 0 for the largest chunk, else bytes."""

    concurrency: int = CONCURRENCY["file"]
    block_bytes: int = BLOCK_DEFAULT["file"]
    memory_limit: int = 40_000_000_000
    partition_policy: str = POLICIES[0]
    batch_bytes: int = 1 << 30
    alignment: int = 512
    scope: str = SCOPES[0]

    @staticmethod
    def names() -> list[str]:
        return [f.name for f in fields(Options)]

    @staticmethod
    def read(kind: str = "file", environment: dict[str, str] | None = None, given: dict[str, str] | None = None) -> Options:
        """Settings for a kind of storage ("file" or "object"), from LOOMSCAN_… where not given. Blocks below the kind's floor are raised to it."""
        found: dict = {"concurrency": CONCURRENCY[kind], "block_bytes": BLOCK_DEFAULT[kind]}
        environment = dict(os.environ) if environment is None else environment
        ranges = {"concurrency": (1, None), "block_bytes": (1, None), "memory_limit": (-1, None), "batch_bytes": (1, None), "alignment": (0, 1 << 20)}
        for f in fields(Options):
            text = (given or {}).get(f.name, environment.get(PREFIX + f.name.upper()))
            if text is None:
                continue
            found[f.name] = whole_number(f.name, text, *ranges[f.name]) if f.name in ranges else text
        if found.get("partition_policy", POLICIES[0]) not in POLICIES:
            raise ValueError(f"partition_policy must be one of {POLICIES}")
        if found.get("scope", SCOPES[0]) not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}")
        found["block_bytes"] = max(found["block_bytes"], BLOCK_FLOOR[kind])
        return Options(**found)

    def request_limit(self, total: int, largest: int) -> int:
        """Bytes of one request under the memory limit; a limit below the largest chunk is an error."""
        if self.memory_limit == -1:
            return total
        if self.memory_limit == 0:
            return largest
        if self.memory_limit < largest:
            raise ValueError(f"memory limit {self.memory_limit} is below the largest chunk, {largest}")
        return min(self.memory_limit, total)
