"""Column functions for sizes, quotas, splits and status codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes and their texts; code 14 has none in the published table and gets one here.
STATUS = {
    0: "Request sent successfuly",
    1: "Finished all responses",
    2: "File access error",
    3: "End of file reached",
    4: "S3 not supported",
    5: "GLIBC version should be at least 2.29",
    6: "Increase process fd limit or decrease the concurrency level. Recommended value for the streamer alone is the concurrency multiplied by 64, in addition to your application fd usage",
    7: "Invalid request parameters",
    8: "Empty request parameters",
    9: "Streamer is handling previous request",
    10: "CA bundle file not found",
    11: "Unknown Error",
    12: "Error loading object storage plugin",
    13: "GCS not supported",
    14: "Azure Blob not supported",
}
NO_STATUS = "Invalid response code"

MIB = 1 << 20
#: Block sizes and concurrency by kind of storage.
BLOCK_FLOOR = {"file": 2 * MIB, "object": 5 * MIB}
BLOCK_DEFAULT = {"file": 2 * MIB, "object": 8 * MIB}
CONCURRENCY = {"file": 16, "object": 8}
FDS_PER_WORKER = 64
UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def status_text(code: Column) -> Column:
    """The text of a status code."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in STATUS.items()))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(NO_STATUS))


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _two_decimals(n: Column) -> Column:
    """n / 1000 with two decimals, rounded as the nearest double of n / 1000 is (ties of it to even)."""
    d = n / F.lit(1000.0)
    high = F.lit(134217729.0) * d - (F.lit(134217729.0) * d - d)
    over = (d * 1000.0 - n) + ((high * 1000.0 - d * 1000.0) + (d - high) * 1000.0)  # exact: 1000 times what the double has too much
    cut = div(n, 10)
    up = F.when(F.pmod(n, F.lit(10)) != 5, F.pmod(n, F.lit(10)) > 5).when(over != 0, over > 0).otherwise(F.pmod(cut, F.lit(2)) == 1)
    cents = cut + up.cast("bigint")
    return F.concat(div(cents, 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


def human_size(n: Column, wide: Column | None = None) -> Column:
    """A size in powers of 1000 with two decimals; the whole number of each power is cut before the next.

    wide: the size as a decimal without decimals, which counts where n is null as it is beyond a long.
    The unit is picked first and one number is formatted, inside a lambda that names it once, so that expressions stay small.
    """
    value = n.cast("bigint")
    steps = [(F.lit(1000**i).cast("bigint"), u) for i, u in enumerate(UNITS)]
    # the value in thousandths of its unit: cut at the power below the unit
    found = F.struct(value.alias("n"), F.lit("B").alias("unit"))
    for (power, u), (below, _) in zip(steps[1:], steps, strict=False):
        found = F.when(value >= power, F.struct(div(value, below).alias("n"), F.lit(u).alias("unit"))).otherwise(found)
    if wide is not None:
        exa = F.struct(div(wide, F.lit(1000**5).cast("decimal(38,0)")).alias("n"), F.lit("EB").alias("unit"))
        found = F.when(value.isNull() & (wide > 0), exa).otherwise(found)
    text = lambda x: F.when(x["unit"] == "B", F.concat(x["n"].cast("string"), F.lit(".00 B"))).otherwise(F.concat(_two_decimals(x["n"]), F.lit(" "), x["unit"]))
    readable = F.transform(F.array(found), text)[0]
    return readable if wide is None else F.when(value.isNull() & (wide < 0), F.concat(wide.cast("string"), F.lit(".00 B"))).otherwise(readable)


def block_bytes(wanted: Column, kind: str = "file") -> Column:
    return F.greatest(wanted, F.lit(BLOCK_FLOOR[kind]))


def worker_count(total: Column, block: Column, concurrency: Column | int) -> Column:
    return F.greatest(F.least(div(total, block), concurrency if isinstance(concurrency, Column) else F.lit(concurrency).cast("bigint")), F.lit(1).cast("bigint"))


def worker_base(total: Column, block: Column, workers: Column) -> Column:
    """Bytes of every worker but the first, which also gets what is left."""
    return div(div(total, block), workers) * block


def fd_budget(concurrency: Column) -> Column:
    return concurrency * FDS_PER_WORKER


def client_concurrency(default: Column, processors: Column, workers: Column, group: Column | int = 1) -> Column:
    """Requests that one client of an object store keeps open."""
    share = workers * (group if isinstance(group, Column) else F.lit(group))
    return F.greatest(default, div(processors * 2, share))


def padding(offset: Column, alignment: int) -> Column:
    return F.pmod(-offset, F.lit(alignment))


def range_status(begin: Column, end: Column, total: Column) -> Column:
    """The status code of a range [begin, end) of so many bytes: 0, or 7 if it isn't one."""
    return F.when((begin < 0) | (end < begin) | (end > total), 7).otherwise(0)


def little_endian(data: Column) -> Column:
    """The unsigned number (below 2^63) that 8 bytes encode, least byte first."""
    digits = F.hex(data)
    return sum((F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("bigint") * F.lit(1 << (8 * i)) for i in range(1, 8)), F.conv(F.substring(digits, 1, 2), 16, 10).cast("bigint"))


def element_count(shape: Column) -> Column:
    """The product of a shape; a scalar has one element."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)
