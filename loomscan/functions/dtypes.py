"""Element types of tensor files: widths, Spark types and exact decoders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class DType:
    name: str
    width: int
    spark: str | None
    decode: Callable[[bytes], list] | None


def _plain(kind: str) -> Callable[[bytes], list]:
    return lambda data: np.frombuffer(data, dtype=kind).tolist()


def _bf16(data: bytes) -> list:
    return (np.frombuffer(data, dtype="<u2").astype("<u4") << np.uint32(16)).view("<f4").tolist()


def _half(data: bytes) -> list:
    return np.frombuffer(data, dtype="<f2").astype("<f4").tolist()


def _complex(data: bytes) -> list:
    return [{"re": re, "im": im} for re, im in np.frombuffer(data, dtype="<f4").reshape(-1, 2).tolist()]


def _unsigned(data: bytes) -> list:
    return [Decimal(x) for x in np.frombuffer(data, dtype="<u8").tolist()]


@lru_cache(maxsize=3)
def eight_bit_floats(exponent: int, mantissa: int) -> np.ndarray:
    """The 256 values of an 8-bit float: sign, exponent, mantissa.

    (5, 2) follows IEEE rules. (4, 3) has no infinities, and only all ones is not a number. (8, 0) has neither sign nor zero.
    """
    codes = np.arange(256)
    if exponent == 8:
        return np.where(codes == 255, np.nan, np.exp2(codes.astype(np.float64) - 127)).astype("<f4")
    bias = (1 << (exponent - 1)) - 1
    sign = np.where(codes & 128, -1.0, 1.0)
    e, m = (codes & 127) >> mantissa, codes & ((1 << mantissa) - 1)
    value = np.where(e == 0, m / (1 << mantissa) * 2.0 ** (1 - bias), (1 + m / (1 << mantissa)) * np.exp2((e - bias).astype(np.float64)))
    if exponent == 5:
        value = np.where(e == 31, np.where(m == 0, np.inf, np.nan), value)
    else:
        value = np.where((codes & 127) == 127, np.nan, value)
    return (sign * value).astype("<f4")


def _table(exponent: int, mantissa: int) -> Callable[[bytes], list]:
    return lambda data: eight_bit_floats(exponent, mantissa)[np.frombuffer(data, dtype=np.uint8)].tolist()


#: Names of element types in file headers, widths in bytes, and the Spark type that holds each exactly.
DTYPES = {
    x.name: x
    for x in (
        DType("F64", 8, "double", _plain("<f8")),
        DType("F32", 4, "float", _plain("<f4")),
        DType("F16", 2, "float", _half),
        DType("BF16", 2, "float", _bf16),
        DType("I64", 8, "bigint", _plain("<i8")),
        DType("I32", 4, "int", _plain("<i4")),
        DType("I16", 2, "smallint", _plain("<i2")),
        DType("I8", 1, "tinyint", _plain("<i1")),
        DType("U8", 1, "smallint", _plain("<u1")),
        DType("BOOL", 1, "boolean", lambda data: (np.frombuffer(data, dtype=np.uint8) != 0).tolist()),
        DType("C64", 8, "struct<re:float,im:float>", _complex),
        DType("U64", 8, "decimal(20,0)", _unsigned),
        DType("U32", 4, "bigint", _plain("<u4")),
        DType("U16", 2, "int", _plain("<u2")),
        DType("F8_E4M3", 1, "float", _table(4, 3)),
        DType("F8_E5M2", 1, "float", _table(5, 2)),
        DType("F8_E8M0", 1, "float", _table(8, 0)),
        DType("F4", 1, None, None),
    )
}
