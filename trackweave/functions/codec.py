"""Packed pairs and variable-length integers."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.tilemath import long, shift_left, shift_right

MASK32 = 0xFFFFFFFF


def packed(users: Column, trips: Column) -> Column:
    """users in the upper, trips in the lower 32 bits of one long."""
    return shift_left(users, 32).bitwiseOR(long(trips).bitwiseAND(F.lit(MASK32)))


def unpacked(value: Column) -> Column:
    """Struct {users, trips} of a packed value."""
    return F.struct(
        F.call_function("shiftrightunsigned", long(value), F.lit(32)).alias("users"), long(value).bitwiseAND(F.lit(MASK32)).alias("trips")
    )


def sign_magnitude(v: Column) -> Column:
    """Twice the magnitude, plus one below zero; null stays null."""
    return shift_left(F.abs(long(v)), 1) + F.when(v < 0, 1).otherwise(0)


def from_sign_magnitude(u: Column) -> Column:
    half = shift_right(u, 1)
    return F.when(long(u).bitwiseAND(F.lit(1)) == 1, -half).otherwise(half)


def wrapped32(v: Column) -> Column:
    """v as an unsigned 32-bit integer that has overflowed."""
    return long(v).bitwiseAND(F.lit(MASK32))


def saturated32(v: Column) -> Column:
    return F.least(long(v), F.lit(MASK32))


def varint(v: Column, bits: int = 64) -> Column:
    """Binary of an unsigned integer in groups of seven bits, lowest first, all but the last with the high bit set. Null stays null."""
    most = -(-bits // 7)
    unsigned = lambda n: F.call_function("shiftrightunsigned", long(v), F.lit(n))
    groups = F.array(*[unsigned(7 * i).bitwiseAND(F.lit(127)) for i in range(most)])
    size = F.lit(1)
    for i in range(1, most):
        size = F.when(unsigned(7 * i) != 0, F.lit(i + 1)).otherwise(size)
    byte = lambda x, i: F.lpad(F.hex(x.bitwiseOR(F.when(i + 1 < size, 128).otherwise(0).cast("long"))), 2, "0")
    return F.when(v.isNotNull(), F.unhex(F.array_join(F.transform(F.slice(groups, 1, size), byte), "")))


def varint_nullable(v: Column, bits: int = 64) -> Column:
    """varint of v + 1, of 0 for null."""
    return varint(F.coalesce(long(v) + 1, F.lit(0).cast("long")), bits)


def signed_varint(v: Column, bits: int = 64) -> Column:
    return varint(sign_magnitude(v), bits)


def signed_varint_nullable(v: Column, bits: int = 64) -> Column:
    return varint_nullable(sign_magnitude(v), bits)


def unvarint(data: Column) -> Column:
    """The integer of a varint's bytes."""
    text = F.hex(data)
    n = F.octet_length(data)
    part = lambda i: shift_left(
        F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)), i.cast("int") * 7
    )
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(part(i))))


def unvarint_nullable(data: Column) -> Column:
    v = unvarint(data)
    return F.when(v != 0, v - 1)


# Plain Python for bytes at the edges: files and tiles.


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value and the offset behind it."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise EOFError("the data ends within a varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fixed(value: int, kind: str) -> bytes:
    """Little-endian bytes; kind: i4, u4, i8 or u8."""
    return struct.pack({"i4": "<i", "u4": "<I", "i8": "<q", "u8": "<Q"}[kind], value)


def unfixed(data: bytes, kind: str, at: int = 0) -> int:
    return struct.unpack_from({"i4": "<i", "u4": "<I", "i8": "<q", "u8": "<Q"}[kind], data, at)[0]
