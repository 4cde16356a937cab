"""Chunk ids and the sampling predicates over them.

Ids are 48-bit numbers in hex, colon-separated by byte; plain hex is accepted where only the number counts. Bit
predicates read the whole 48-bit number. A null id gives null numbers, and no predicate holds for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 48


def _by_bytes(digits: Column) -> Column:
    return F.regexp_replace(digits, "(..)(..)(..)(..)(..)(..)", "$1:$2:$3:$4:$5:$6")


def content_id(content: Column) -> Column:
    """Colon-separated id from the first 48 bits of the content's MD5."""
    return _by_bytes(F.substring(F.md5(content.cast("string")), 1, 12))


def content_number(content: Column) -> Column:
    """The number of ``content_id``; one stands for the other, and numbers cost less to shuffle and compare."""
    return F.conv(F.substring(F.md5(content.cast("string")), 1, 12), 16, 10).cast("bigint")


def number_id(number: Column) -> Column:
    """The id whose number this is."""
    return _by_bytes(F.lpad(F.lower(F.hex(number)), BITS // 4, "0"))


def fingerprint_number(chunk_id: Column) -> Column:
    return F.conv(F.regexp_replace(chunk_id, ":", ""), 16, 10).cast("bigint")


def _low(chunk_id: Column, n: int) -> Column:
    return fingerprint_number(chunk_id).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def sample_position(ordinal: Column, ratio: int) -> Column:
    """Every ``ratio + 1``-th row of a global 0-based ordinal."""
    return F.coalesce((ordinal + 1) % (ratio + 1) == 0, F.lit(False))


def sample_chunk_id(chunk_id: Column, ratio: int) -> Column:
    """By the last byte of the id."""
    return F.coalesce((F.conv(F.right(chunk_id, F.lit(2)), 16, 10).cast("int") + 1) % ratio == 0, F.lit(False))


def sample_low_ones(chunk_id: Column, n: int) -> Column:
    return F.coalesce(_low(chunk_id, n) == (1 << n) - 1, F.lit(False)) if n > 0 else F.lit(False)


def sample_low_zeros(chunk_id: Column, n: int) -> Column:
    return F.coalesce(_low(chunk_id, n) == 0, F.lit(False)) if n > 0 else F.lit(False)


def _high(chunk_id: Column, n: int) -> Column:
    return F.shiftrightunsigned(fingerprint_number(chunk_id), BITS - n)


def sample_high_ones(chunk_id: Column, n: int) -> Column:
    return F.coalesce(_high(chunk_id, n) == (1 << n) - 1, F.lit(False)) if n > 0 else F.lit(False)


def sample_high_zeros(chunk_id: Column, n: int) -> Column:
    return F.coalesce(_high(chunk_id, n) == 0, F.lit(False)) if n > 0 else F.lit(False)


def is_hook(chunk_id: Column, ones: int = 7, zeros: int = 7) -> Column:
    """Uniform hooks of hybrid indexes."""
    return sample_low_ones(chunk_id, ones) | sample_low_zeros(chunk_id, zeros)


def is_hook_number(number: Column, ones: int = 7, zeros: int = 7) -> Column:
    """``is_hook`` of ids that are given as numbers."""
    low = lambda n, bits: F.coalesce(number.bitwiseAND(F.lit((1 << n) - 1).cast("bigint")) == bits, F.lit(False)) if n > 0 else F.lit(False)
    return low(ones, (1 << ones) - 1) | low(zeros, 0)


def is_feature(chunk_id: Column, ordinal: Column, uniform: bool = False, ones: int = 7, zeros: int = 0, ratio: int = 8, number: bool = False) -> Column:
    """Container features of hybrid indexes: by id bits, or by the ordinal among stored chunks. ``number``: ids are given as numbers."""
    return (is_hook_number if number else is_hook)(chunk_id, ones, zeros) if uniform else sample_position(ordinal, ratio)


def sampler(method: str, chunk_id: Column, ordinal: Column, ratio: int, number: bool = False) -> Column:
    if method == "position":
        return sample_position(ordinal, ratio)
    if method == "chunkID":
        return F.coalesce((chunk_id.bitwiseAND(F.lit(255).cast("bigint")) + 1) % ratio == 0, F.lit(False)) if number else sample_chunk_id(chunk_id, ratio)
    raise ValueError(f"unknown sampling method: {method}")


def content_boundary(chunk_id: Column, n: int) -> Column:
    return sample_low_ones(chunk_id, n)


def pattern_boundary(chunk_id: Column, n: int) -> Column:
    """The low ``n`` bits are ones and the next ``n`` zeros."""
    return F.coalesce(_low(chunk_id, 2 * n) == (1 << n) - 1, F.lit(False)) if n > 0 else F.lit(False)
