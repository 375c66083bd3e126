"""Parts of the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

#: Table of CRC-32 for each byte: eight shifts, each with the polynomial 0xEDB88320 where a bit falls out.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"


def CRC32(text: str) -> str:  # noqa: N802
    """Unsigned crc32 of an ASCII text such as a decimal number; null for null."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT))"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce({codes}, lambda c, b: xor(c // 256, ({_CRC_TABLE})[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) END"
