"""The unsigned crc32 in DuckDB's SQL, for the queries whose contract draws by it."""

from __future__ import annotations

# One row with the table of the reflected polynomial, made bit by bit.
CRC_TABLE = """
crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc_table
)
"""


def crc32(text: str) -> str:
    """SQL for the crc32 of ``text`` (code points below U+0800) in UTF-8; ``crc`` must be joined in."""
    octets = (
        f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 "
        "THEN [unicode(ch)::BIGINT] ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END))"
    )
    return (
        f"xor(list_reduce({octets}, lambda c, o: "
        "xor(crc_table[(xor(c, o) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"
    )
