"""CRC-32 in DuckDB SQL, for checks of operators whose rules use it."""

# The table of the public polynomial, one entry per byte value, as the first CTE of a query.
CRC_MACROS = """crc_table AS (
    SELECT list(c ORDER BY byte) AS crcs
    FROM (
        SELECT byte, list_reduce(list_prepend(byte, range(8)),
                                 lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS byte)
    )
)"""


def crc32_of(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a SQL string expression, in a query that also reads ``crc_table``."""
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(({text})), 2 * i + 1, 2))::BIGINT)"
    step = "xor(c >> 8, crcs[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}))"
