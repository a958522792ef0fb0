"""Hash profiles as column expressions.

``md5``: slices of one md5 digest of the key, or one digest for each row of a matrix; any SQL engine gives the same
numbers. ``xxhash64``: Spark's built-in hash, without any text of digits. All slices stay below 2^52, so they are positive and
exact as doubles. Keys are hashed by their canonical text; null keys are filtered before any sketch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = ("md5", "xxhash64")
#: Rows that one digest serves: five hex digits for the column and one for the sign each.
FAST_ROWS = 5


def canonical(key: Column) -> Column:
    return key.cast("string")


def hex_slice(digest: Column, start: int | Column, length: int) -> Column:
    """The number that ``length`` hex digits from ``start`` (1-based) spell."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.conv(F.substring(digest, start, F.lit(length)), 16, 10).cast("long")


def digest(key: Column, profile: str = "md5", salt: str = "") -> Column:
    """What the fast path slices: 32 hex digits."""
    text = F.concat(F.lit(salt), canonical(key)) if salt else canonical(key)
    if profile == "md5":
        return F.md5(text)
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(text, F.lit(1))), 16, "0")))


def halves(digest: Column) -> tuple[Column, Column]:
    """A digest's 32 hex digits as two numbers of 64 bits, signed; one conversion each."""
    number = lambda start: F.conv(F.substring(digest, start, 16), 16, -10).cast("long")
    return number(1), number(17)


def key_halves(key: Column, profile: str = "md5", salt: str = "") -> tuple[Column, Column]:
    """``halves`` of a key's digest; xxhash64 gets there without any text of digits."""
    if profile == "md5":
        return halves(digest(key, profile, salt))
    text = F.concat(F.lit(salt), canonical(key)) if salt else canonical(key)
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def words(a: Column, b: Column) -> Column:
    """The first 30 hex digits as three numbers of 12, the last with zeros behind: what cells are cut from."""
    middle = F.shiftleft(a.bitwiseAND(F.lit(0xFFFF)), 32).bitwiseOR(F.shiftrightunsigned(b, 32))
    return F.array(F.shiftrightunsigned(a, 16), middle, F.shiftleft(F.shiftrightunsigned(b, 8).bitwiseAND(F.lit(0xFFFFFF)), 24))


def key_words(key: Column, profile: str = "md5", salt: str = "") -> Column:
    return words(*key_halves(key, profile, salt))


def piece(h: Column, row: Column) -> Column:
    """24 bits of the words for each of five rows."""
    word = F.get(h, (row / 2).cast("int"))
    return F.when(row % 2 == 0, F.shiftright(word, 24)).otherwise(word.bitwiseAND(F.lit(0xFFFFFF)))


def fast_col(h: Column, row: Column, cols: int | Column) -> Column:
    """Column of a matrix row by bits of the one digest, given as words."""
    return F.shiftright(piece(h, row), 4) % cols


def fast_sign(h: Column, row: Column) -> Column:
    return F.when(piece(h, row) % 2 == 1, 1).otherwise(-1).cast("long")


def row_digest(key: Column, row: Column, profile: str = "md5", salt: str = "") -> Column:
    """The regular path: a digest for each row."""
    return digest(F.concat(row.cast("string"), F.lit(":"), canonical(key)), profile, salt)


def regular_col(h: Column, cols: int | Column) -> Column:
    return hex_slice(h, 1, 8) % cols


def regular_sign(h: Column) -> Column:
    return F.when(hex_slice(h, 9, 1) % 2 == 1, 1).otherwise(-1).cast("long")
