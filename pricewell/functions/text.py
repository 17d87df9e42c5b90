"""Identifiers, addresses, lists and case-insensitive prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATION_ID = "^[0-9a-fA-F]{64}$"

# Latin-1 letters with a mark, and the plain letter each compares equal to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def bytes_to_hex(c: Column) -> Column:
    return F.hex(c)


def hex_to_bytes(c: Column) -> Column:
    """NULL on malformed text; guard with :func:`is_station_id` to tell the cases apart."""
    return F.unhex(c)


def normalise_id(c: Column) -> Column:
    return F.upper(c)


def is_station_id(c: Column) -> Column:
    # a plain length test spares most malformed values the regex
    return (F.length(c) == 64) & c.rlike(STATION_ID)


def full_address(line_1: Column, line_2: Column, city: Column, postcode: Column) -> Column:
    """Parts joined with ", "; NULL parts are left out, empty ones stay."""
    return F.concat_ws(", ", line_1, line_2, city, postcode)


def list_to_csv(c: Column) -> Column:
    return F.array_join(c, ",")


def csv_to_list(c: Column) -> Column:
    return F.filter(F.split(c, ","), lambda item: item != "")


def price_text(c: Column) -> Column:
    return c.cast("string")


def fold(c: Column) -> Column:
    """Key under which text compares equal regardless of case and Latin-1 marks."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(MARKED, PLAIN))


def like_pattern(prefix: str) -> str:
    """LIKE pattern for "starts with `prefix`", wildcards in `prefix` left alive.

    A backslash before anything but ``%``, ``_`` or itself is dropped, because Spark
    rejects such escapes where the stored-table dialect reads the bare character. A
    trailing backslash escapes the appended ``%``, as plain concatenation would.
    """
    pattern, out, i = prefix + "%", [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append(ch + nxt if nxt in "%_\\" else nxt)
            i += 2
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def starts_with(c: Column, prefix: str) -> Column:
    return fold(c).like(fold_text(like_pattern(prefix)))


def literal_head(pattern: str) -> str:
    """What every text that a LIKE pattern fits begins with: the pattern up to its first live wildcard."""
    head, i = [], 0
    while i < len(pattern) and pattern[i] not in "%_":
        if pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
        head.append(pattern[i])
        i += 1
    return "".join(head)


def after_all(head: str) -> str | None:
    """The least text greater than all that begin with `head`, by code points; None if there is none."""
    while head and ord(head[-1]) == 0x10FFFF:
        head = head[:-1]
    if not head:
        return None
    following = ord(head[-1]) + 1
    return head[:-1] + chr(0xE000 if 0xD800 <= following < 0xE000 else following)


def key_starts_with(key: Column, prefix: str) -> Column:
    """`starts_with` for a stored, folded column: a range of the bare column, which reaches the scan, then the pattern.

    Texts compare by their UTF-8 bytes, in the order of code points. A pattern that begins with a wildcard has no range.
    """
    pattern = fold_text(like_pattern(prefix))
    head = literal_head(pattern)
    fits, end = key.like(pattern), after_all(head)
    if head:
        fits = (key >= head) & fits
    return (key < end) & fits if end else fits
