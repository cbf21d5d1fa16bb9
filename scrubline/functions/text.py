"""String column expressions. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The 27 printable Windows-1252 characters and the bytes they stand for.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(chr(c.encode("cp1252")[0]) for c in CP1252_CHARS)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(WHITESPACE))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    words = F.split(c, r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(words, _capitalise), "")


def _capitalise(w: Column) -> Column:
    return F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))


def change_case(c: Column, case: str) -> Column:
    if case == "lower":
        return F.lower(c)
    if case == "upper":
        return F.upper(c)
    if case == "title":
        return title_case(c)
    return c


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was decoded as Windows-1252 / Latin-1.

    Text is rewritten only if every character fits one byte, at least one is
    non-ASCII, and those bytes form valid UTF-8.
    """
    as_bytes = F.translate(c, CP1252_CHARS, CP1252_BYTES)
    candidate = as_bytes.rlike(r"^[\x00-\xff]*$") & as_bytes.rlike(r"[\x80-\xff]")
    # encode() raises on characters outside ISO-8859-1, so only candidates reach it
    raw = F.encode(F.when(candidate, as_bytes), "ISO-8859-1")
    decoded = raw.cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(decoded), decoded), c)


def remove_characters(c: Column, characters: list[str] | None) -> Column:
    """Drop every character that occurs in any string of ``characters``."""
    unwanted = "".join(characters or [])
    return F.translate(c, unwanted, "") if unwanted else c
