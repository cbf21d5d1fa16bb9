"""Free-form date text to timestamps, by shape.

Each shape is one regular expression that rewrites the text to ISO form, followed
by one ``try_cast``. Nothing throws per row, so a column of unparsable text costs
no more than a column of good dates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.text import strip

# Text that stands for "no date".
NO_DATE = ("", "N/A", "NA", "n/a", "null", "NULL", "-", "none", "None", "NaT", "nat")

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_WORD = (
    "((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))"
)
_TIME = r"(?:[T ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(?:Z)?)?$"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"

_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_MONTH_FIRST = r"^(0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])[-/.](\d{4})" + _TIME
_DAY_FIRST = r"^(0?[1-9]|[12]\d|3[01])[-/.](0?[1-9]|1[0-2])[-/.](\d{4})" + _TIME
_NAME_FIRST = "^" + _MONTH_WORD + r"\.? +" + _DAY + r",? +(\d{4})" + _TIME
_DAY_THEN_NAME = "^" + _DAY + "[ -]+" + _MONTH_WORD + r"\.?,?[ -]+(\d{4})" + _TIME

# Strftime directives and the matching Java date-format letters.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
    "%j": "DDD",
}


def java_format(fmt: str) -> str:
    """strftime pattern to a Java date pattern; literal letters are quoted."""
    out, i = [], 0
    while i < len(fmt):
        pair = fmt[i : i + 2]
        if pair in STRFTIME:
            out.append(STRFTIME[pair])
            i += 2
        elif pair == "%%":
            out.append("%")
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported date directive {pair!r} in {fmt!r}")
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i])
            i += 1
    return "".join(out)


def _month_number(word: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(word.substr(1, 3)))
    return F.floor((at + 2) / 3).cast("string")


def to_iso(c: Column) -> Column:
    """Date text rewritten as ``y-m-d[ time]``; NULL if it has no known shape.

    ``a/b/yyyy`` is month-first; day-first only where the first number cannot be a month.
    """
    s = strip(c)
    named = F.concat_ws(
        " ",
        F.concat_ws("-", F.regexp_extract(s, _NAME_FIRST, 3), _month_number(F.regexp_extract(s, _NAME_FIRST, 1)),
                    F.regexp_extract(s, _NAME_FIRST, 2)),
        F.regexp_extract(s, _NAME_FIRST, 4),
    )
    day_named = F.concat_ws(
        " ",
        F.concat_ws("-", F.regexp_extract(s, _DAY_THEN_NAME, 3), _month_number(F.regexp_extract(s, _DAY_THEN_NAME, 2)),
                    F.regexp_extract(s, _DAY_THEN_NAME, 1)),
        F.regexp_extract(s, _DAY_THEN_NAME, 4),
    )
    return (
        F.when(s.rlike(_YEAR_FIRST), F.regexp_replace(s, _YEAR_FIRST, "$1-$2-$3 $4"))
        .when(s.rlike(_MONTH_FIRST), F.regexp_replace(s, _MONTH_FIRST, "$3-$1-$2 $4"))
        .when(s.rlike(_DAY_FIRST), F.regexp_replace(s, _DAY_FIRST, "$3-$2-$1 $4"))
        .when(s.rlike(_NAME_FIRST), named)
        .when(s.rlike(_DAY_THEN_NAME), day_named)
        .when(s.rlike(_COMPACT), F.regexp_replace(s, _COMPACT, "$1-$2-$3"))
    )


def parse_timestamp(c: Column) -> Column:
    """Date text to a timestamp without time zone; unparsable text becomes NULL."""
    return F.btrim(to_iso(c)).try_cast("timestamp_ntz")


def is_date_shaped(c: Column) -> Column:
    """True where the text is a complete date; bare numbers are not dates."""
    # every shape has a separator and a year, most text has not
    likely = c.rlike(r"\d{4}") & c.rlike(r"[-/. ]")
    return F.coalesce(F.when(likely, parse_timestamp(c).isNotNull()), F.lit(False))


def reformat_date(c: Column, target_format: str = "%Y-%m-%d") -> Column:
    return F.date_format(parse_timestamp(c), java_format(target_format))
