"""Safe parsing of feed strings and text clean-up, as plain column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: accepted spellings of feed numbers and dates ---------------------
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_PATTERN = r"^[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
DATE_PATTERN = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$"


def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters (Latin-1 to Extended-B) with the base letter each reduces to."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


ACCENTED, UNACCENTED = _accent_pairs()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: Column | str) -> Column:
    """Text -> double; anything that is not a number becomes null."""
    s = F.trim(col(c))
    return (
        F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
        .when(s.rlike(SPECIAL_PATTERN),
              F.when(F.lower(s).contains("nan"), F.lit(float("nan")))
              .when(s.startswith("-"), F.lit(float("-inf")))
              .otherwise(F.lit(float("inf"))))
    )


def to_int(c: Column | str) -> Column:
    """Text -> integer, cutting decimals; null when not finite or out of range."""
    return to_double(c).try_cast("int")


def to_date(c: Column | str) -> Column:
    """ISO date or timestamp text -> date; anything else, or an impossible day, becomes null."""
    day = F.regexp_extract(col(c), DATE_PATTERN, 1)
    return F.nullif(day, F.lit("")).try_cast("date")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*names: str) -> Column:
    """First of several alternative field names that is neither missing nor blank."""
    return F.coalesce(*[blank_to_null(n) for n in names])


def zero_to_null(c: Column | str) -> Column:
    """Blank, missing, unparsable and zero all become null."""
    return F.nullif(to_double(c), F.lit(0.0))


def place_key(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def clean_text(c: Column | str) -> Column:
    """Lower case, no accents, punctuation to blanks, single blanks."""
    plain = F.translate(F.lower(col(c)), ACCENTED, UNACCENTED)
    plain = F.regexp_replace(plain, r"\p{Mn}", "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def words(c: Column | str) -> Column:
    """Words of two or more letters of already cleaned text."""
    return F.filter(F.split(col(c), " "), lambda w: F.length(w) >= 2)


def text_grams(tokens: Column) -> Column:
    """One- and two-word terms of a word array, in text order."""
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)


def rounded(c: Column, digits: int | None) -> Column:
    """Display rounding; ``None`` keeps the full value."""
    return c if digits is None else F.round(c, digits)


def contains_ci(c: Column | str, text: str) -> Column:
    """Case-insensitive 'contains' (ILIKE with wildcards on both ends)."""
    return F.lower(col(c)).contains(text.lower())
