"""Scalar columns. Bad input gives NULL, whether or not the session is in ANSI mode."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of the short keys, in order (10 + 26 + 26 + 28 = 90).
DIGITS = (
    string.digits + string.ascii_uppercase + string.ascii_lowercase
    + "!#$%&()*+,-./:;<=>?@[]^_{|}~"
)
MAX_LONG = 2**63 - 1


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_double(value: Column | str) -> Column:
    return as_column(value).try_cast("double")


def to_whole(value: Column | str, kind: str = "bigint") -> Column:
    """Text to a whole number; a fraction is cut off (``12.7`` gives 12), junk gives NULL."""
    whole_part = F.regexp_replace(as_column(value), r"^(\s*[+-]?\d+)\.\d*(\s*)$", "$1")
    return whole_part.try_cast(kind)


def to_money(value: Column | str) -> Column:
    """Two decimals, half up; NULL beyond ten digits."""
    return as_column(value).try_cast("decimal(10,2)")


def split_ratio(split_from: Column | str, split_to: Column | str) -> Column:
    """New shares per old share: 2.0 for a 2-for-1 split."""
    return F.try_divide(to_double(split_to), to_double(split_from))


def return_pct(open_: Column | str, close: Column | str) -> Column:
    """Gain from open to close as a fraction of the open (0.05 is five per cent)."""
    open_, close = as_column(open_), as_column(close)
    return F.try_divide(close - open_, open_)


def short_key(number: Column | str, base: int) -> Column:
    """Text form of a non-negative whole number in the given base; NULL for negatives.

    One term per digit position, in exact long arithmetic, so it stays inside generated code.
    """
    if not 2 <= base <= len(DIGITS):
        raise ValueError(f"base must lie between 2 and {len(DIGITS)}, got {base}")
    number = as_column(number).cast("bigint")

    places = [1]
    while places[-1] * base <= MAX_LONG:
        places.append(places[-1] * base)

    def digit(place: int) -> Column:
        quotient = F.call_function("div", number, F.lit(place).cast("bigint"))
        return F.substring(F.lit(DIGITS), (quotient % base + 1).cast("int"), F.lit(1))

    text = F.concat(*[digit(place) for place in reversed(places)])
    significant = F.ltrim(text, F.lit(DIGITS[0]))
    return F.when(number == 0, DIGITS[0]).when(number > 0, significant)
