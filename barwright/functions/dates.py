"""Calendar columns that give the same answer under any session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barwright.functions.columns import as_column

# The two market zones and the symbol suffixes traded in the first.
INDIA, US = "Asia/Kolkata", "US/Eastern"
INDIA_SUFFIXES = (".NS", ".BO")

MS_PER_DAY = 86_400_000
#: Epoch milliseconds of the years 1 to 9999; beyond them there is no date, whatever the zone.
FIRST_MS, LAST_MS = -719_161 * MS_PER_DAY, 2_932_895 * MS_PER_DAY


def _utc_datetime(epoch_ms: Column) -> Column:
    """Zone-less UTC date and time of an epoch-millisecond column, NULL out of range."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", _in_range(epoch_ms).try_cast("bigint"), epoch)


def _in_range(epoch_ms: Column) -> Column:
    # NaN is above all numbers
    return F.when(epoch_ms.between(FIRST_MS, LAST_MS), epoch_ms)


def market_date(epoch_ms: Column | str, zone: Column | str) -> Column:
    """Trading date in the bar's market: India for its zone name, the US for any other or none."""
    utc, zone = _utc_datetime(as_column(epoch_ms)), as_column(zone)

    def local(name: str) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(name), utc).cast("date")

    return F.when(zone == INDIA, local(INDIA)).otherwise(local(US))


def utc_date(epoch_ms: Column | str) -> Column:
    """UTC date, rounding towards the past also before 1970."""
    days = F.floor(_in_range(as_column(epoch_ms)) / MS_PER_DAY)
    return F.date_from_unix_date(days.try_cast("int"))


def parse_date(text: Column | str, fmt: str | None = None) -> Column:
    """Date from text, NULL when it does not parse."""
    text = as_column(text)
    return text.try_cast("date") if fmt is None else F.try_to_date(text, fmt)


def market_zone(symbol: Column | str) -> Column:
    """Market time zone from the exchange suffix of a symbol."""
    symbol = as_column(symbol)
    indian = F.lit(False)
    for suffix in INDIA_SUFFIXES:
        indian = indian | symbol.endswith(suffix)
    return F.when(indian, INDIA).otherwise(US)
