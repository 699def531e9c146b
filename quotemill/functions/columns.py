"""Column functions: guarded arithmetic, lenient accessors, validity predicates, symbols and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The price range that counts as plausible, and the clock tolerance in ms.
MIN_PRICE, MAX_PRICE, TOLERANCE_MS = 1e-8, 1e7, 3_600_000
#: Fixed value: a 13-digit epoch after a `timestamp` or `ts` key, and no 14th digit.
EPOCH_PATTERN = r"(?:timestamp|ts)[\"']?\s*[:=]\s*[\"']?(\d{13})(?!\d)"


def ratio(top: Column, bottom: Column, scale: int = 6, percent: bool = False) -> Column:
    """top / bottom rounded half up, 0 where the divisor isn't positive."""
    value = top.cast("double") / bottom.cast("double")
    return F.when(bottom > 0, F.round(value * 100 if percent else value, scale)).otherwise(F.lit(0.0))


def float_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as floating-point numbers: by 0 it is infinite, 0 by 0 isn't a number (which compares as greater than all).

    -0.0 turns the sign, as any negative divisor does.
    """
    top, bottom = top.cast("double"), bottom.cast("double")
    endless = F.when(bottom.cast("string").startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(bottom == 0, top * endless).otherwise(top / bottom)


def decimal_divide(top: Column, bottom: Column, scale: int) -> Column:
    """Decimal division at a fixed scale, half up; null where the divisor is 0 or null."""
    return F.round(F.try_divide(top.cast("decimal(38,12)"), bottom.cast("decimal(38,12)")), scale)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def safe_decimal(text: Column, kind: str = "decimal(20,8)") -> Column:
    """A number from text; null if it isn't one."""
    return F.trim(text.cast("string")).try_cast(kind)


def safe_millis(text: Column, otherwise: Column | None = None) -> Column:
    """Epoch milliseconds from text; the other value (now, if none is given) where it isn't one."""
    now = F.unix_millis(F.current_timestamp()) if otherwise is None else otherwise
    return F.coalesce(F.trim(text.cast("string")).try_cast("bigint"), now)


def event_time(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def minute_start(millis: Column, minutes: int = 1) -> Column:
    """Epoch milliseconds of the start of the bar that holds the time."""
    step = minutes * 60_000
    return millis - F.pmod(millis, F.lit(step))


def epoch_in_text(text: Column) -> Column:
    """The event time that a raw message names, in ms; null if there is none."""
    return F.regexp_extract(text, EPOCH_PATTERN, 1).try_cast("bigint")


def valid_price(price: Column) -> Column:
    value = price.try_cast("double")
    return F.coalesce((value > 0) & value.between(MIN_PRICE, MAX_PRICE), F.lit(False))


def valid_time(millis: Column, as_of: Column, tolerance_ms: int = TOLERANCE_MS) -> Column:
    return F.coalesce((millis > 0) & (F.abs(as_of - millis) < tolerance_ms), F.lit(False))


def not_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def length_between(text: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(text).between(low, high), F.lit(False))


def positive(number: Column) -> Column:
    return F.coalesce(number > 0, F.lit(False))


def in_range(number: Column, low: float, high: float) -> Column:
    return F.coalesce(number.between(low, high), F.lit(False))


def valid_instrument(inst_id: Column) -> Column:
    """Two non-empty parts around one dash."""
    return F.coalesce(inst_id.rlike(r"^[^-]+-[^-]+$"), F.lit(False))


def base_symbol(inst_id: Column, quote: str = "USDT") -> Column:
    """The instrument without its quote currency and swap suffix."""
    return F.regexp_replace(F.regexp_replace(inst_id, f"-{quote}", ""), "-SWAP$", "")


def spot_symbol(inst_id: Column) -> Column:
    """BASE-QUOTE: the instrument without its swap suffix."""
    return F.regexp_replace(inst_id, "-SWAP$", "")


def market_of(inst_id: Column) -> Column:
    return F.when(inst_id.endswith("-SWAP"), F.lit("swap")).otherwise(F.lit("spot"))


def param(params: Column, name: str, default: str) -> Column:
    """A value of a string map, or its default."""
    return F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(default))


def json_number(text: Column, path: str) -> Column:
    """A number inside a JSON text; null if it isn't there or isn't one."""
    return F.get_json_object(text, path).try_cast("double")


def signal_id(symbol: Column, at: Column) -> Column:
    """The same id for the same signal however often it is computed."""
    return F.sha2(F.concat_ws("|", symbol, at.cast("string")), 256)
