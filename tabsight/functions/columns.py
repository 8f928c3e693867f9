"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: A decimal number as text. Spark's own cast also takes '1d' and '1.5f', which must not count.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

#: A date has a separator; bare digits never count as one.
DATE_SEPARATOR = r"[-/:\s.]"

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
#: Time of day with minutes or seconds and a zone, as two groups.
_TIME = r"(?:(?:\s+|,\s*|T)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?"
#: A first number up to twelve is the month, a larger one the day.
_MONTH_NUMBER, _DAY_OVER_12 = r"(0?[1-9]|1[0-2])", r"(1[3-9]|[23]\d)"
_FIRST_LETTERS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Years of two digits are 1969 to 2068.
_YEARS = ((r"(\d{4})", ""), (r"(69|[7-9]\d)", "19"), (r"(\d{2})", "20"))


def _shapes(day_first: bool = False) -> tuple[tuple[str, str], ...]:
    """Shapes of a date, each with its text for the parser; a month's name stands before a bar."""
    out = [(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", "$1-$3-$4 $5$6")]
    for year, century in _YEARS:
        if day_first:
            out.append((rf"(\d{{1,2}})([-/.]){_MONTH_NUMBER}\2{year}", f"{century}$4-$3-$1 $5$6"))
            out.append((rf"{_MONTH_NUMBER}([-/.]){_DAY_OVER_12}\2{year}", f"{century}$4-$1-$3 $5$6"))
        else:
            out.append((rf"{_MONTH_NUMBER}([-/.])(\d{{1,2}})\2{year}", f"{century}$4-$1-$3 $5$6"))
            out.append((rf"{_DAY_OVER_12}([-/.])(\d{{1,2}})\2{year}", f"{century}$4-$3-$1 $5$6"))
        out.append((rf"{_DAY}[-\s]+(?:of\s+)?{_MONTH},?[-\s]+{year}", f"$2|{century}$3-#-$1 $4$5"))
    out.append((rf"{_MONTH}\s+{_DAY},?\s+(\d{{4}})", "$1|$3-#-$2 $4$5"))
    out.append((rf"{_MONTH}\s+(\d{{4}})", "$1|$2-#-1 $3$4"))
    return tuple((rf"(?i)^{_WEEKDAY}{shape}{_TIME}$", text) for shape, text in out)


DATE_SHAPES = _shapes()
DAY_FIRST_SHAPES = _shapes(day_first=True)
#: Numeric dates that can only be day first, and only month first.
DAY_LEADS = rf"(?i)^{_WEEKDAY}{_DAY_OVER_12}([-/.])(0?[1-9]|1[0-2])\2(\d{{4}}|\d{{2}}){_TIME}$"
MONTH_LEADS = rf"(?i)^{_WEEKDAY}(0?[1-9]|1[0-2])([-/.]){_DAY_OVER_12}\2(\d{{4}}|\d{{2}}){_TIME}$"
#: How every shape begins, and the longest text looked at: one match rules most text out before any shape is tried.
DATE_START = r"(?i)^(?:[a-z]{3,9}\.?,?\s+){0,2}\d{1,4}(?:[-/.]\d|[-/.\s]*(?:st|nd|rd|th|of|[a-z]{3}|,)|\s+\d|$)"
DATE_LENGTH = 60


def named(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, NUMERIC_TYPES)


def numeric_columns(df, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in exclude]


def text_columns(df, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def nan_to_null(df, columns: Sequence[str] | None = None):
    """Unify NaN and null on floating columns: afterwards NaN never occurs."""
    chosen = set(columns if columns is not None else df.columns)
    projected = [
        F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
        if f.name in chosen and isinstance(f.dataType, (T.FloatType, T.DoubleType))
        else F.col(f.name)
        for f in df.schema
    ]
    return df.select(*projected)


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def parse_datetime(text: Column, day_first: bool = False) -> Column:
    """Mixed-format date parsing: the first shape that a value has sorts its parts, then one cast reads them; else null.

    Of two numbers the month comes first, the day only if the first is over twelve; with ``day_first`` the other way round.
    Times are optional, with minutes or seconds, a fraction, am or pm, and a zone, which is taken off (the session runs in UTC).
    """
    shapes = DAY_FIRST_SHAPES if day_first else DATE_SHAPES
    begun = (F.length(F.trim(text)) <= DATE_LENGTH) & F.trim(text).rlike(DATE_START)
    return F.when(begun, _bound(F.trim(text), lambda trimmed: _read_date(trimmed, shapes)))


def leading_number(text: Column) -> tuple[Column, Column]:
    """Whether a date's two numbers can only be day and month, and only month and day. A time may end in am or pm."""
    begun = F.length(F.trim(text)) <= DATE_LENGTH
    plain = F.regexp_replace(F.trim(text), r"(?i)\s*[ap]\.?m\.?$", "")
    return begun & plain.rlike(DAY_LEADS), begun & plain.rlike(MONTH_LEADS)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, so that nested uses don't multiply the generated code."""
    return F.transform(F.array(value), then)[0]


def _read_date(trimmed: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    halved = trimmed.rlike(r"(?i)\d\s*[ap]\.?m\.?$")
    after_noon = trimmed.rlike(r"(?i)p\.?m\.?$")
    half_day = F.expr("INTERVAL 12 HOURS")

    def turned(moment: Column) -> Column:
        moved = F.when(after_noon & (F.hour(moment) < 12), moment + half_day).when(~after_noon & (F.hour(moment) == 12), moment - half_day)
        return F.when(halved, F.coalesce(moved, moment)).otherwise(moment)

    whole = F.when(halved, F.regexp_replace(trimmed, r"(?i)\s*[ap]\.?m\.?$", "")).otherwise(trimmed)
    sort = lambda plain: _sorted_parts(plain, shapes)
    return _bound(_bound(_bound(whole, _with_zone), sort).try_cast("timestamp").cast("timestamp_ntz"), turned)


def _with_zone(plain: Column) -> Column:
    """A zone as the cast reads it: after seconds, with a colon, UTC as Z."""
    zoned = plain.rlike(r"(?i):\d{2}(\.\d+)?\s*(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$")
    whole = F.regexp_replace(plain, r"(?i)([T\s]\d{1,2}:\d{2})\s*(Z|UTC|GMT|[+-][\d:]+)$", "$1:00$2")
    whole = F.regexp_replace(F.regexp_replace(whole, r"([+-]\d{2})$", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(zoned, F.regexp_replace(whole, r"(?i)\s*(UTC|GMT)$", "Z")).otherwise(plain)


def _sorted_parts(plain: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    """The parts as year-month-day and time by the first shape that fits; null if none does."""
    said = F.lit(None).cast("string")
    for shape, parts in reversed(shapes):
        sorted_ = F.regexp_replace(plain, shape, parts)
        if "|" in parts:
            first = F.lower(F.substring(F.substring_index(sorted_, "|", 1), 1, 3))
            number = F.floor((F.instr(F.lit(_FIRST_LETTERS), first) + 2) / 3).cast("string")
            sorted_ = F.replace(F.substring_index(sorted_, "|", -1), F.lit("#"), number)
        said = F.when(plain.rlike(shape), sorted_).otherwise(said)
    return said


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for reporting; adding zero turns -0.0 into 0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def variance(x: Column) -> Column:
    """Population variance; 0 where all values are equal, which merged partial results only give up to rounding."""
    return F.when(F.min(x) == F.max(x), F.abs(F.max(x).cast("double")) * 0.0).otherwise(F.var_pop(x))


def deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def skew_corrected(x: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 spread gives null."""
    n = F.count(x).cast("double")
    factor = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    return F.when(F.min(x) < F.max(x), F.skewness(x) * factor)


def kurtosis_corrected(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(x).cast("double")
    denominator = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    value = (n - 1) / denominator * ((n + 1) * F.kurtosis(x) + 6)
    return F.when((n > 3) & (F.min(x) < F.max(x)), value)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; null when either side has no spread."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = deviation(F.when(both, x)), deviation(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(sx * sy, F.lit(0.0)))


def md5_order(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """A reproducible random order: the md5 of the key text and the seed."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat(F.concat_ws("|", *[p.cast("string") for p in parts]), F.lit(f":{seed}")).cast("binary"))


def word_count(text: Column) -> Column:
    """Whitespace-separated words; an empty or blank value has none."""
    cleaned = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, r"\s+")))
