"""Text forms of labels, categories, numbers and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EOS = "EOS"


def strip_by_suffix(label: Column) -> Column:
    """Drop `` by <role>``, first inside brackets, then up to the end."""
    inside = F.regexp_replace(label, r"\s+by\s+[^\]]+(?=\])", "")
    return F.when(label == EOS, label).otherwise(F.regexp_replace(inside, r"\s+by\s+.*$", ""))


def double_text(value: Column) -> Column:
    """Shortest text that reads back as the same double; scientific from 1e16 and below 1e-4."""
    text = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when((size >= 1e16) | ((size < 1e-4) & (size > 0)), scientific)
        .when((size >= 1e7) | ((size < 1e-3) & (size > 0)), plain)
        .otherwise(text)
    )


def category_token(value: Column, kind: T.DataType) -> Column:
    """One text per category, however it is coded: 1, 1.0 and '1' agree."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit("True")).when(~value, F.lit("False"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = value == F.floor(value)
        text = F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(double_text(value))
        return F.when(~F.isnan(value), text)
    return value.cast("string")


def duration_text(seconds: Column) -> Column:
    """Seconds as days, hours, minutes or seconds; (-1, 0) counts as 0."""
    s = F.when((seconds > -1) & (seconds < 0), F.lit(0.0)).otherwise(seconds)
    sign = F.when(s < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(s)
    return (
        F.when(a >= 86400, F.format_string("%s%.2f days", sign, two_places(a / 86400)))
        .when(a >= 3600, F.format_string("%s%.2f hours", sign, two_places(a / 3600)))
        .when(a >= 60, F.format_string("%s%.2f minutes", sign, two_places(a / 60)))
        .when(a.isNotNull(), F.format_string("%s%.2f seconds", sign, two_places(a)))
    )


def _compact(value: Column, digits: int) -> Column:
    """``digits`` significant digits, trailing zeros removed, ties to even.

    Scientific when the exponent is below -4 or not below ``digits``.
    """
    size = F.abs(value)
    guess = F.floor(F.log10(size)).cast("int")
    lead = F.rint(size / F.pow(F.lit(10.0), guess - (digits - 1)))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))

    def parts(s: Column) -> Column:
        carried = s["lead"] >= 10.0**digits
        exponent = F.when(carried, s["guess"] + 1).otherwise(s["guess"])
        number = F.when(carried, s["lead"] / 10).otherwise(s["lead"]).cast("long").cast("string")
        return F.struct(exponent.alias("exponent"), number.alias("number"))

    def dotted(whole: Column, fraction: Column) -> Column:
        return F.rtrim(F.rtrim(F.concat(whole, F.lit("."), fraction), F.lit("0")), F.lit("."))

    def text(s: Column) -> Column:
        exponent, number = s["exponent"], s["number"]
        power = F.concat(
            F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")),
        )
        whole = F.when(exponent >= 0, F.substring(number, F.lit(1), exponent + 1)).otherwise(F.lit("0"))
        rest = F.when(exponent >= 0, F.substring(number, exponent + 2, F.lit(digits))).otherwise(
            F.concat(F.repeat(F.lit("0"), -exponent - 1), number)
        )
        return (
            F.when(
                (exponent < -4) | (exponent >= digits),
                F.concat(sign, dotted(F.substring(number, 1, 1), F.substring(number, 2, digits)), power),
            )
            .when(value.isNotNull(), F.concat(sign, dotted(whole, rest)))
        )

    # each part is worked out once
    once = F.struct(guess.alias("guess"), lead.alias("lead"))
    return F.when(value == 0, F.lit("0")).when(value.isNotNull(), _once(once, lambda s: _once(parts(s), text)))


def _once(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def two_places(value: Column) -> Column:
    """Rounded to cents, ties to even."""
    return F.rint(value * 100) / 100


def number_text(value: Column) -> Column:
    """Grouped integer, two decimals, or scientific when very large or small."""
    a = F.abs(value)
    extreme = (a != 0) & ((a >= 1e9) | (a < 1e-4))
    whole = value == F.floor(value)
    return (
        F.when(extreme, _compact(value, 4))
        .when(whole, F.format_number(value.cast("long"), 0))
        .when(value.isNotNull(), F.format_number(two_places(value), 2))
    )


def base_feature(name: Column) -> Column:
    """Attribute behind a history feature."""
    return F.regexp_replace(name, "(_past_avg|_past_mode)$", "")


def is_time_feature(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("time"))


def unscale(value: Column, mean: Column, scale: Column) -> Column:
    """Back to original units; unchanged where no scaler is known."""
    return F.coalesce(value * scale + mean, value)


def value_text(name: Column, text: Column, value: Column, mean: Column, scale: Column) -> Column:
    """Text stays, time features become durations, other numbers are formatted."""
    raw = unscale(value, mean, scale)
    shown = F.when(is_time_feature(base_feature(name)), duration_text(raw)).otherwise(number_text(raw))
    return F.coalesce(text, shown, F.lit("None"))


def threshold_text(value: Column) -> Column:
    """Threshold with six significant digits."""
    return _compact(value, 6)


def set_text(name: Column, values: Column, word: str, show: int = 5) -> Column:
    """``(attr in {a, b} (+k more))``, at most ``show`` values spelled out."""
    more = F.when(F.size(values) > show, F.format_string(" (+%d more)", F.size(values) - show)).otherwise("")
    return F.concat(
        F.lit("("), name, F.lit(f" {word} {{"), F.array_join(F.slice(values, 1, show), ", "), F.lit("}"), more, F.lit(")")
    )


def rule_text(intervals: Column, allowed: Column, excluded: Column, bound=None) -> Column:
    """Readable rule: sets in name order first, then bounds in name order.

    ``bound`` renders (feature, threshold); six significant digits by default.
    """
    bound = bound or (lambda _name, value: threshold_text(value))
    names = F.array_sort(F.array_union(F.map_keys(allowed), F.map_keys(excluded)))
    sets = F.transform(
        names,
        lambda n: F.when(F.coalesce(F.size(allowed[n]), F.lit(0)) > 0, set_text(n, allowed[n], "in"))
        .otherwise(set_text(n, excluded[n], "not in")),
    )
    bounds = F.transform(
        F.array_sort(F.map_keys(intervals)),
        lambda n: F.concat_ws(
            " AND ",
            F.when(intervals[n]["low"].isNotNull(), F.concat(F.lit("("), n, F.lit(" > "), bound(n, intervals[n]["low"]), F.lit(")"))),
            F.when(intervals[n]["high"].isNotNull(), F.concat(F.lit("("), n, F.lit(" <= "), bound(n, intervals[n]["high"]), F.lit(")"))),
        ),
    )
    parts = F.filter(F.concat(sets, bounds), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, " AND ")).otherwise(F.lit("(true)"))
