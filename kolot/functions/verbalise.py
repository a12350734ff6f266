"""Typed columns as they are said: dates, times, money, percentages, units, ranges. Null stays null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolot import lexicon as L
from kolot.config import Clock, Config, DateOrder
from kolot.functions.numerals import amount, cardinal, decimal, digits, lit_of, ordinal, over
from kolot.operators.rules import phones



def _day_month(day: Column, month: Column) -> Column:
    return F.concat(F.when(day == 1, L.THE + L.ORDINALS["m"][0]).otherwise(cardinal(day, "m", most=31)), F.lit(" ב"), lit_of(L.MONTHS, month - 1))


def date_words(date: Column) -> Column:
    """A date or timestamp: day, month and year."""
    return F.concat(_day_month(F.dayofmonth(date), F.month(date)), F.lit(" "), cardinal(F.year(date), most=9999))


def month_year_words(date: Column) -> Column:
    return F.concat(lit_of(L.MONTHS, F.month(date) - 1), F.lit(" "), cardinal(F.year(date), most=9999))


def days_in_month(month: Column, year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def numeric_date_words(first: Column, second: Column, year: Column, cfg: Config = Config()) -> Column:
    """Two numbers and a year, in the order that settings prefer or else the other; null where neither is a date."""

    def said(day: Column, month: Column) -> Column:
        ok = year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= days_in_month(month, year))
        return F.when(ok, F.concat(_day_month(day, month), F.lit(" "), cardinal(year, most=9999)))

    orders = [said(first, second), said(second, first)]
    return F.coalesce(*(orders[::-1] if cfg.date_order == DateOrder.MDY else orders))


def full_year(two_digits: Column) -> Column:
    return two_digits + F.when(two_digits <= 29, 2000).otherwise(1900)


def _minute(value: Column) -> Column:
    return F.when(value < 10, F.concat(F.lit(L.ONES["f"][0] + " "), lit_of(L.ONES["f"], value))).otherwise(cardinal(value, most=59))


def time_words(time: Column, cfg: Config = Config(), seconds: bool = False) -> Column:
    """Hour and minute of a timestamp. With seconds it is read as written, whatever the settings."""
    hour, minute = F.hour(time), F.minute(time)
    if seconds or cfg.clock == Clock.H24:
        parts = [cardinal(hour, most=23), _minute(minute)] + ([_minute(F.second(time))] if seconds else [])
        return F.when(time.isNotNull(), F.concat_ws(" ", *parts))
    face = lambda h: cardinal((h + 11) % 12 + 1, most=12)
    part = F.when(hour == 12, L.NOON).when(hour.between(5, 11), L.MORNING).when(hour.between(13, 16), L.AFTERNOON).when(hour.between(17, 20), L.EVENING).otherwise(L.NIGHT)
    said = (
        F.when(minute == 0, face(hour))
        .when(minute == 45, F.concat(F.lit(L.QUARTER_TO), face(hour + 1)))
        .when(minute == 15, F.concat(face(hour), F.lit(f" {L.AND}{L.QUARTER}")))
        .when(minute == 30, F.concat(face(hour), F.lit(f" {L.AND}{L.HALF}")))
        .otherwise(F.concat(face(hour), F.lit(f" {L.AND}"), cardinal(minute, most=59)))
    )
    return F.when((hour == 0) & (minute == 0), L.MIDNIGHT).otherwise(F.concat(said, F.lit(" "), part))


def currency_words(value: Column, code: str = "ILS", cfg: Config = Config(), most: int = 10**15) -> Column:
    """Money to two places, minus said aloud. Whole and minor units agree with their own nouns; without minor units a fraction is read as a decimal."""
    _, one, many, gender, cent, cents, cent_gender, _ = next(c for c in L.CURRENCIES if c[0] == code)
    cents_all = F.round(F.abs(value.cast("decimal(18,2)")) * 100).cast("long")
    n, minor = over(cents_all, 100), cents_all % 100
    if cfg.read_minor_currency:
        majors, minors = amount(n, one, many, gender, most), amount(minor, cent, cents, cent_gender, 99)
        said = F.when(minor == 0, majors).when(n == 0, minors).otherwise(F.concat(majors, F.lit(f" {L.AND}"), minors))
    else:
        said = F.when(minor == 0, amount(n, one, many, gender, most)).otherwise(F.concat(decimal(n, F.lpad(minor.cast("string"), 2, "0"), cfg, gender, most), F.lit(" " + many)))
    return F.concat(F.when(value < 0, L.MINUS + " ").otherwise(""), said)


def _split(value: Column) -> tuple[Column, Column, Column]:
    """Whole part, fraction digits without zeros at the end, sign, of a number to two places."""
    hundredths = F.round(F.abs(value.cast("decimal(18,2)")) * 100).cast("long")
    return over(hundredths, 100), F.regexp_replace(F.lpad((hundredths % 100).cast("string"), 2, "0"), "0+$", ""), F.when(value.cast("decimal(18,2)") < 0, L.MINUS + " ").otherwise("")


def number_words(value: Column, cfg: Config = Config(), most: int = 10**15) -> Column:
    """A number to two places, in the counting series."""
    n, fraction, sign = _split(value)
    return F.concat(sign, F.when(fraction == "", cardinal(n, most=most)).otherwise(decimal(n, fraction, cfg, most=most)))


def percent_words(value: Column, cfg: Config = Config(), most: int = 10**15) -> Column:
    """A percentage to two places, always masculine."""
    n, fraction, sign = _split(value)
    return F.concat(sign, F.when(fraction == "", amount(n, L.PERCENT, L.PERCENTS, "m", most)).otherwise(F.concat(decimal(n, fraction, cfg, "m", most), F.lit(" " + L.PERCENTS))))


def unit_words(value: Column, unit: str, cfg: Config = Config(), most: int = 10**15) -> Column:
    """A measure to two places: a fraction keeps the singular, but for degrees."""
    one, many, gender = L.UNIT_OF[unit]
    n, fraction, sign = _split(value)
    return F.concat(sign, F.when(fraction == "", amount(n, one, many, gender, most)).otherwise(F.concat(decimal(n, fraction, cfg, most=most), F.lit(" " + (many if one == L.DEGREE else one)))))


def degree_words(value: Column, scale: str | None = None, cfg: Config = Config(), most: int = 10**15) -> Column:
    said = unit_words(value, L.DEGREES, cfg, most)
    return F.concat(said, F.lit(" " + L.DEGREE_SCALES[scale])) if scale else said


def range_words(low: Column, high: Column, unit: str | None = None, most: int = 10**15) -> Column:
    """Both ends agree with the unit, or count in the feminine."""
    _, many, gender = L.UNIT_OF[unit] if unit else ("", "", "f")
    return F.concat(cardinal(low, gender, most=most), F.lit(f" {L.UNTIL} "), cardinal(high, gender, most=most), F.lit(f" {many}" if many else ""))


def ip_words(text: Column, cfg: Config = Config()) -> Column:
    """The first dotted quad of a text, digit by digit; null without one or with an octet above 255."""
    octets = [F.regexp_extract(text, phones.ADDRESS, i) for i in range(1, 5)]
    ok = octets[0] != ""
    for o in octets:
        ok = ok & (F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)
    return F.when(ok, F.concat_ws(f" {cfg.decimal_word} ", *map(digits, octets)))


def card_words(text: Column) -> Column:
    """The digits of the first card number of a text; null without one."""
    found = F.regexp_extract(text, phones.CARD, 0)
    return F.when(found != "", digits(found))


__all__ = [n for n in dir() if n.endswith("words")] + ["ordinal"]
