"""Normalisation of feed rows to the common posting schema; narrow expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords in the order in which they decide.
REMOTE_WORDS = [("remote", "remote"), ("hybrid", "hybrid"), ("on-site", "on-site"), ("onsite", "on-site"), ("in office", "on-site"), ("in-office", "on-site")]
#: The same for scraped rows.
SCRAPED_WORDS = [("remote", "remote"), ("hybrid", "hybrid"), ("on-site", "on-site"), ("onsite", "on-site"), ("in office", "on-site")]
#: Pay periods' factor to a year.
YEARLY = {"hourly": 2080, "monthly": 12}


def infer_remote_type(*parts: Column, words: list[tuple[str, str]] = REMOTE_WORDS) -> Column:
    """First of words that the joined parts hold, else unknown; null parts count as empty."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))
    found = F.lit("unknown")
    for word, kind in reversed(words):
        found = F.when(F.contains(text, F.lit(word)), kind).otherwise(found)
    return found


def yearly(amount: Column, period: Column) -> Column:
    """Whole yearly pay; unknown periods stay unscaled."""
    factor = F.lit(1)
    for name, times in YEARLY.items():
        factor = F.when(period == name, times).otherwise(factor)
    return (amount * factor).cast("long")


def annualize(amount: Column, period: Column) -> Column:
    """yearly, and zero is null."""
    return F.nullif(yearly(amount, period), F.lit(0).cast("long"))


def salary_raw(low: Column, high: Column, period: Column) -> Column:
    """min-max USD period; a missing bound is printed as None, and without either there is no text."""
    shown = lambda c: F.coalesce(F.nullif(c, F.lit(0).cast("long")).cast("string"), F.lit("None"))
    return F.when((F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0), F.concat(shown(low), F.lit("-"), shown(high), F.lit(" USD "), period))


def parse_relative_date(text: Column, as_of: Column) -> Column:
    """ISO date of phrases such as '3 days ago'; only a number at the start counts; unknown phrases are null."""
    low = F.lower(F.btrim(text))
    count = lambda unit: F.nullif(F.regexp_extract(low, rf"^(\d+)\s+{unit}", 1), F.lit("")).try_cast("int")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))
    date = (
        F.when(text == "", F.lit(None))
        .when(low.isin("today", "just posted", ""), as_of)
        .when(count("day").isNotNull(), F.date_sub(as_of, count("day")))
        .when(count("hour").isNotNull(), as_of)
        .when(count("month").isNotNull(), F.date_sub(as_of, F.try_multiply(F.lit(30), count("month"))))
        .when(count("week").isNotNull(), F.date_sub(as_of, F.try_multiply(F.lit(7), count("week"))))
        .otherwise(iso)
    )
    return date.cast("string")


def is_fresh(date_posted: Column, cutoff: Column) -> Column:
    """Posted on or after the cutoff, which may be a date or a time; null and unparseable dates stay.

    A time of the form 2024-01-05T10:00:00Z counts with its time of day, a bare date as its midnight.
    """
    dated = date_posted.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    at = F.coalesce(F.try_to_timestamp(F.when(dated, date_posted)), F.try_to_timestamp(F.when(dated, F.substring(date_posted, 1, 10)), F.lit("yyyy-MM-dd")))
    return at.isNull() | (at >= cutoff)


def scraped_pay(amount: Column, period: Column) -> Column:
    """Whole yearly pay of a scraped text: commas and dollar signs go, nan and what is no number are null, zero stays."""
    plain = F.regexp_replace(F.coalesce(amount.cast("string"), F.lit("")), r"[,$\s]", "").try_cast("double")
    return yearly(F.when(~F.isnan(plain), plain), F.coalesce(period, F.lit("")))


def stated_pay(low: Column, high: Column, period: Column, currency: Column) -> tuple[Column, Column, Column]:
    """(salary_min, salary_max, salary_raw) of a search service's amounts, numbers or texts of them: yearly amounts (null,
    zero and what is no number: null), and the amounts as stated with their currency (null: USD) and period; without
    either amount there is no text."""
    of = F.lower(F.coalesce(period, F.lit("")))
    number = lambda c: c.cast("string").try_cast("double")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    some = (F.coalesce(number(low), F.lit(0.0)) != 0) | (F.coalesce(number(high), F.lit(0.0)) != 0)
    text = F.btrim(F.concat(shown(low), F.lit("-"), shown(high), F.lit(" "), stated_currency(currency), F.lit(" "), of))
    return annualize(number(low), of), annualize(number(high), of), F.when(some, text)


def stated_currency(currency: Column) -> Column:
    """The currency; null and empty: USD."""
    return F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD"))


def stated_period(period: Column) -> Column:
    """annual where yearly pay can be told from the period (none counts as a year), else the period in lower case."""
    of = F.lower(F.coalesce(period, F.lit("")))
    return F.when(of.isin("", "yearly", *YEARLY), "annual").otherwise(of)


def scraped_amounts(low: Column, high: Column, interval: Column, currency: Column) -> tuple[Column, Column, Column]:
    """(salary_min, salary_max, salary_raw) of a scraper's texts; the text shows the yearly amounts, and there is none
    without an amount other than zero."""
    low, high = scraped_pay(low, interval), scraped_pay(high, interval)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    text = F.btrim(F.concat(shown(low), F.lit("-"), shown(high), F.lit(" "), stated_currency(currency), F.lit(" "), F.coalesce(interval, F.lit(""))))
    some = (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)
    return low, high, F.when(some, text)


def fresh_since(as_of: Column, retention_days: int, last_run: Column) -> Column:
    """Cutoff of a profile: its last run, but retention_days ago at most; a last run that is no time falls back to that."""
    oldest = F.date_sub(as_of, retention_days).cast("timestamp")
    return F.greatest(oldest, F.coalesce(F.try_to_timestamp(last_run), oldest))
