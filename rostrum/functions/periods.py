"""Free-form periods as ranges of time, in Column expressions: whole tables of periods, or a literal that a filter folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What asks for all rows, what for the last week, and the labels of spans that are no month.
ALL_TIME = ("all", "all time", "everything", "any", "ever")
RECENT = ("", "recent")
LABELS = {"days": "the last %d days", "all": "the whole registry", "today": "today", "range": "%s to %s"}
#: The months, by name or the first three letters of it.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _number(text: Column, pattern: str) -> Column:
    """What the pattern's group reads of the whole text, as a number; null where it does not match or is no long."""
    return F.regexp_extract(text, f"^(?:{pattern})$", 1).try_cast("long")


def _month_asked(asked: Column, now: Column) -> Column:
    """Months since year 0 of the calendar month that is asked for, or null."""
    current = F.year(now) * 12 + F.month(now) - 1
    year, month = _number(asked, r"(\d{4})-\d{2}"), _number(asked, r"\d{4}-(\d{2})")
    word = F.regexp_extract(asked, r"^([a-z]+)\.?\s*(?:\d{4})?$", 1)
    named = F.coalesce(*(F.when(word.isin(name, name[:3]), k) for k, name in enumerate(MONTHS)))
    own_year = F.coalesce(_number(asked, r"[a-z]+\.?\s*(\d{4})"), F.year(now).cast("long"))
    return F.coalesce(
        F.when(asked == "this month", current), F.when(asked == "last month", current - 1), F.when(month.between(1, 12), year * 12 + month - 1), own_year * 12 + named
    )


def period_of(text: Column, now: Column) -> Column:
    """struct(start, end, label) of a period, end exclusive; null where the text is no period.

    Understands, in any case: recent or blank or null (the last 7 days), all and its like, today, this month,
    last month, last N days, YYYY-MM, YYYY-MM-DD..YYYY-MM-DD (the last day included), and a month by name or
    short name with an optional year (without one: of this year). A month ends now at the latest.
    """
    asked, day = F.lower(F.trim(F.coalesce(text, F.lit("")))), lambda n: F.make_interval(days=n)
    span = lambda start, end, label: F.struct(start.alias("start"), end.alias("end"), label.alias("label"))
    month = _month_asked(asked, now)
    begin = F.to_timestamp(F.make_date((month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1)))
    in_month = span(begin, F.least(F.to_timestamp(F.add_months(begin.cast("date"), 1)), now), F.date_format(begin, "MMMM yyyy"))
    back = F.when(asked.isin(*RECENT), F.lit(7)).otherwise(_number(asked, r"last (\d+) days?")).try_cast("int")
    days = span(now - day(back), now, F.format_string(LABELS["days"], back))
    ends = [F.regexp_extract(asked, r"^(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})$", k) for k in (1, 2)]
    dates = [x.try_cast("date") for x in ends]
    between = span(F.to_timestamp(dates[0]), F.to_timestamp(F.date_add(dates[1], 1)), F.format_string(LABELS["range"], *ends))
    whole = span(F.lit("1970-01-01").cast("timestamp"), now + day(F.lit(1)), F.lit(LABELS["all"]))
    today = span(F.date_trunc("day", now), now, F.lit(LABELS["today"]))
    return (
        F.when(asked.isin(*ALL_TIME), whole).when(asked == "today", today).when(back.isNotNull(), days)
        .when(dates[0].isNotNull() & dates[1].isNotNull(), between).when(month.isNotNull(), in_month)
    )
