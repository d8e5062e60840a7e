"""Calendar parts, weekends, fixed holidays and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (month, day) holidays of each calendar, and the normalised
# country names that use a calendar other than the common one.
COMMON_HOLIDAYS = [(1, 1), (5, 1), (12, 25)]
RUSSIAN_HOLIDAYS = [
    (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8),
    (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4),
]
POST_SOVIET_HOLIDAYS = [(1, 1), (1, 7), (3, 8), (5, 1), (5, 9)]
RUSSIAN_NAMES = ["russian_federation", "russia", "ru", "rus"]
POST_SOVIET_NAMES = [
    "belarus", "kazakhstan", "ukraine", "armenia",
    "azerbaijan", "georgia", "kyrgyzstan", "moldova",
]
# Season of each month, northern hemisphere.
SEASONS = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11]}


def date_parts(date="date") -> dict[str, Column]:
    d = F.col(date)
    return {"day": F.dayofmonth(d), "month": F.month(d), "year": F.year(d)}


def valid_date(year="year", month="month", day="day") -> Column:
    """True where the three parts form a real date."""
    y, m, d = (F.col(c) for c in (year, month, day))
    in_range = m.between(1, 12) & d.between(1, 31)
    last = F.dayofmonth(F.last_day(F.make_date(y, F.when(in_range, m).otherwise(1), F.lit(1))))
    return F.coalesce(in_range & (d <= last), F.lit(False))


def _in_calendar(date: Column, holidays) -> Column:
    return (F.month(date) * 100 + F.dayofmonth(date)).isin([m * 100 + d for m, d in holidays])


def is_fixed_holiday(date: Column, country: Column) -> Column:
    name = F.translate(F.lower(F.trim(F.coalesce(country, F.lit("")))), " -", "__")
    return (
        F.when(name.isin(RUSSIAN_NAMES), _in_calendar(date, RUSSIAN_HOLIDAYS))
        .when(name.isin(POST_SOVIET_NAMES), _in_calendar(date, POST_SOVIET_HOLIDAYS))
        .otherwise(_in_calendar(date, COMMON_HOLIDAYS))
    )


def add_calendar_features(df: DataFrame, date="date", country="country") -> DataFrame:
    """Six byte flags: weekend and holiday, today, yesterday and either."""
    today = F.col(date)
    before = F.date_sub(today, 1)
    land = F.col(country) if country in df.columns else F.lit(None).cast("string")
    pairs = {
        "weekend": (F.weekday(today) >= 5, F.weekday(before) >= 5),
        "holiday": (is_fixed_holiday(today, land), is_fixed_holiday(before, land)),
    }
    out = {}
    for kind, (now, prior) in pairs.items():
        now, prior = F.coalesce(now, F.lit(False)), F.coalesce(prior, F.lit(False))
        out[f"is_{kind}_today"] = now.cast("byte")
        out[f"is_{kind}_yesterday"] = prior.cast("byte")
        out[f"is_{kind}_today_or_yesterday"] = (now | prior).cast("byte")
    return df.withColumns(out)


def season(month="month") -> Column:
    m = F.col(month) if isinstance(month, str) else month
    chain = None
    for name, months in SEASONS.items():
        chain = F.when(m.isin(months), name) if chain is None else chain.when(m.isin(months), name)
    return chain.otherwise("unknown")


def period_start(date, frequency: str) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    if frequency == "day":
        return d.cast("date")
    return F.trunc(d, "week" if frequency == "week" else "month")


def period_end(date, frequency: str) -> Column:
    """Last day of the period: the day itself, the Sunday, or the month end."""
    start = period_start(date, frequency)
    if frequency == "day":
        return start
    return F.date_add(start, 6) if frequency == "week" else F.last_day(start)
