"""Business days, substitute holidays and Korean days as UTC."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Holidays moved off Sundays, and off weekends or other holidays.
SUNDAY_ONLY = {"설", "추석"}
WEEKEND = {"삼일절", "어린이날", "광복절", "개천절", "한글날", "부처님오신날", "기독탄신일", "제헌절", "노동절"}
ALIASES = {"설날": "설", "추석 연휴": "추석", "3·1절": "삼일절", "3.1절": "삼일절", "성탄절": "기독탄신일", "크리스마스": "기독탄신일"}
SUBSTITUTE = "대체공휴일"
LAST_BANK_YEAR = 2025


def with_substitutes(holidays: list[tuple[str, str]]) -> list[tuple[str, str, str | None]]:
    """(date, name, substitute_for) with the substitute days that the dates call for.

    Sequential: a day taken by one is not free for the next. A year has some
    twenty rows, so this runs on the driver.
    """
    by_date: dict[date, list[str]] = {}
    for d, name in holidays:
        by_date.setdefault(date.fromisoformat(d), []).append(name)
    taken, given = set(by_date), {d for d, names in by_date.items() if SUBSTITUTE in names}
    out = [(d, n, None) for d, n in holidays]
    for d in sorted(by_date):
        names = {("노동절" if n == "근로자의 날" and d.year >= 2026 else ALIASES.get(n, n)): None for n in by_date[d]}
        moved = [n for n in names if n in SUNDAY_ONLY | WEEKEND]
        sunday, weekend = d.weekday() == 6, d.weekday() >= 5
        if not moved or not (len(names) > 1 or any(sunday if n in SUNDAY_ONLY else weekend for n in moved)):
            continue
        for k in range(1, 31):
            day = d + timedelta(k)
            if day in given:
                given.discard(day)
                break
            if day.weekday() < 5 and day not in taken:
                taken.add(day)
                out.append((day.isoformat(), SUBSTITUTE, ", ".join(moved)))
                break
    return sorted(out, key=lambda r: r[0])


def bank_closed(closed: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """closed (d) with the first of May of years in which it is no public holiday."""
    years = closed.sparkSession.range(first_year, min(last_year, LAST_BANK_YEAR) + 1).select(F.make_date(F.col("id").cast("int"), F.lit(5), F.lit(1)).alias("d"))
    return closed.select("d").unionByName(years).distinct()


def calendar(closed: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (d, is_open, n_open): n_open counts open days up to d. One row a day, so one window is small."""
    days = closed.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d"))
    rows = days.join(closed.select("d", F.lit(True).alias("c")), "d", "left").select("d", (~F.dayofweek("d").isin(1, 7) & F.col("c").isNull()).alias("is_open"))
    return rows.withColumn("n_open", F.sum(F.col("is_open").cast("long")).over(Window.orderBy("d")))


def add_business_days(df: DataFrame, date_col: str, n: Column, days: DataFrame) -> DataFrame:
    """df with due: the n-th open day after its date; the date itself for n of 0 or less."""
    small = F.broadcast(days)  # a row for each day of the calendar
    rows = df.withColumn("__n", n).join(small.select(F.col("d").alias(date_col), F.col("n_open").alias("__at")), date_col, "left")
    target = days.where("is_open").select(F.col("d").alias("__due"), F.col("n_open").alias("__key"))
    rows = rows.join(F.broadcast(target), F.col("__at") + F.col("__n") == F.col("__key"), "left")
    return rows.withColumn("due", F.when(F.col("__n") <= 0, F.col(date_col)).otherwise(F.col("__due"))).drop("__n", "__at", "__due", "__key")


def kst_day_start(day: Column) -> Column:
    """The UTC instant (no zone) at which a Korean day begins."""
    return day.cast("timestamp_ntz") - F.expr("INTERVAL 9 HOURS")
