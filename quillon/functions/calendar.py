"""Calendars by rule, for any year, as column functions; beside each its SQL over a date `d` and that year's Easter `e`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holidays around New Year and in summer (month and day, ends included), and days whose week is a half-term (fixed values).
LONG_BREAKS = ((101, 103), (720, 902), (1221, 1231))
HALF_TERMS = ((2, 15), (5, 31), (10, 28))
#: University terms: the first Friday from a day of the year (or from so many days after Easter), and how many days they last (fixed values).
UNI_TERMS = (("michaelmas", (10, 1), 70), ("lent", (1, 8), 70), ("summer", 18, 63))


#: Years whose Easter is known to `easter`.
FIRST_YEAR, LAST_YEAR = 1900, 2199


def easter_offset(year: int) -> int:
    """Days from the first of March to Easter Sunday of the Gregorian calendar."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114
    return (n // 31 - 3) * 31 + n % 31


def easter(year: Column) -> Column:
    """Easter Sunday; null outside FIRST_YEAR to LAST_YEAR. The rule is worked out once for every year, into one literal."""
    offsets = F.split(F.lit(",".join(str(easter_offset(y)) for y in range(FIRST_YEAR, LAST_YEAR + 1))), ",").cast("array<int>")
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), F.get(offsets, year - FIRST_YEAR))


def is_bank_holiday(d: Column) -> Column:
    """Bank holidays of England and Wales, with their substitutes; days proclaimed for one year only are not among them."""
    e, md, dow = easter(F.year(d)), F.month(d) * 100 + F.day(d), F.weekday(d)
    monday = dow == 0
    new_year = ((md == 101) & (dow < 5)) | (monday & md.isin(102, 103))
    christmas = (md.isin(1225, 1226) & (dow < 5)) | (md.isin(1227, 1228) & (dow <= 1))
    in_season = monday & (md.between(501, 507) | md.between(525, 531) | md.between(825, 831))
    return new_year | christmas | in_season | (d == F.date_sub(e, 2)) | (d == F.date_add(e, 1))


BANK_HOLIDAY_SQL = """((month(d) * 100 + day(d) = 101 AND isodow(d) < 6) OR (isodow(d) = 1 AND month(d) * 100 + day(d) IN (102, 103))
  OR (month(d) * 100 + day(d) IN (1225, 1226) AND isodow(d) < 6) OR (month(d) * 100 + day(d) IN (1227, 1228) AND isodow(d) <= 2)
  OR (isodow(d) = 1 AND ((month(d) = 5 AND (day(d) <= 7 OR day(d) >= 25)) OR (month(d) = 8 AND day(d) >= 25))) OR d = e - 2 OR d = e + 1)"""


def is_school_term(d: Column) -> Column:
    """Days outside the school holidays; weekends within a term are term."""
    e, md, monday = easter(F.year(d)), F.month(d) * 100 + F.day(d), F.trunc(d, "week")
    off = d.between(F.date_sub(e, 2), F.date_add(e, 14))
    for a, b in LONG_BREAKS:
        off = off | md.between(a, b)
    for month, day in HALF_TERMS:
        off = off | (monday == F.trunc(F.make_date(F.year(d), F.lit(month), F.lit(day)), "week"))
    return ~off


SCHOOL_TERM_SQL = "NOT (d BETWEEN e - 2 AND e + 14 OR {} OR {})".format(
    " OR ".join(f"month(d) * 100 + day(d) BETWEEN {a} AND {b}" for a, b in LONG_BREAKS),
    " OR ".join(f"date_trunc('week', d) = date_trunc('week', make_date(year(d), {m}, {n}))" for m, n in HALF_TERMS),
)


def _friday(d: Column) -> Column:
    """The first Friday on or after a day."""
    return F.date_add(d, F.pmod(4 - F.weekday(d), F.lit(7)))


def uni_phase(d: Column) -> Column:
    """The university term a day lies in, or "vacation"."""
    out = F.lit("vacation")
    for name, start, days in reversed(UNI_TERMS):
        first = _friday(F.date_add(easter(F.year(d)), start) if isinstance(start, int) else F.make_date(F.year(d), F.lit(start[0]), F.lit(start[1])))
        out = F.when(d.between(first, F.date_add(first, days - 1)), name).otherwise(out)
    return out


def _friday_sql(d: str) -> str:
    return f"({d} + CAST((12 - isodow({d})) % 7 AS INTEGER))"


def _start_sql(start) -> str:
    return _friday_sql(f"(e + {start})" if isinstance(start, int) else f"make_date(year(d), {start[0]}, {start[1]})")


UNI_PHASE_SQL = "CASE {} ELSE 'vacation' END".format(" ".join(f"WHEN d BETWEEN {_start_sql(s)} AND {_start_sql(s)} + {n - 1} THEN '{name}'" for name, s, n in UNI_TERMS))

#: easters (y, e) for SQL, by the same rule.
EASTERS_SQL = """easters AS (
  SELECT y, CAST(make_date(y, (n // 31), n % 31 + 1) AS DATE) AS e FROM (
    SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h,
      (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM range(1900, 2100) AS r(y)))"""
