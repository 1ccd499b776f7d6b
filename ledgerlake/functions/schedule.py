"""Five-field schedules (minute, hour, day of month, month, day of week) as Columns."""

from __future__ import annotations

import re
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import at_zone

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
#: How far a search goes: 29 February may be eight years away.
HORIZON_DAYS = 8 * 366
_PART = re.compile(r"(\*|\?|[0-9]{1,2}(?:-[0-9]{1,2})?)(?:/([0-9]{1,2}))?")
_FIELDS = ((0, 59, ()), (0, 23, ()), (1, 31, ()), (1, 12, MONTHS), (0, 7, DAYS))


def _bits(text: str, low: int, high: int, names: tuple[str, ...]) -> int:
    """The values that a field allows, as bits, or 0 if it can't be read. Parts are *, ?, a, a-b, each with /step or not;
    a/step runs up to the end."""
    text, bits = text.upper(), 0
    for k, name in enumerate(names):
        text = re.sub(rf"\b{name}\b", str(k + low), text)
    for part in text.split(","):
        if not (found := _PART.fullmatch(part)):
            return 0
        ends, by = found[1].split("-"), found[2]
        first = low if ends[0] in "*?" else int(ends[0])
        last = high if ends[0] in "*?" or len(ends) == 1 and by else int(ends[-1])
        if not low <= first <= last <= high or by and int(by) == 0:
            return 0
        for v in range(first, last + 1, int(by or 1)):
            bits |= 1 << v
    return bits


def _read(cron: str) -> tuple[int, ...]:
    """Bits of minutes, hours, days, months and days of week, from Sunday; zeros if the expression can't be read."""
    fields = re.split(r"[\x20\t]+", cron.strip(" "))
    bits = [_bits(f, *kind) for f, kind in zip(fields, _FIELDS, strict=True)] if len(fields) == 5 else [0]
    return (*bits[:4], bits[4] & 127 | bits[4] >> 7) if all(bits) else (0,) * 5


def _next_minutes(crons: pd.Series, days: pd.Series, clocks: pd.Series) -> pd.Series:
    """Minutes since 1970 of the first firing after a minute of a day, many rows at a time: each expression is read once,
    and the months are gone through for the rows that have no day yet."""
    codes, texts = pd.factorize(crons)
    bits = np.array([*map(_read, texts), (0,) * 5], np.int64)[codes]  # null is the last
    out = np.full(len(crons), np.nan)
    at = np.flatnonzero((bits[:, 0] != 0) & days.notna().to_numpy() & clocks.notna().to_numpy())
    minutes, hours, on, months, week = bits[at].T
    today, (hour, minute) = days.to_numpy()[at].astype(np.int64), np.divmod(clocks.to_numpy()[at].astype(np.int64), 60)
    one = np.int64(1)
    lowest = lambda x: np.frexp((x & -x).astype(float))[1] - 1
    above = lambda x, n: x & ~((one << n + 1) - 1)
    first, this_hour, next_hour = lowest(minutes), above(minutes, minute), above(hours, hour)
    later = np.where((hours >> hour & 1 != 0) & (this_hour != 0), hour * 60 + lowest(this_hour), np.where(next_hour != 0, lowest(next_hour) * 60 + first, -1))
    # bit 1 + 7 a + d is the weekday d of week a; moved down by a month's first weekday, bit n is the month's day n
    weeks = week * sum(2 << 7 * k for k in range(6))
    month = today.astype("datetime64[D]").astype("datetime64[M]")
    # today counts if a time of it is left
    start = today - month.astype("datetime64[D]").astype(np.int64) + np.where(later >= 0, 1, 2)
    day, open_ = np.full(len(at), -1), np.arange(len(at))
    found = np.zeros(len(at), bool)
    for k in range(HORIZON_DAYS // 30 + 1):
        if not len(open_):
            break
        begin, end = ((month[open_] + n).astype("datetime64[D]").astype(np.int64) for n in (k, k + 1))
        there = (one << end - begin + 1) - (one << (start[open_] if k == 0 else 1))
        fits = np.where(months[open_] >> (month[open_] + k).astype(np.int64) % 12 + 1 & 1, on[open_] & weeks[open_] >> (begin + 4) % 7 & there, 0)
        hit = fits != 0
        day[open_[hit]], found[open_[hit]] = (begin + lowest(fits) - 1)[hit], True
        open_ = open_[~hit]
    found &= day <= today + HORIZON_DAYS
    out[at[found]] = (day * 1440 + np.where(day == today, later, lowest(hours) * 60 + first))[found]
    return pd.Series(out).astype("Int64")


def next_occurrence(cron: Column, after: Column, zone: str = "UTC") -> Column:
    """The first firing after a UTC time (itself excluded), as a UTC time without a zone; null if the expression
    can't be read, or does not fire within eight years.

    Day of month and day of week must both hold. 0 and 7 are Sunday; names of months and days are read in any case.
    L, W and # are not read. The search runs on the zone's wall clock: a time that a clock change leaves out moves on
    by the change, and a time that occurs twice fires once. Null in, null out. Batches of rows are searched with numpy,
    as the search in Columns would run its lambdas row by row.
    """
    now, epoch = at_zone(after, zone), F.lit(date(1970, 1, 1))
    found = F.pandas_udf(_next_minutes, "bigint")(cron, F.datediff(now, epoch), F.hour(now) * 60 + F.minute(now))
    day = F.date_add(epoch, F.floor(found / 1440).cast("int")).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.timestamp_add("MINUTE", F.pmod(found, F.lit(1440)).cast("int"), day))


def is_due(enabled: Column, cron: Column, last_run: Column, created: Column, now: Column, zone: str = "UTC") -> Column:
    """Whether a task is enabled and a firing has come since its last run, or since it was made."""
    return F.coalesce(enabled & (next_occurrence(cron, F.coalesce(last_run, created), zone) <= now.cast("timestamp_ntz")), F.lit(False))
