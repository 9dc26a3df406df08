"""The `.dt` family. Timestamps are UTC without zone; a zone given to a function only shifts what is read off. Durations are milliseconds."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError
from loomframe.functions.strings import DIRECTIVES, pieces

UNITS = {"s": 1_000_000, "ms": 1000, "us": 1}
DAY = 86_400_000


def stamp(ctx: Any, x: Column) -> Column:
    t = ctx.type(x)
    return x if isinstance(t, T.TimestampNTZType) else LT.parse_timestamp(x, t)


def shifted(x: Column, zone: str | None) -> Column:
    return x if zone in (None, "UTC") else F.from_utc_timestamp(x.cast("timestamp"), zone).cast("timestamp_ntz")


class Temporal:
    def __init__(self, e):
        self.e = e

    def _t(self, fn, zone=None):
        """fn over the timestamp as it reads in a zone: the one given, or that of convert_time_zone."""
        zone = zone or getattr(self.e, "zone", None)
        return self.e._map(lambda ctx, x: fn(shifted(stamp(ctx, x), zone)))

    def _n(self, fn):
        return self.e._map(lambda ctx, x: fn(LT.number(x, ctx.type(x))))

    def year(self, time_zone=None):
        return self._t(F.year, time_zone)

    def quarter(self):
        return self._t(F.quarter)

    def month(self, time_zone=None):
        return self._t(F.month, time_zone)

    def iso_week(self):
        return self._t(F.weekofyear)

    week = iso_week

    def iso_year(self):
        return self._t(lambda x: F.date_part(F.lit("YEAROFWEEK"), x))

    def day(self, time_zone=None):
        return self._t(F.dayofmonth, time_zone)

    def weekday(self, time_zone=None):
        """1 is Monday, 7 Sunday."""
        return self._t(lambda x: F.weekday(x) + 1, time_zone)

    def ordinal_day(self):
        return self._t(F.dayofyear)

    def hour(self, time_zone=None):
        return self._t(F.hour, time_zone)

    def minute(self, time_zone=None):
        return self._t(F.minute, time_zone)

    def second(self):
        return self._t(F.second)

    def millisecond(self):
        return self._t(lambda x: F.pmod(F.floor(F.unix_micros(x.cast("timestamp")) / 1000), F.lit(1000)).cast("int"))

    def microsecond(self):
        return self._t(lambda x: (F.pmod(F.floor(F.unix_micros(x.cast("timestamp")) / 1000), F.lit(1000)) * 1000).cast("int"))

    def nanosecond(self):
        return self._t(lambda x: (F.pmod(F.floor(F.unix_micros(x.cast("timestamp")) / 1000), F.lit(1000)) * 1_000_000).cast("int"))

    def century(self):
        return self._t(lambda x: (F.floor((F.year(x) - 1) / 100) + 1).cast("int"))

    def millennium(self):
        return self._t(lambda x: (F.floor((F.year(x) - 1) / 1000) + 1).cast("int"))

    def is_leap_year(self):
        return self._t(lambda x: (F.year(x) % 4 == 0) & ((F.year(x) % 100 != 0) | (F.year(x) % 400 == 0)))

    def days_in_month(self, time_zone=None):
        return self._t(lambda x: F.dayofmonth(F.last_day(x)), time_zone)

    def month_start(self):
        return self._t(lambda x: F.date_trunc("month", x).cast("timestamp_ntz"))

    def month_end(self):
        return self._t(lambda x: F.last_day(x).cast("timestamp_ntz"))

    def truncate(self, unit: str):
        """The start of the year, quarter, month, week, day, hour, minute or second."""
        return self._t(lambda x: F.date_trunc(unit, x).cast("timestamp_ntz"))

    def date(self):
        return self._t(lambda x: x.cast("date"))

    def time(self):
        return self._t(lambda x: F.date_format(x, "HH:mm:ss.SSS"))

    def epoch(self, unit: str = "ms"):
        if unit not in (*UNITS, "ns"):
            raise InvalidArgumentError(f"no unit is called {unit!r}")

        def build(x):
            us = F.unix_micros(x.cast("timestamp"))
            return us * 1000 if unit == "ns" else F.floor(us / UNITS[unit]).cast("long")

        return self.e._map(lambda ctx, x: build(stamp(ctx, x)))

    timestamp = epoch

    def cast_time_unit(self, unit: str):
        """Values stay; Spark's timestamps hold microseconds."""
        if unit not in ("ms", "us", "ns"):
            raise InvalidArgumentError(f"no unit is called {unit!r}")
        return self.e._map(lambda ctx, x: x)

    def convert_time_zone(self, time_zone: str):
        """The same instant; what is read off or printed next is in the zone."""
        out = self.e._map(lambda ctx, x: stamp(ctx, x))
        out.zone = time_zone
        return out

    def utc_offset(self, time_zone: str | None = None, *, kind: str = "total", format: str = "ms"):
        """Offset of a zone: total, base or daylight; as ms, min, h, iso (+01:00) or basic (+0100)."""
        zone = time_zone or getattr(self.e, "zone", None) or "UTC"
        if kind not in ("total", "base", "daylight") or format not in ("ms", "min", "h", "iso", "basic"):
            raise InvalidArgumentError("kind is total, base or daylight; format ms, min, h, iso or basic")

        def offset(x):
            return F.unix_micros(F.from_utc_timestamp(x.cast("timestamp"), zone)) - F.unix_micros(x.cast("timestamp"))

        def build(ctx, x):
            ts = stamp(ctx, x)
            january = F.make_timestamp_ntz(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
            july = F.make_timestamp_ntz(F.year(ts), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
            base = F.least(offset(january), offset(july))
            us = offset(ts) if kind == "total" else base if kind == "base" else offset(ts) - base
            ms = F.floor(us / 1000).cast("long")
            if format in ("ms", "min", "h"):
                return ms if format == "ms" else ms / {"min": 60_000, "h": 3_600_000}[format]
            minutes = F.floor(F.abs(ms) / 60_000).cast("int")
            sign = F.when(ms < 0, "-").otherwise("+")
            return F.format_string("%s%02d:%02d" if format == "iso" else "%s%02d%02d", sign, F.floor(minutes / 60).cast("int"), minutes % 60)

        return self.e._map(build)

    def replace(self, *, year=None, month=None, day=None, hour=None, minute=None, second=None, millisecond=None, time_zone: str | None = None):
        """Some parts set anew, read and written in a zone; a date that doesn't exist is null."""
        zone = time_zone or getattr(self.e, "zone", None)
        parts = {"year": year, "month": month, "day": day, "hour": hour, "minute": minute, "second": second, "millisecond": millisecond}

        def build(ctx, x, *given):
            ts = shifted(stamp(ctx, x), zone)
            us = F.unix_micros(ts.cast("timestamp"))
            have = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts), "millisecond": F.pmod(F.floor(us / 1000), F.lit(1000))}
            have |= dict(zip([k for k, v in parts.items() if v is not None], given))
            sec = have["second"].cast("decimal(16,6)") + have["millisecond"].cast("decimal(16,6)") / 1000
            out = F.try_make_timestamp_ntz(*[have[k].cast("int") for k in ("year", "month", "day", "hour", "minute")], sec.cast("decimal(16,6)"))
            return out if zone in (None, "UTC") else F.to_utc_timestamp(out.cast("timestamp"), zone).cast("timestamp_ntz")

        return self.e._map(build, *[v for v in parts.values() if v is not None])

    def strftime(self, format: str, time_zone: str | None = None):
        known = pieces(format)

        def build(x):
            out, pattern = [], ""
            for kind, v in known:
                if kind == "field" and v in "uw":
                    if pattern:
                        out.append(F.date_format(x, pattern))
                        pattern = ""
                    out.append((F.weekday(x) + 1 if v == "u" else F.dayofweek(x) - 1).cast("string"))
                elif kind == "field":
                    pattern += DIRECTIVES[v]
                else:
                    pattern += "''" if v == "'" else f"'{v}'" if v.isalpha() else v
            if pattern:
                out.append(F.date_format(x, pattern))
            return F.concat(*out) if out else F.lit("")

        return self._t(build, time_zone)

    # ---- calendar

    @staticmethod
    def _off(x: Column, weekdays: list[int], holidays: list) -> Column:
        off = (F.dayofweek(x) - 1).isin(list(weekdays)) if weekdays else F.lit(False)
        return off | x.cast("date").isin([day(h) for h in holidays]) if holidays else off

    def is_business_day(self, *, exclude_weekdays: Any = (0, 6), holidays: Any = ()):
        """exclude_weekdays: 0 is Sunday."""
        return self._t(lambda x: ~self._off(x, list(exclude_weekdays), list(holidays)))

    def offset_day(self, n: Any, *, exclude_weekdays: Any = (), holidays: Any = (), roll: str = "raise"):
        """n days later; with excluded weekdays or holidays n business days, after rolling off a day that is none (forward, backward, or an error)."""
        if roll not in ("raise", "forward", "backward"):
            raise InvalidArgumentError("roll is raise, forward or backward")
        weekdays, free = sorted(set(exclude_weekdays)), [day(h) for h in holidays]
        if len(weekdays) >= 7:
            raise InvalidArgumentError("a weekday must be left")

        def build(ctx, x, k):
            t = ctx.type(x)
            ts = stamp(ctx, x)
            k = k.cast("int")
            if not weekdays and not free:
                return F.date_add(x, k) if isinstance(t, T.DateType) else ts + F.make_dt_interval(k)
            date = ts.cast("date")
            # days enough for k business days: whole weeks for the days left, and all holidays
            span = F.ceil(F.abs(k) / (7 - len(weekdays))).cast("int") * 7 + len(free) + 14

            def open_days(start, step):
                days = F.sequence(F.lit(0), span)
                days = F.transform(days, lambda i: F.date_add(start, i * step))
                return F.filter(days, lambda d: ~self._off(d, weekdays, free))

            later, earlier = open_days(date, 1), open_days(date, -1)
            start = F.get(later if roll != "backward" else earlier, 0)
            closed = self._off(date, weekdays, free)
            moved = F.when(k >= 0, F.get(open_days(start, 1), k)).otherwise(F.get(open_days(start, -1), -k))
            if roll == "raise":
                moved = F.when(closed, F.raise_error(F.concat(date.cast("string"), F.lit(" is no business day"))).cast("date")).otherwise(moved)
            if isinstance(t, T.DateType):
                return moved
            clock = F.unix_micros(ts.cast("timestamp")) - F.unix_date(date).cast("long") * (DAY * 1000)
            return LT.from_micros(F.unix_date(moved).cast("long") * (DAY * 1000) + clock)

        return self.e._map(build, n)

    offset_business_day = offset_day

    # ---- durations

    def total_days(self):
        return self._n(lambda x: x / DAY)

    def total_hours(self):
        return self._n(lambda x: x / 3_600_000)

    def total_minutes(self):
        return self._n(lambda x: x / 60_000)

    def total_seconds(self):
        return self._n(lambda x: x / 1000)

    def total_milliseconds(self):
        return self._n(lambda x: x)

    def total_microseconds(self):
        return self._n(lambda x: x * 1000)

    def total_nanoseconds(self):
        return self._n(lambda x: x * 1_000_000)


def day(h: Any) -> datetime.date:
    if isinstance(h, str):
        return datetime.date.fromisoformat(h[:10])
    return h.date() if isinstance(h, datetime.datetime) else h
