"""Dates in running text, and the date formats of two forum sites.

A date candidate is a run of three or more neighbouring date tokens (clock times, numbers, ordinals,
day and month names, delimiters, filler words). It is strict if it names a day, a month and a year:
three numbers with two delimiters, or one month name with two numbers, one number having two digits.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from dateutil import parser as dateutil_parser
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moment that fills what a date leaves out; fixed, so that results repeat.
BASE_DATE = dt.datetime(2000, 1, 1)
YEARS = (1970, 2100)

# Token kinds in the order in which they are tried. Names and filler words of dates.
_MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sept sep oct nov dec".split()
_DAYS = "monday tuesday wednesday thursday friday saturday sunday thurs tues thur mon tue wed thu fri sat sun".split()
_ORDINALS = r"\d+(?:st|nd|rd|th)|" + "|".join("first second third fourth fifth sixth seventh eighth ninth tenth next last".split())
_FILLERS = "standard daylight savings until time date due by on of to at t z".split()
_REGIONS = {"pacific": "US/Pacific", "eastern": "US/Eastern", "mountain": "US/Mountain", "central": "US/Central"}


def _zone_names() -> dict[str, dt.tzinfo]:
    """Letters that zones of the public time zone database go by in winter or summer, and the regional names; the first zone in order that uses a name gives its offset."""
    found: dict[str, dt.tzinfo] = {}
    for name in ("UTC", *sorted(n for n in zoneinfo.available_timezones() if n.startswith(("US/", "Europe/"))), *sorted(zoneinfo.available_timezones())):
        zone = zoneinfo.ZoneInfo(name)
        for month in (1, 7):
            moment = dt.datetime(2015, month, 1, tzinfo=zone)
            letters = moment.tzname() or ""
            if letters.isalpha() and letters.isupper() and 2 <= len(letters) <= 5:
                found.setdefault(letters.lower(), dt.timezone(moment.utcoffset()))
    return found | {k: zoneinfo.ZoneInfo(v) for k, v in _REGIONS.items()}


_ZONES = _zone_names()
_ZONE = "(?:(?:" + "|".join(sorted(_ZONES, key=lambda z: (-len(z), z))) + ")(?![a-z]))"
_PERIOD = r"(?:a\.m\.|p\.m\.|am|pm)"
_KINDS = {
    "time": rf"\d{{1,2}}:\d{{1,2}}(?::\d{{1,2}})?\s*{_PERIOD}?\s*{_ZONE}?|\d{{1,2}}\s*{_PERIOD}",
    "ordinal": _ORDINALS,
    "digits": r"\d+",
    "day": "|".join(_DAYS),
    "month": "|".join(_MONTHS),
    "delimiter": r"[/:\-,\s_+@]+",
    "filler": "|".join(_FILLERS),
}
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()), re.IGNORECASE)
#: A run of three or more tokens, each matched once and for all.
_RUN = re.compile("(?>" + "|".join(_KINDS.values()) + "){3,}", re.IGNORECASE)
_DIGIT = re.compile(r"\d")
#: A zone right after a clock time or a period, as _KINDS takes it.
_TIME_ZONE = re.compile(rf"(?<=[\d.m ])\s*({_ZONE})(?![a-z])", re.IGNORECASE)
_NOISE = re.compile(r"\b(?:standard|daylight|savings|time|date|by|due|on|to)\b", re.IGNORECASE)
_ENDS = " \n\t:-.,_"


@dataclass
class Candidate:
    """A run of date tokens and how many of each kind it has."""

    text: str
    start: int
    end: int
    digits: list[str]
    months: int
    delimiters: int

    def strict(self) -> bool:
        if not any(len(d) > 1 for d in self.digits):
            return False
        if len(self.digits) == 3:
            return self.delimiters >= 2
        return self.months == 1 and len(self.digits) == 2


def candidates(text: str) -> Iterator[Candidate]:
    """Runs of three or more date tokens that hold a digit; others name no full date."""
    if not _DIGIT.search(text):
        return
    for run in _RUN.finditer(text):
        if _DIGIT.search(run.group()):
            tokens = list(_TOKEN.finditer(run.group()))
            kinds = [m.lastgroup for m in tokens]
            yield Candidate(run.group(), run.start(), run.end(), [m.group() for m in tokens if m.lastgroup == "digits"], kinds.count("month"), kinds.count("delimiter"))


def contains_strict_date(text: str) -> bool:
    return any(c.strict() and len(c.text) >= 6 for c in candidates(text))


def parse_date(text: str, base: dt.datetime = BASE_DATE) -> dt.datetime | None:
    """A candidate as a moment (UTC where it names no zone), or None. Of several zones the last by name counts."""
    plain = _NOISE.sub(" ", text)
    zones = sorted(m.lower() for m in _TIME_ZONE.findall(plain))
    plain = (_TIME_ZONE.sub(" ", plain) if zones else plain).strip(_ENDS)
    if len(plain) < 3:
        return None
    try:
        found = dateutil_parser.parse(plain, default=base, ignoretz=False)
    except (ValueError, OverflowError, TypeError):
        return None
    if zones and not found.tzinfo:
        found = found.replace(tzinfo=_ZONES[zones[-1]])
    try:
        return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found
    except OverflowError:
        return None


def find_dates(text: str, strict: bool = True, base: dt.datetime = BASE_DATE) -> list[tuple[dt.datetime, str, int, int]]:
    """(moment, source, start, end) of the dates in a text with a digit and a year in YEARS, in order."""
    out = []
    for c in candidates(text or ""):
        if strict and not c.strict() or not any(x.isdigit() for x in c.text):
            continue
        moment = parse_date(re.sub(r"[\s\xa0]+", " ", c.text).strip(_ENDS), base)
        if moment and YEARS[0] <= moment.year <= YEARS[1]:
            out.append((moment, c.text.strip(_ENDS), c.start, c.end))
    return out


DATE_LIST = "array<struct<ts:timestamp_ntz,src:string,start:int,end:int>>"


def date_list(text: Column, strict: bool = True) -> Column:
    """find_dates() of a text column."""

    @F.pandas_udf(DATE_LIST)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"ts": m, "src": s, "start": a, "end": b} for m, s, a, b in find_dates(t or "", strict)])

    return found(text)


def superuser_date(text: Column) -> Column:
    """Dates like "Feb 19 '13 at 09:10", or the same without a year (then 1970). Years from 69 belong to the last century."""
    found = F.try_to_timestamp(text, F.lit("MMM d ''yy 'at' HH:mm"))
    found = F.when(F.year(found) > 2068, found - F.make_ym_interval(F.lit(100))).otherwise(found)
    return F.coalesce(found, F.try_to_timestamp(text, F.lit("MMM d 'at' HH:mm")))


def macrumors_date(text: Column) -> Column:
    """Dates like "Feb 09, 2013 at 09:10 PM", or without a clock time; leading zeros don't matter."""
    plain = F.regexp_replace(F.regexp_replace(text, "^0", ""), "(?<= )0", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("MMM d, yyyy 'at' h:mm a")), F.try_to_timestamp(plain, F.lit("MMM d, yyyy")))
