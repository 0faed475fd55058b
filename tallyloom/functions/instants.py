"""Instants from texts in many notations, in JVM expressions without Python.

Every notation is brought to the same nine parts (year, month, day, hour, minute, second, fraction, AM/PM, zone) by one
regular expression each; the parts then make the instant.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ZONE = r"(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z][A-Za-z_]*(?:/[A-Za-z0-9_+\-]+)*)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Notation -> the nine parts.
NOTATIONS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}\s*{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp][Mm])?\s*{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp][Mm])?\s*{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*[ -](\d{{4}})\s+{_CLOCK}\s*{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?\s*" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
)
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)$"
_WALL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?$"
_NUMBER = r"^[+-]?\d{1,16}(?:\.\d{1,9})?$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Abbreviations name a fixed distance from UTC, so they also tell apart the two passes of a repeated hour.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00",
    "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "IST": "+05:30", "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00",
    "AEDT": "+11:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00",
    "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
}


@cache
def zone_names() -> tuple[str, ...]:
    """The region names that the JVM's time zone data has."""
    jvm = SparkSession.active().sparkContext._jvm
    names = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")
    return tuple(sorted(n for n in names if "/" in n))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a lambda variable can't be copied by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def instant(raw: Column, zone: Column) -> Column:
    """The instant that ``raw`` names, or null; ``zone`` is the region of wall times without a zone of their own.

    A wall time that occurs twice is the earlier one, a skipped one moves forward by the gap. A bare number counts
    seconds below 10^11, else milliseconds. With slashes the month comes first, with dots the day. Dates, hours and
    zones that do not exist give null, as do null, blank and any other text.
    """

    def canonical(t: Column) -> Column:
        at = F.lit(None).cast("string")
        for pattern, order in reversed(NOTATIONS):
            at = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order)).otherwise(at)
        return F.split(at, r"\|", -1)

    def zone_of(named: Column) -> Column:
        offset = F.regexp_replace(named, r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
        return (
            F.when(named == "", F.when(zone.isin(*zone_names()) | (zone == "UTC"), zone))
            .when(named.rlike(r"^[+-](?:0\d|1[0-7])(?::?[0-5]\d)?$"), F.when(F.length(offset) == 4, F.concat(offset, F.lit("00"))).otherwise(offset))
            .when(named.rlike(r"^[+-]"), F.lit(None))
            .when(named.isin(*zone_names()), named)
            .otherwise(_literal_map(ABBREVIATIONS)[F.upper(named)])
        )

    def wall(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        number = lambda i: F.when(part(i) == "", F.lit(0)).otherwise(part(i).try_cast("int"))
        month = F.coalesce(part(1).try_cast("int"), _literal_map({m: i + 1 for i, m in enumerate(_MONTHS)})[F.lower(part(1))])
        half = F.upper(part(7))
        hour = F.when(half == "", F.when(number(3) < 24, number(3))).when(number(3).between(1, 12), (number(3) % 12) + F.when(half == "PM", 12).otherwise(0))
        second = F.when(number(5) < 60, F.concat_ws(".", number(5).cast("string"), F.rpad(part(6), 6, "0")).try_cast("decimal(16,6)"))
        return F.try_make_timestamp(years=part(0).try_cast("int"), months=month, days=part(2).try_cast("int"), hours=hour, mins=F.when(number(4) < 60, number(4)), secs=second, timezone=zone_of(part(8)))

    def epoch(t: Column) -> Column:
        count = t.try_cast("decimal(26,9)")
        return F.timestamp_micros(F.when(F.abs(count) < 10**11, count * 10**6).otherwise(count * 1000).cast("long"))

    t = F.trim(raw)
    rest = _let(t, lambda t: F.when(t.rlike(_NUMBER), epoch(t)).otherwise(_let(canonical(t), wall)))
    # the usual notations in generated code; the lambdas of the rest are interpreted
    return (
        F.when(t.rlike(_ZONED), t.try_cast("timestamp"))
        .when(t.rlike(_WALL) & zone.isin(*zone_names()), F.to_utc_timestamp(F.concat(t, F.lit("Z")).try_cast("timestamp"), zone))
        .otherwise(rest)
    )
