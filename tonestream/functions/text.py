"""Dates of partial precision, tags and specs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of months and days in dates.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Mon Tue Wed Thu Fri Sat Sun".split()
PARTS = ("year", "month", "day", "hour", "minute", "second")
_SHORT = "|".join(m[:3] for m in MONTHS)
_ANY = "|".join(dict.fromkeys([*MONTHS, *(m[:3] for m in MONTHS)]))
_M, _D, _H, _MI = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])", r"([01]?\d|2[0-3])", r"([0-5]\d)"
_S = r"([0-5]\d)(?:[.,]\d+)?"
_ZONE = r" (?:[+-]\d{4}|[A-Z]{3,4}(?:[+-]\d{1,2})?)"
#: Patterns of partial dates with the parts that their groups hold; a group that is not
#: there leaves its part unknown. Days with a weekday state a time, others a zone with it.
DATES = [
    (rf"^(\d{{4}})-{_M}-{_D}T{_H}:{_MI}:{_S}(?:Z|[+-]\d\d:\d\d)?$", PARTS),
    (rf"^(\d{{4}})(?:-{_M}(?:-{_D}(?:T{_H}(?::{_MI})?)?)?)?$", PARTS[:5]),
    (rf"^(\d{{4}})/{_M}(?:/{_D}(?: {_H}(?::{_MI}(?::{_S})?)?)?)?$", PARTS),
    (rf"(?i)^(?:{'|'.join(DAYS)}), {_D} ({_SHORT}) (\d{{4}}) {_H}:{_MI}(?::{_S})?(?-i:{_ZONE})?$", ("day", "month", "year", "hour", "minute", "second")),
    (rf"(?i)^{_D} ({_SHORT}) (\d{{4}}|\d\d)(?: {_H}:{_MI}(?::{_S})?(?-i:{_ZONE}))?$", ("day", "month", "year", "hour", "minute", "second")),
    (rf"(?i)^({_SHORT}) (\d\d)$", ("month", "year")),
    (rf"(?i)^({_ANY}) ([12]?\d|3[01]|0[1-9]), (\d{{4}})$", ("month", "day", "year")),
    (rf"(?i)^({_ANY}) (\d{{4}})$", ("month", "year")),
]


def partial_date(text: Column) -> Column:
    """A struct of the parts that a text states; all null if no pattern fits, or if the
    month has no such day. Two-digit years from 69 on lie in the 20th century."""
    none = F.struct(*[F.lit(None).cast("int").alias(p) for p in PARTS])
    out = none
    for pattern, groups in reversed(DATES):
        part = {p: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i, p in enumerate(groups, 1)}
        number = {p: part[p].try_cast("int") if p in part else F.lit(None).cast("int") for p in PARTS}
        if groups[0] != "year":
            at = F.instr(F.lit("".join(m[:3] for m in MONTHS).lower()), F.lower(F.left(part["month"], F.lit(3))))
            number["month"] = ((at + 2) / 3).cast("int")
            y = number["year"]
            number["year"] = F.when(F.length(part["year"]) == 2, y + F.when(y >= 69, 1900).otherwise(2000)).otherwise(y)
        found = F.struct(*[number[p].alias(p) for p in PARTS])
        out = F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(out)
    most = F.day(F.last_day(F.make_date(F.greatest(out["year"], F.lit(1)), out["month"], F.lit(1))))
    return F.when(out["day"] > most, none).otherwise(out)


def iso_date(d: Column) -> Column:
    """Known precision only: empty without a year."""
    two = lambda p: F.lpad(d[p].cast("string"), 2, "0")
    day = F.concat(F.lpad(d["year"].cast("string"), 4, "0"), F.coalesce(F.concat(F.lit("-"), two("month"), F.coalesce(F.concat(F.lit("-"), two("day")), F.lit(""))), F.lit("")))
    time = F.coalesce(F.concat(F.lit("T"), two("hour"), F.coalesce(F.concat(F.lit(":"), two("minute"), F.coalesce(F.concat(F.lit(":"), two("second")), F.lit(""))), F.lit(""))), F.lit(""))
    return F.when(d["year"].isNull(), F.lit("")).otherwise(F.concat(day, time))


def comments(df: DataFrame, column: str) -> DataFrame:
    """NAME=value strings as name (upper case) and value, cut at the first equals sign."""
    at = F.instr(column, "=")
    return df.filter(at > 1).withColumns({"name": F.upper(F.substring(F.col(column), F.lit(1), at - 1)), "value": F.substring(F.col(column), at + 1, F.length(column))})


def number_of_total(text: Column) -> tuple[Column, Column]:
    """n and total of "n/total"."""
    return F.try_to_number(F.split_part(text, F.lit("/"), F.lit(1)), F.lit("99999")).cast("long"), F.try_to_number(F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit("")), F.lit("99999")).cast("long")


def parse_spec(text: str) -> dict:
    """name[param=v,...]:k=v,... with backslash escapes; repeated and empty keys fail."""
    parts = re.fullmatch(r"([^\[\]:]+)(?:\[((?:\\.|[^\]\\])*)\])?(?::(.*))?", text, re.S)
    if not parts:
        raise ValueError(f"not a spec: {text}")

    def pairs(raw: str | None) -> dict[str, str] | None:
        if raw is None:
            return None
        out: dict[str, str] = {}
        for item in re.findall(r"(?:\\.|[^,\\])+", raw):
            key, eq, value = re.fullmatch(r"((?:\\.|[^=\\])*)(=?)(.*)", item, re.S).groups()
            key, value = (re.sub(r"\\(.)", r"\1", x, flags=re.S) for x in (key, value))
            if not key or not eq:
                raise ValueError(f"empty key in {item!r}")
            if key in out:
                raise ValueError(f"{key} is given twice")
            out[key] = value
        return out

    return {"name": parts[1], "parameters": pairs(parts[2]), "options": pairs(parts[3]) or {}}
