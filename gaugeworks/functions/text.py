"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_slug(path: Column) -> Column:
    """A path with its separators turned into dashes."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def iso_day(ts: Column) -> Column:
    """yyyy-mm-dd, in the session's time zone."""
    return F.date_format(ts, "yyyy-MM-dd")


def repository_url(remote: Column) -> Column:
    """The https address of a git remote, without a trailing .git; null if it is neither https nor git@host:path."""
    plain = F.regexp_replace(F.trim(remote), r"\.git$", "")
    ssh = F.regexp_replace(plain, r"^(?:ssh://)?git@([^:/]+)[:/](.+)$", "https://$1/$2")
    return F.when(F.rlike(ssh, F.lit("^https://")), ssh)


def parse_unit(key: Column) -> tuple[Column, Column]:
    """(name, number) of a key ``name:number``; nulls if it isn't one."""
    name, number = F.regexp_extract(key, r"^([A-Za-z]+):(\d{1,9})$", 1), F.regexp_extract(key, r"^([A-Za-z]+):(\d{1,9})$", 2)
    return F.nullif(name, F.lit("")), F.nullif(number, F.lit("")).try_cast("int")


def largest_digits(x: Column, digits: int = 6) -> Column:
    """A number rounded to so many significant digits; 0 stays 0, and what isn't finite is null."""
    size = F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0)))))
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    real = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(real, F.when(x == 0, 0.0).otherwise(F.round(x * power) / power))
