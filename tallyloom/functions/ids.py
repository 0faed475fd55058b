"""Numbers of record ids that come as gid, as plain number or as base64 of the gid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base64 of "gid://"; three bytes make four characters, so the first eight characters are the same for every gid.
GID_BASE64 = "Z2lkOi8v"


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def id_text(c: Column) -> Column:
    """The id with its encoding taken off."""
    t = F.trim(c.cast("string"))
    return F.when(t.startswith(GID_BASE64), F.try_to_binary(t, F.lit("base64")).cast("string")).otherwise(t)


def id_number(c: Column) -> Column:
    """The digits at the end of the id as a long; null if there are none or they don't fit."""
    return F.regexp_extract(id_text(c), r"([0-9]+)\s*$", 1).try_cast("long")


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")
