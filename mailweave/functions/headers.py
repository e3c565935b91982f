"""Mail header values: addresses, subjects, ids and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions.text import BLANK, collapse, let, strip

UNKNOWN_SENDER = "unknown@local"


def _nullif_empty(value: Column) -> Column:
    return F.when(value != "", value)


def address(header: Column) -> Column:
    """Lower-case address of one header value: the bracketed part where there is one, else the whole value."""
    def bare(value: Column) -> Column:
        bracketed = F.regexp_extract(value, r"<\s*([^<>]*?)\s*>", 1)
        return F.lower(F.when(bracketed != "", bracketed).otherwise(value))

    return let(strip(F.coalesce(header, F.lit(""))), bare)


def address_list(header: Column) -> Column:
    """Distinct addresses of a header value in order of first appearance, parted at ``,`` and ``;``."""
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), "[,;]"), address)
    return F.array_distinct(F.filter(parts, lambda a: a != ""))


def normalized_subject(subject: Column) -> Column:
    """Subject without leading reply and forward marks; letter case is kept."""
    marks = rf"(?i)\A{BLANK}*(?:(?:re|fwd|fw):{BLANK}*)*"
    return collapse(F.regexp_replace(F.coalesce(subject, F.lit("")), marks, ""))


def message_id(value: Column) -> Column:
    """Id without blanks and angle brackets; empty becomes null."""
    bare = F.regexp_replace(strip(value), r"\A[<>]+|(?<![<>])[<>]+\z", "")
    return _nullif_empty(strip(bare))


def reference_ids(header: Column) -> Column:
    """Ids of a References header, oldest first."""
    parts = F.split(strip(F.coalesce(header, F.lit(""))), f"{BLANK}+")
    bare = F.transform(parts, lambda r: F.regexp_replace(r, r"\A[<>]+|(?<![<>])[<>]+\z", ""))
    return F.filter(bare, lambda r: r != "")


# The zone names of old mail headers; any other name counts as UTC.
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def rfc2822_time(value: Column) -> Column:
    """Header date as a UTC timestamp; null where it cannot be read.

    Comments are dropped, a date without a zone is in UTC, and two-digit years up to 68 lie after 2000.
    """
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])

    def read(text: Column) -> Column:
        return F.coalesce(
            F.try_to_timestamp(text, F.lit("d MMM yyyy H:mm:ss Z")),
            F.try_to_timestamp(text, F.lit("d MMM yyyy H:mm Z")),
        )

    def with_century(text: Column) -> Column:
        year = F.regexp_extract(text, r"\A\d{1,2} [A-Za-z]+ (\d\d) ", 1)
        century = F.when(year > "68", "19").otherwise("20")
        return F.when(year != "", F.regexp_replace(text, r"\A(\d{1,2} [A-Za-z]+) (\d\d) ", F.concat(F.lit("$1 "), century, F.lit("$2 "))))\
            .otherwise(text)

    def with_zone(text: Column) -> Column:
        name = F.regexp_extract(text, r" ([A-Za-z]+)\z", 1)
        bare = F.regexp_replace(text, r" [A-Za-z]+\z", "")
        return F.when(F.rlike(text, F.lit(r" [+-]\d{4}\z")), text).otherwise(
            F.concat(bare, F.lit(" "), F.coalesce(F.try_element_at(zones, F.upper(name)), F.lit("+0000"))))

    text = F.regexp_replace(strip(value), r"\A[A-Za-z]+,\s*", "")
    text = F.regexp_replace(text, r"\([^()]*\)", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return let(text, lambda t: let(with_century(t), lambda u: read(with_zone(u))))


def utc_wall_time(moment: Column) -> Column:
    """A timestamp as zone-less UTC wall time, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
