"""Scalar text expressions over columns (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postflow import schema

# Python's str.strip() removes Unicode white space and the separators
# U+001C..U+001F; Spark's trim removes only spaces.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Python-style strip of leading and trailing white space."""
    return F.regexp_replace(col(c), _EDGE_SPACE, "")


def slug(c: Column | str) -> Column:
    """strip, spaces to dashes, lower case (request URL parts)."""
    return F.lower(F.replace(strip(c), F.lit(" "), F.lit("-")))


def posting_key(source: Column | str, url: Column | str) -> Column:
    """`<source>-` plus the first 10 hex digits of sha1 of the UTF-8 URL."""
    return F.concat(col(source), F.lit("-"), F.substring(F.sha1(F.encode(col(url), "UTF-8")), 1, 10))


def source_of_key(key: Column | str) -> Column:
    """Source name = text before the first '-' of the key."""
    return F.substring_index(col(key), "-", 1)


def first_non_empty(*cols: Column | str) -> Column:
    """`a or b or ""`: the first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def contains_folded(hay: Column | str, needle: Column | str) -> Column:
    """Case-folded substring test."""
    return F.contains(F.lower(col(hay)), F.lower(col(needle)))


def title_matches(title: Column | str, needle: Column | str) -> Column:
    """Title filter: passes when the needle is null or empty."""
    n = col(needle)
    return n.isNull() | (n == "") | contains_folded(title, n)


def fold_remote(location: Column | str, is_remote: Column | str) -> Column:
    """Append ' (Remote)' unless the location already says remote; 'Remote' if empty."""
    loc = col(location)
    flag = F.coalesce(col(is_remote), F.lit(False))
    return F.when(
        flag & ~F.contains(F.lower(loc), F.lit("remote")),
        F.when(loc == "", F.lit("Remote")).otherwise(F.concat(loc, F.lit(" (Remote)"))),
    ).otherwise(loc)


def has_text(c: Column | str) -> Column:
    """Not null and not empty."""
    return F.length(F.coalesce(col(c), F.lit(""))) > 0


def normalise_status(c: Column | str) -> Column:
    """A status outside the known ones shows (and is saved) as the default."""
    s = col(c)
    return F.when(s.isin(*schema.STATUSES), s).otherwise(F.lit(schema.DEFAULT_STATUS))


def link_label(company: Column | str, title: Column | str) -> Column:
    """`company — title` for readable reports."""
    return F.concat(col(company), F.lit(" — "), col(title))


def report_line(label: Column | str, status: Column | str, code: Column | str, error: Column | str) -> Column:
    """One log line: label cut/padded to 40, status padded to 7, code, error."""
    code_txt = F.when(col(code).isNotNull() & (col(code) != 0), F.concat(F.lit("HTTP "), col(code).cast("string"))).otherwise(F.lit("-"))
    err_txt = F.when(has_text(error), F.concat(F.lit("  ("), col(error), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(
        F.rpad(F.substring(col(label), 1, 40), 40, " "),
        F.lit(" "),
        F.rpad(col(status), 7, " "),
        F.lit(" "),
        code_txt,
        err_txt,
    )


def listing_header(title: Column | str, company: Column | str, status: Column | str) -> Column:
    """`title — company  ·  status`."""
    return F.concat(col(title), F.lit(" — "), col(company), F.lit("  ·  "), col(status))


def reason_or_code(error: Column | str, code: Column | str) -> Column:
    """The error text when present, else the HTTP code."""
    return F.coalesce(F.nullif(col(error), F.lit("")), col(code).cast("string"))
