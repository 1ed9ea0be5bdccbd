"""Link-liveness expressions: effective response, verdict, status (no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import col


def effective_code(head_code: Column | str, get_code: Column | str) -> Column:
    """HEAD is repeated as GET when it answers 200/403/404/405/410."""
    return F.when(col(head_code).isin(*schema.GET_AFTER_HEAD), col(get_code)).otherwise(col(head_code))


def effective_body(head_code: Column | str, body: Column | str) -> Column:
    """Lower-cased body of the final response; HEAD answers carry none."""
    return F.lower(F.when(col(head_code).isin(*schema.GET_AFTER_HEAD), F.coalesce(col(body), F.lit(""))).otherwise(F.lit("")))


def closed_phrase(body_lower: Column | str, phrases: Sequence[str] = schema.CLOSED_PHRASES) -> Column:
    """First phrase of the list found in the (lower-cased) body, else null."""
    b = col(body_lower)
    return F.coalesce(*[F.when(F.contains(b, F.lit(p)), F.lit(p)) for p in phrases], F.lit(None).cast("string"))


def classify(code: Column | str, phrase: Column | str, can_apply: Column | str, exc: Column | str) -> Column:
    """(status_code, live, error) of one fetched URL, as a struct, from its code, the
    closed phrase found in the body (or null) and whether the apply text is there."""
    c, phrase, can_apply, e = col(code), col(phrase), col(can_apply), col(exc)
    null_i = F.lit(None).cast("int")
    null_s = F.lit(None).cast("string")

    def out(code_: Column, live: bool, error: Column) -> Column:
        return F.struct(code_.alias("status_code"), F.lit(live).alias("live"), error.alias("error"))

    gone = c.isin(*schema.DEAD_CODES)
    return (
        F.when(e.isNotNull(), out(null_i, False, e))
        .when(gone & can_apply, out(c, True, F.lit(schema.LIVE_DESPITE_404)))
        .when(gone, out(c, False, null_s))
        .when(c.isNull() | (c != 200), out(c, False, F.concat(F.lit("HTTP "), F.coalesce(c.cast("string"), F.lit("None")))))
        .when(phrase.isNotNull(), out(c, False, F.concat(F.lit("closed: '"), phrase, F.lit("'"))))
        .otherwise(out(c, True, null_s))
    )


def link_status(status_code: Column | str, live: Column | str, error: Column | str) -> Column:
    """live / dead / unknown."""
    code, ok, err = col(status_code), col(live), col(error)
    return (
        F.when(ok, F.lit("live"))
        .when(code.isin(*schema.DEAD_CODES) | F.coalesce(F.startswith(err, F.lit("closed:")), F.lit(False)), F.lit("dead"))
        .otherwise(F.lit("unknown"))
    )
