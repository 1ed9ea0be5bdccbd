"""Prompt building as one-pass `concat` of template pieces and columns.

Chained `replace` calls would re-expand a hole that occurs inside a filled-in
value (a description holding `{resume_summary}`); splitting the template once
and concatenating fills every hole exactly once, like `str.format`.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.text import col


def template_pieces(template: str) -> list[tuple[str, str | None]]:
    """[(literal, hole-or-None), ...] of a format template."""
    return [(lit, name) for lit, name, _spec, _conv in string.Formatter().parse(template)]


def fill(template: str, values: Mapping[str, Column | str]) -> Column:
    """Fill every `{hole}` of the template from the mapped column, in one pass."""
    parts: list[Column] = []
    for literal, hole in template_pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if hole is not None:
            if hole not in values:
                raise KeyError(f"template hole {hole!r} has no value")
            parts.append(F.coalesce(col(values[hole]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def prompt_values(resume_summary: Column | str) -> dict[str, Column | str]:
    return {
        "title": "title",
        "company": "company",
        "description": "description",
        "resume_summary": resume_summary,
    }


def cover_letter_prompt(resume_summary: Column | str, template: str = schema.COVER_LETTER_TEMPLATE) -> Column:
    return fill(template, prompt_values(resume_summary))


def cold_email_prompt(resume_summary: Column | str, template: str = schema.COLD_EMAIL_TEMPLATE) -> Column:
    return fill(template, prompt_values(resume_summary))
