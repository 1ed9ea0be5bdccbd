"""Contacts with the address pattern of a domain learned from published addresses.

The original project's notes leave open how a name is found. The rule here: a name is the
first "First Last" (each word a capital ASCII letter and at least one more letter, ' or -)
after one of CUES and a colon; a domain is the host of the first printed web address,
without "www.", in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow import schema
from postflow.operators.extras import EMAIL_PATTERN

# How a posting announces its contact (fixed values of the rule above).
CUES = ("Contact", "Recruiter", "Hiring manager")

NAME_PATTERN = rf"(?:{'|'.join(CUES)}): ?([A-Z][A-Za-z'-]+) ([A-Z][A-Za-z'-]+)"
DOMAIN_PATTERN = r"(?:https?://(?:www[.])?|www[.])([A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+)"
DEFAULT_PATTERN = "first.last"


def _patterns(first: Column, last: Column) -> dict[str, Column]:
    """Local parts by pattern; where two patterns give one local part, the earlier counts."""
    f, l = F.left(first, F.lit(1)), F.left(last, F.lit(1))
    return {
        "first.last": F.concat(first, F.lit("."), last),
        "firstlast": F.concat(first, last),
        "first_last": F.concat(first, F.lit("_"), last),
        "first-last": F.concat(first, F.lit("-"), last),
        "f.last": F.concat(f, F.lit("."), last),
        "flast": F.concat(f, last),
        "firstl": F.concat(first, l),
        "last.first": F.concat(last, F.lit("."), first),
        "first": first,
        "last": last,
    }


def _plain(name: Column) -> Column:
    """A name as it stands in an address: lower case, without ' and -."""
    return F.lower(F.regexp_replace(name, "['-]", ""))


def printed_facts(postings: DataFrame) -> DataFrame:
    """job_board_id and what its whole description prints: address, name, domain ('' for none)."""
    text = F.coalesce("description", F.lit(""))
    return postings.select(
        "job_board_id", F.regexp_extract(text, EMAIL_PATTERN, 0).alias("email"),
        F.regexp_extract(text, NAME_PATTERN, 1).alias("first"), F.regexp_extract(text, NAME_PATTERN, 2).alias("last"),
        F.lower(F.regexp_extract(text, DOMAIN_PATTERN, 1)).alias("domain"))


def learned_patterns(facts: DataFrame) -> DataFrame:
    """(domain, pattern, votes): the pattern most distinct published addresses of a domain
    follow, the earlier one of `_patterns` on a tie. An address votes where its posting
    names a person whose name gives it."""
    at = F.lower("email")
    local, domain = F.substring_index(at, "@", 1), F.substring_index(at, "@", -1)
    fits = _patterns(_plain(F.col("first")), _plain(F.col("last")))
    which = F.coalesce(*[F.when(local == made, F.lit(i)) for i, made in enumerate(fits.values())])
    # a generator, as a filter on what is made here would be pushed below and repeat it all for each reference
    vote = F.struct(domain.alias("domain"), at.alias("_address"), which.alias("_i"))
    cast = facts.select(F.explode_outer(F.array(F.when((F.col("email") != "") & (F.col("first") != "") & which.isNotNull(), vote))).alias("_v"))
    votes = cast.filter("_v IS NOT NULL").select("_v.*").distinct().groupBy("domain", "_i").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("domain").agg(F.max(F.struct("votes", (-F.col("_i")).alias("_i"))).alias("_b"))
    names = F.array(*[F.lit(n) for n in fits])
    return best.select("domain", F.get(names, -F.col("_b._i")).alias("pattern"), F.col("_b.votes").alias("votes"))


def guess_contacts(postings: DataFrame, default_pattern: str | None = DEFAULT_PATTERN) -> DataFrame:
    """Contact of each posting not looked up yet (contact_confidence IS NULL).

    A printed address -> `published`; else a printed name and domain -> `pattern-guess`,
    by the domain's learned pattern or `default_pattern` (None: no guess without one);
    else `none`, set too, so that the row leaves the queue. Patterns are learned from
    every posting, looked up or not. `contact_name` is a printed name. One row comes out
    for each row that goes in; null descriptions print nothing."""
    todo = printed_facts(postings.filter(F.col("contact_confidence").isNull()))
    # no printed domain: a key of its own, so that such rows do not meet in one partition
    todo = todo.withColumn("_at", F.when((F.col("domain") != "") & (F.col("first") != "") & (F.col("email") == ""), F.col("domain"))
                           .otherwise(F.concat(F.lit("@"), F.xxhash64("job_board_id").cast("string"))))
    learned = learned_patterns(printed_facts(postings)).select(F.col("domain").alias("_at"), "pattern")
    made = _patterns(_plain(F.col("first")), _plain(F.col("last")))
    if default_pattern is not None and default_pattern not in made:
        raise ValueError(f"unknown pattern: {default_pattern}")
    pattern = F.coalesce("pattern", F.lit(default_pattern))
    local = F.coalesce(*[F.when(pattern == name, value) for name, value in made.items()])
    guess = F.when(~F.startswith("_at", F.lit("@")), F.concat(local, F.lit("@"), F.col("domain")))
    published = F.nullif("email", F.lit(""))
    return todo.join(learned, "_at", "left").select(
        "job_board_id",
        F.when(F.col("first") != "", F.concat("first", F.lit(" "), "last")).alias("contact_name"),
        F.coalesce(published, guess).alias("contact_email"),
        F.when(published.isNotNull(), schema.CONTACT_PUBLISHED).when(guess.isNotNull(), schema.CONTACT_PATTERN_GUESS)
         .otherwise(schema.CONTACT_NONE).alias("contact_confidence"))
