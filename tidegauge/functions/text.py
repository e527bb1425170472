"""Text column functions: keys, cleaning, word lists, hashes. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

#: White space as browsers see it: Java's \s is ASCII only; all of Z are spaces, line and paragraph separators.
WHITE = r"[\s\p{Z}\x{feff}]+"


def headline_key(headline: Column) -> Column:
    """Lower-case runs of Latin letters and digits; all headlines without any share the key ''."""
    return F.trim(F.regexp_replace(F.lower(headline), "[^a-z0-9]+", " "))


def strip_html(text: Column) -> Column:
    """Tags become spaces, white space collapses; entities stay as they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), WHITE, " "))


def scoring_text(headline: Column, excerpt: Column) -> Column:
    return F.lower(F.concat(headline, F.lit(" "), strip_html(excerpt)))


def _contains(column: str, term: str) -> str:
    quoted = term.replace("\\", "\\\\").replace("'", "\\'")
    return f"contains(`{column}`, '{quoted}')"


def _has_any(column: str, terms: Sequence[str]) -> str:
    return " or ".join(_contains(column, t) for t in terms) or "false"


def count_terms(column: str, terms: Sequence[str]) -> Column:
    """How many of the terms occur anywhere in the text of a column, each once.

    A list goes to Catalyst as one SQL text: a call for each term would take longer than the query."""
    return F.expr(" + ".join(f"cast({_contains(column, t)} as int)" for t in terms) or "0")


def first_category(column: str) -> Column:
    """The first category with a term in the text of a column."""
    cases = " ".join(f"when {_has_any(column, terms)} then '{name}'" for name, terms in config.CATEGORY_TERMS.items())
    return F.expr(f"case {cases} else '{config.DEFAULT_CATEGORY}' end")


def has_word(text: Column, words: str) -> Column:
    """Whether one of the words, separated by |, is anywhere in the text; plain searches take less time than a pattern of alternatives."""
    return reduce(or_, [text.contains(w) for w in words.split("|")])


def severity_bonus(text: Column) -> Column:
    return F.when(has_word(text, config.STRONG_WORDS), 0.2).otherwise(0.0)


def keyword_scale(text: Column) -> Column:
    return F.when(has_word(text, config.GLOBAL_WORDS), 0.8).when(has_word(text, config.REGIONAL_WORDS), 0.55).otherwise(0.35)


def keyword_duration(category: Column, text: Column) -> Column:
    lasting = F.when(has_word(text, config.LASTING_WORDS), config.DURATION_LASTING)
    return lasting.when(category.isin(*config.LONG_CATEGORIES), config.DURATION_LONG).otherwise(config.DURATION_SHORT)


def keyword_rationale(sentiment: Column, category: Column, negative: Column, positive: Column) -> Column:
    hits = F.when(sentiment > 0, positive).otherwise(negative)
    direction = F.when(sentiment > 0, "positive").otherwise("negative")
    found = F.concat(F.lit("Keywords show "), hits.cast("string"), F.lit(" "), direction, F.lit(" "), category, F.when(hits == 1, " signal").otherwise(" signals"), F.lit(" in headline and excerpt."))
    return F.when(sentiment == 0, "Headline and excerpt show no direction.").otherwise(found)


def summary_or_default(excerpt: Column) -> Column:
    return F.when(excerpt != "", excerpt).otherwise(config.NO_SUMMARY)


def rolling_hash(text: Column) -> Column:
    """Signed 32-bit hash h = 31 h + unit over UTF-16 code units, as bigint."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(units) / 4).cast("int")
    step = lambda h, i: F.pmod(h * 31 + F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), step)
    return F.when(n > 0, folded).when(text.isNotNull(), F.lit(0).cast("bigint"))


def event_id(url: Column) -> Column:
    return F.concat(F.lit("rss_"), F.lower(F.conv(F.abs(rolling_hash(url)).cast("string"), 10, 36)))


def strip_code_fence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def named_uuid(name: Column) -> Column:
    """The UUID of a name: MD5 in the form of version 3 (without name space), the same in every attempt of a task."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def random_uuid() -> Column:
    """A random UUID for each row, another one whenever the row is computed: write it out before it is used twice."""
    return F.uuid()


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
