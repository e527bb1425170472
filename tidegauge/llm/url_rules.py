"""URL filtering by association rules.

A URL becomes a set of tokens: scheme, top-level domain, registered domain, the labels before
it, the words of hyphenated labels, path segments (digits as #), file ending, query keys,
fragment. Tokens that stand in the same labelled URLs, all of them, say the same, so only the
first of such is mined: FP-growth lists every subset of what occurs together. FP-growth over
the labelled URLs, each with the item BAD or GOOD, gives the frequent combinations, of any
length; a combination X with
support(X + BAD) / support(X) >= MIN_CONFIDENCE and at least MIN_LIFT times the base rate is
a rule, unless one of its own parts is a rule of no less confidence. Rules are matched by an
inverted index: each stands under its rarest token only, so a URL meets just the rules whose
rarest token it has, and the other tokens are then compared.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Share of the labelled URLs, and least number, that a rule's combination must occur in.
MIN_SUPPORT, MIN_COUNT = 0.002, 5
#: From here on a rejected URL is likelier bad than good, as far as the labels tell.
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.25
BAD, GOOD = "=bad", "=good"

_URL = r"^\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a url, all of it however long; a null or empty one has none."""
    low = F.lower(F.coalesce(url, F.lit("")))
    part = lambda k: F.regexp_extract(low, _URL, k)
    named = lambda name, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(name + "="), v))
    labels = F.split(part(2), r"\.")
    several = F.size(labels) > 1
    none = F.array().cast("array<string>")
    before = F.when(several, F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))).otherwise(labels)
    words = F.flatten(F.transform(F.filter(labels, lambda v: v.rlike("[-_]")), lambda v: F.split(v, "[-_]")))
    domain = F.when(several, F.array(F.array_join(F.slice(labels, -2, 2), "."))).otherwise(none)
    top = F.when(several, F.slice(labels, -1, 1)).otherwise(none)
    segments = F.split(F.regexp_replace(part(3), r"\d+", "#"), "/")
    ending = F.array(F.regexp_extract(part(3), r"\.([a-z0-9]{1,5})$", 1))
    keys = F.transform(F.split(part(4), "[&;]"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))
    everything = F.concat(
        named("scheme", F.array(part(1))), named("label", before), named("word", words), named("domain", domain), named("top", top),
        named("path", segments), named("ending", ending), named("query", keys), named("fragment", F.array(F.regexp_replace(part(5), r"\d+", "#"))),
    )
    return F.sort_array(F.array_distinct(everything))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of each page with a label: bad if any of its labels says quality 0 or toxic 1; labels that say nothing don't count.

    A page's label is the one whose doc_id is its page_id; the tables state no other link."""
    verdict = (F.col("quality") == 0) | (F.col("toxic") == 1)
    verdict = F.when(verdict, True).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), False)
    by_id = labels.select(F.col("doc_id").cast("bigint").alias("labelled_id"), verdict.alias("bad")).groupBy("labelled_id").agg(F.bool_or("bad").alias("bad")).filter("bad is not null")
    return pages.select(F.col("page_id").cast("bigint").alias("id"), F.col("url").cast("string").alias("url")).join(by_id, F.col("id") == F.col("labelled_id")).select("url", "bad")


def _beaten(rules: DataFrame) -> DataFrame:
    """tokens of the rules(tokens, confidence) of which a smaller part is a rule of no less confidence.

    A part stands under its first token, so a rule meets the parts that begin with one of its
    tokens, not its 2^n subsets."""
    part = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.col("tokens")[0].alias("token"))
    whole = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("token"))
    within = (F.size("part") < F.size("tokens")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0)
    return whole.join(part, "token").filter(within).select("tokens").distinct()


def telling_tokens(rows: DataFrame, least: float) -> list[str]:
    """The tokens of rows(row, have) that at least `least` rows hold, one for each set of rows (the first in order).

    A row has few tokens and `least` is a share of the rows, so the list doesn't grow with them."""
    where = [F.bit_xor(F.xxhash64("row", F.lit(k))) for k in (1, 2)]
    sets = rows.select("row", F.explode("have").alias("token")).groupBy("token").agg(F.count("*").alias("n"), where[0].alias("x"), where[1].alias("y")).filter(F.col("n") >= least)
    return sorted(r.token for r in sets.groupBy("n", "x", "y").agg(F.min("token").alias("token")).collect())


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT, max_tokens: int | None = None
) -> DataFrame:
    """(tokens, rarest, support, confidence) of the rules of labelled(url, bad). Repeated rows count each; an empty table,
    or one without a bad url, has no rules; a null url has no tokens but counts as a row."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, rarest string, support bigint, confidence double")
    rows = materialize(labelled.select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("url")).alias("have"), "bad"))
    n, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return empty
    share = max(min_support, (min_count - 0.5) / n)
    if share > 1:
        return empty
    telling = F.array(*map(F.lit, telling_tokens(rows, share * n))).cast("array<string>")
    baskets = rows.select(F.array_append(F.array_intersect("have", telling), F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=share, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets).freqItemsets
    if max_tokens is not None:
        sets = sets.filter(F.size("items") <= max_tokens + 1)
    sets = sets.select(F.sort_array("items").alias("items"), F.col("freq").cast("bigint").alias("freq"))
    sets = materialize(sets)
    with_bad = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("support"))
    parts = sets.filter(~F.array_contains("items", BAD) & ~F.array_contains("items", GOOD))
    rules = with_bad.join(parts.withColumnRenamed("items", "tokens"), "tokens").withColumn("confidence", F.col("support") / F.col("freq"))
    rules = rules.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * bad / n)).select("tokens", "support", "confidence")
    rules = materialize(rules)
    rules = rules.join(_beaten(rules), "tokens", "left_anti")
    single = parts.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return rules.join(rarest, "tokens").select("tokens", "rarest", "support", "confidence")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, n_rules, confidence, rule, rejected of every row of pages(page_id, url).

    confidence and rule are those of the most confident rule that matches (ties: more
    support, then the tokens in order), null where none does; such a page isn't rejected. A
    null or empty url matches nothing; a long one is matched whole. Repeated rows are rows of
    their own. Other columns are not read; an empty table gives none.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    distinct = rows.filter("url is not null").select("url").distinct().select("url", url_tokens(F.col("url")).alias("have"))
    met = distinct.select("url", "have", F.explode("have").alias("rarest")).join(rules, "rarest").filter(F.size(F.array_except("tokens", "have")) == 0)
    best = met.groupBy(F.col("url").alias("of_url")).agg(
        F.count("*").alias("n_rules"),
        F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.array_join("tokens", " ").alias("rule"))).alias("best"),
    )
    out = rows.join(best, F.col("url") == F.col("of_url"), "left")
    return out.select(
        "page_id", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.round(-F.col("best.c"), 6).alias("confidence"), F.col("best.rule").alias("rule"), F.col("best").isNotNull().alias("rejected")
    )


def url_filter(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """match_rules of all pages under the rules mined from those with a label. Repeated labelled
    rows count each; without labels, or without bad ones, there are no rules and nothing is rejected."""
    return match_rules(pages, materialize(mine_rules(labelled_urls(pages, labels), **options)))
