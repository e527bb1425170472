"""The engine's inputs built from the test tables, and hand-written samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-05 00:00:00"

#: (publisher, reliability, headline, excerpt, published_at): articles that exercise the word lists and every branch.
SAMPLES = [
    ("Daily", 0.8, "War ends as ceasefire and peace agreement hold", "Aid and <b>relief</b> reach millions", "2024-01-04 12:00:00"),
    ("Daily", 0.8, "Deadly earthquake strikes city", "Thousands injured, hospitals full", "2024-01-04 23:00:00"),
    ("Courier", 0.6, "DEADLY earthquake strikes city!", "At least 40 dead in the region", "2024-01-04 23:30:00"),
    ("Agency", 0.9, "Deadly: earthquake strikes City", "Rescue under way", "2024-01-03 08:00:00"),
    ("Agency", 0.9, "Vaccine breakthrough approved", "", "2024-01-02 00:00:00"),
    ("Courier", 0.6, "Central bank warns of recession and inflation", "Markets across the world fall", "2023-12-20 06:30:00"),
    ("Daily", 0.8, "Museum opens film and music season", "A quiet week", "2024-01-01 10:15:00"),
    ("Agency", 0.9, "Award for software study", "The <i>jury</i> said nothing", "2024-01-06 10:00:00"),
    ("Courier", 0.6, "Local council meets", "No news", "2024-01-04 09:00:00"),
    ("Daily", 0.8, "Climate protest: major roads blocked nationwide", "Pollution and emissions data released", "2024-01-04 18:45:10"),
    ("Agency", 0.9, "Refugees freed after court ruling", "Justice minister resigns", "2023-12-28 00:00:00"),
    ("Courier", 0.6, "Artificial intelligence in space research", "A discovery<br>of international scale", "2024-01-04 00:00:00"),
    ("Daily", 0.8, "新闻头条", "war", "2024-01-04 01:00:00"),
    ("Courier", 0.6, "Ещё новости", "peace", "2024-01-04 02:00:00"),
    ("Agency", 0.9, "Historic outbreak of disease contained", "Treatment works; recovery of all patients", "2024-01-04 20:00:00"),
    ("Daily", 0.8, "Hostage released in rescue", "Violence and attack claims unproven", "2024-01-04 21:00:00"),
    ("Agency", 0.9, "National election: wins and losses", "Government policy unchanged", "2024-01-03 21:00:00"),
    ("Courier", 0.6, "Storm flood wildfire hurricane eruption", "explosion collapse famine crisis killed", "2024-01-04 22:00:00"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def samples(spark: SparkSession) -> DataFrame:
    rows = [(p, r, f"https://example.com/sample/{i}", h, e, t, -1, i) for i, (p, r, h, e, t) in enumerate(SAMPLES)]
    raw = spark.createDataFrame(rows, "publisher string, reliability double, url string, headline string, excerpt string, at string, source_ord bigint, item_ord bigint")
    return raw.select("publisher", "reliability", F.lit(None).cast("string").alias("bias_note"), "url", "headline", "excerpt", F.col("at").cast("timestamp_ntz").alias("published_at"), "source_ord", "item_ord")


def source_dimension(documents: DataFrame) -> DataFrame:
    """(name, reliability) of the publishers in documents: 0.5 to 0.9 by the number in the name."""
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return documents.select("source").distinct().select(F.col("source").alias("name"), (F.lit(0.5) + (n % 5) / F.lit(10.0)).alias("reliability"))


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: first line as headline, the rest as excerpt, the time of the event with the document's number."""
    docs, events = read(spark, sf_dir, "documents"), read(spark, sf_dir, "events").select("event_id", "ts")
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    cut = F.instr("text", "\n")
    return docs.join(events, F.col("doc_id") == F.col("event_id")).select(
        F.col("source").alias("publisher"), (F.lit(0.5) + (n % 5) / F.lit(10.0)).alias("reliability"), F.lit(None).cast("string").alias("bias_note"),
        F.concat(F.lit("https://example.com/doc/"), F.col("doc_id").cast("string")).alias("url"), F.substring_index("text", "\n", 1).alias("headline"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("excerpt"), F.col("ts").alias("published_at"), n.cast("bigint").alias("source_ord"), F.col("doc_id").alias("item_ord"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_articles(spark, sf_dir).unionByName(samples(spark))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses made from labels, one a labelled document, with every kind of defect among them."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    hundredths = lambda k: F.concat(F.lit("0."), F.lpad(((d * k) % 100).cast("string"), 2, "0"))
    category = F.element_at(F.array(*[F.lit(c) for c in ("health", "economy", "conflict", "culture", "weather")]), (d % 5 + 1).cast("int"))
    sentiment = F.concat(F.when(F.col("toxic") == 1, "-").otherwise(""), hundredths(7))
    severity = F.when(d % 7 == 0, F.concat(F.lit('"'), hundredths(3), F.lit('"'))).when(d % 11 == 0, "3").otherwise(hundredths(3))
    one = F.concat(
        F.lit('{"url":"https://example.com/doc/'), s, F.lit('","category":"'), category, F.lit('","sentiment":'), sentiment, F.lit(',"severity":'), severity, F.lit(',"scale":'), hundredths(13),
        F.lit(',"confidence":'), hundredths(17), F.lit(',"durationHours":'), (d % 9000).cast("string"), F.lit(',"rationale":" label '), F.col("quality").cast("string"), F.lit(' "}'),
    )
    second = F.when(d % 4 == 0, F.concat(F.lit(","), F.regexp_replace(one, '"scale":0', '"scale":1'))).otherwise("")
    body = F.concat(F.lit('{"assessments":[7,'), one, second, F.lit("]}"))
    raw = F.when(d % 13 == 0, F.concat(F.lit("sorry "), body)).when(d % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(d % 17 == 0, "{}").otherwise(body)
    return read(spark, sf_dir, "labels").select(d.alias("response_ord"), raw.alias("raw"))


def impact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as impacts: the type gives the sign, the value the size, two decimals."""
    kind, size = F.col("event_type"), F.least(F.col("value") / F.lit(500.0), F.lit(1.0))
    sign = F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "error", -1.0).otherwise(0.0)
    impact = F.floor(sign * size * F.lit(10.0) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("category"), F.element_at(F.array(*[F.lit(x) for x in ("local", "regional", "global")]), (F.col("user_id") % 3 + 1).cast("int")).alias("scope"), impact.alias("current_impact")
    )
