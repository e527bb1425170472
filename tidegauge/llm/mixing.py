"""Mixing sources to target weights that change over the course of training.

Each source s has a schedule of weights w_s(t), linear between the KNOTS of t in [0, 1].
Normalised over the sources they give its share q_s(t) of the tokens drawn at t. With a
budget of B tokens the demand of s up to t is D_s(t) = B * integral of q_s over [0, t]. The
documents of s stand in a fixed hash order; one whose tokens start at c in that order is
wanted when D_s(t) = c, so t = D_s^-1(c), and once more at c + supply, c + 2 supply ... in
further passes for as long as the demand lasts. Rows are range-sorted by t * B.

The default schedule tempers the sources' own sizes, p_s^TEMPERATURE(t): it starts near the
natural proportions and ends with small sources raised. The default budget is the least one
under which every source is passed once in full, so no document is lost and small sources
repeat; a smaller budget leaves out what lies beyond the demand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits_broadcast, materialize

KNOTS = (0.0, 0.5, 1.0)
TEMPERATURES = (1.0, 0.9, 0.8)
#: Hash buckets of each source for the distributed running sum.
BUCKETS = 1024


def token_count(text: Column) -> Column:
    """Tokens between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def order_key(doc_id: Column) -> Column:
    """60 bits of md5 of the id: the fixed hash order of documents (a null id stands for the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_demand(
    rows: DataFrame,
    schedule: Mapping[str | None, Sequence[float]] | None = None,
    knots: Sequence[float] = KNOTS,
    temperatures: Sequence[float] = TEMPERATURES,
    budget: int | None = None,
) -> DataFrame:
    """One row for each source of rows(source, tokens): supply, demand, budget, the shares q0.. and integrals i0.. at the knots,
    and listed, whether the schedule gives the source any weight. Sources without tokens have no share."""
    m = len(knots)
    if m < 2 or knots[0] != 0 or knots[-1] != 1 or any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must rise from 0 to 1")
    s = rows.groupBy("source").agg(F.sum("tokens").alias("supply"))
    everything = Window.partitionBy()
    if schedule is None:
        if len(temperatures) != m:
            raise ValueError("one temperature for each knot")
        p = F.coalesce(F.try_divide("supply", F.sum("supply").over(everything)), F.lit(0.0))
        weights = [F.pow(p, F.lit(float(x))) for x in temperatures]
    else:
        if any(len(v) != m or min(v) < 0 for v in schedule.values()):
            raise ValueError("one weight of at least 0 for each knot")
        weights = []
        for j in range(m):
            w = F.lit(0.0)
            for name, values in schedule.items():
                w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(values[j]))).otherwise(w)
            weights.append(w)
    listed = F.lit(True) if schedule is None else F.greatest(*weights) > 0
    s = s.select("source", "supply", listed.alias("listed"), *[F.when(F.col("supply") > 0, w).otherwise(0.0).alias(f"w{j}") for j, w in enumerate(weights)])
    total = [F.sum(f"w{j}").over(everything) for j in range(m)]
    s = s.select("source", "supply", "listed", *[F.when(total[j] > 0, F.col(f"w{j}") / total[j]).otherwise(0.0).alias(f"q{j}") for j in range(m)])
    integral, columns = F.lit(0.0), []
    for j in range(m):
        if j:
            integral = integral + (F.col(f"q{j - 1}") + F.col(f"q{j}")) * F.lit((knots[j] - knots[j - 1]) / 2)
        columns.append(integral.alias(f"i{j}"))
    s = s.select("*", *columns)
    last = F.col(f"i{m - 1}")
    if budget is None:
        b = F.max(F.when(last > 0, F.col("supply") / last)).over(everything)
    else:
        b = F.lit(float(budget))
    return s.select("*", b.alias("budget")).withColumn("demand", F.round(F.col("budget") * last).cast("bigint"))


def invert_demand(at: Column, knots: Sequence[float]) -> Column:
    """t with integral of q from 0 to t = at, by segments: the share is linear there, so the integral is quadratic."""
    t = F.lit(1.0)
    for j in reversed(range(len(knots) - 1)):
        width = knots[j + 1] - knots[j]
        q0, slope, need = F.col(f"q{j}"), (F.col(f"q{j + 1}") - F.col(f"q{j}")) / F.lit(width), at - F.col(f"i{j}")
        root = F.sqrt(F.greatest(F.lit(0.0), q0 * q0 + slope * need * 2))
        x = F.when(need <= 0, 0.0).otherwise(need * 2 / (q0 + root))  # the stable form of the quadratic's root
        t = F.when(at <= F.col(f"i{j + 1}"), F.lit(knots[j]) + F.least(x, F.lit(width))).otherwise(t)
    return t


def training_positions(
    docs: DataFrame,
    schedule: Mapping[str | None, Sequence[float]] | None = None,
    knots: Sequence[float] = KNOTS,
    temperatures: Sequence[float] = TEMPERATURES,
    budget: int | None = None,
) -> DataFrame:
    """doc_id, source, tokens, pass, t, position, node for each time that a row of docs(doc_id, source, text) is drawn; unsorted.

    node = xxhash64(doc_id, text). A null source is a source of its own. Rows without any
    token (null, empty) want no tokens and are drawn once, at the place of the next document
    in the order, or at position 0 if their source has no token at all; those of a source that
    the schedule leaves out are not drawn. Texts are counted whole, whatever their length. Repeated rows and ties of the hash order follow each other; equal
    rows are interchangeable. Other columns are not read; an empty table gives none.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        token_count(F.col("text")).alias("tokens"), order_key(F.col("doc_id")).alias("key"), F.xxhash64("doc_id", "text").alias("node"),
    )
    rows = materialize(rows.withColumn("bucket", F.floor(F.col("key") / F.lit((1 << 60) // BUCKETS))))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens_in"))
    before = F.sum("tokens_in").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(before, F.lit(0)).alias("offset"))
    demand = source_demand(rows, schedule, knots, temperatures, budget).withColumnRenamed("source", "d_source")
    per_bucket = offsets.join(demand, F.col("s_source").eqNullSafe(F.col("d_source"))).drop("d_source")
    w = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "node", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("within", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    placed = within.join(per_bucket, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    start = F.col("offset") + F.col("within")
    times = F.when(F.col("tokens") > 0, F.ceil((F.col("demand") - start) / F.col("supply"))).when((start <= F.col("demand")) | (F.col("supply") == 0), 1).otherwise(0)
    placed = placed.withColumn("start", start).withColumn("times", times.cast("bigint")).filter("times > 0 and listed and (demand > 0 or supply = 0)")
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    budget_of_row = F.coalesce("budget", F.lit(0.0))  # null if no source has a token
    t = invert_demand(F.coalesce(F.try_divide(F.col("start") + F.col("pass") * F.col("supply"), budget_of_row), F.lit(0.0)), knots)
    return placed.withColumn("t", t).select("doc_id", "source", "tokens", "pass", "t", (F.col("t") * budget_of_row).alias("position"), "node")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, tokens, pass, position (tokens into the training), range-sorted by position.

    Defined cases as in training_positions; positions are rounded to a thousandth of a token."""
    plan = training_positions(docs, **options)
    return plan.select("doc_id", "source", "tokens", "pass", F.round("position", 3).alias("position")).orderBy("position", "source", "doc_id", "pass")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the plan draws them, in the order of their positions, all columns as they are.

    Defined cases as in training_positions: null and empty texts are drawn once, equal rows each
    as often as the plan says, ties are in order of source and doc_id; an empty table gives none.
    Columns of any other name are carried along."""
    node, at = "__mix_node__", "__mix_position__"
    plan = training_positions(docs, **options)
    # equal rows have one entry with all their positions, so that a join doesn't multiply them
    plan = plan.groupBy(F.col("node").alias(node + "of"), F.col("doc_id").alias(node + "id"), F.col("source").alias(node + "source"), "pass").agg(
        F.sort_array(F.collect_list("position")).alias(at)
    )
    plan = plan.groupBy(node + "of", node + "id", node + "source").agg(F.max(F.size(at)).alias(node + "copies"), F.flatten(F.sort_array(F.collect_list(at))).alias(at))
    plan = materialize(plan)
    n = plan.count()
    side = F.broadcast(plan) if fits_broadcast(n, 96) else plan
    hashed = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    same = (F.col(node) == F.col(node + "of")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(node + "id")) & F.col("source").cast("string").eqNullSafe(F.col(node + "source"))
    joined = hashed.join(side, same)
    single = joined.filter(F.col(node + "copies") == 1)
    if plan.filter(F.col(node + "copies") > 1).limit(1).count():
        repeated = joined.filter(F.col(node + "copies") > 1)
        single = single.unionByName(repeated.dropDuplicates([node + "of", node + "id", node + "source"]))
    drawn = single.select(*docs.columns, F.explode(at).alias(at))
    return drawn.orderBy(at, "source", "doc_id").select(docs.columns)
