"""Mixing a corpus to target weights by iterative proportional fitting.

Tokens are summed per cell of source, language and topic. Raking multiplies the cells by one factor per value of each
dimension, in turn, until the sums over every dimension meet their targets. A document is then drawn a whole number
of times whose expectation is its cell's target divided by the cell's tokens, times the tokens wanted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cabledger.session import materialize

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
ROUNDS, TOLERANCE = 200, 1e-6
#: Tables of cells up to this size are raked on the driver; larger ones by Spark, with equal results.
DRIVER_CELLS = 200_000
#: What a null value of a dimension is called.
NONE = ""


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A stand-in where a corpus has no topics: a bucket of the MinHash of the words, which texts with like vocabularies
    tend to share. Null and empty texts are in bucket 0."""
    least = F.array_min(F.transform(F.split(F.coalesce(text, F.lit("")), " "), lambda w: F.xxhash64(w)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("0")).otherwise(F.pmod(least, F.lit(topics)).cast("string"))


def tokens_of(text: Column) -> Column:
    """White-space separated words, the measure of weight."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def cell_sums(rows: DataFrame, dimensions: Sequence[str], tokens: str) -> DataFrame:
    """(dimensions, tokens) per cell with tokens."""
    return (rows.groupBy(*[_value(d).alias(d) for d in dimensions])
            .agg(F.sum(F.col(tokens)).cast("double").alias("tokens")).filter("tokens > 0"))


def tempered(cells: DataFrame, dimension: str, temperature: float) -> DataFrame:
    """(value, share): shares of tokens to the power 1/temperature; above 1 it lifts rare values."""
    return cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(1 / temperature)).alias("share"))


def _rake_locally(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    table = cells.orderBy(*targets).toPandas()
    codes, goals = {}, {}
    for d, frame in targets.items():
        values, codes[d] = np.unique(table[d].to_numpy(dtype=str), return_inverse=True)
        share = {r["value"]: float(r["share"]) for r in frame.collect() if r["value"] in set(values)}
        goal = np.array([share.get(v, 0.0) for v in values])
        goals[d] = goal / goal.sum()
    weight = table["tokens"].to_numpy() / table["tokens"].sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for d in targets:
            sums = np.bincount(codes[d], weight, len(goals[d]))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(sums > 0, goals[d] / sums, 0.0)
            worst = max(worst, float(np.abs(sums - goals[d]).max()))
            weight = weight * factor[codes[d]]
        if worst < TOLERANCE:
            break
    table["weight"] = weight / weight.sum() if weight.sum() > 0 else weight
    return cells.sparkSession.createDataFrame(table[[*targets, "tokens", "weight"]])


def _rake_by_spark(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """The same with one small table of factors per dimension, written after each step."""
    goals, factors = {}, {}
    for d, frame in targets.items():
        present = cells.select(F.col(d).alias("value")).distinct().join(
            frame.select(F.col("value").cast("string").alias("value"), "share"), "value", "left").na.fill(0.0)
        total = present.agg(F.sum("share")).first()[0]
        goals[d] = materialize(present.select(F.col("value").alias(d), (F.col("share") / total).alias("goal")))
        factors[d] = goals[d].select(d, F.lit(1.0).alias("f_" + d))
    total = cells.agg(F.sum("tokens")).first()[0]

    def weighed() -> DataFrame:
        product = reduce(lambda a, b: a * b, [F.col("f_" + d) for d in targets], F.col("tokens") / total)
        return reduce(lambda a, d: a.join(factors[d], d), targets, cells).withColumn("weight", product)

    for _ in range(ROUNDS):
        worst = 0.0
        for d in targets:
            sums = weighed().groupBy(d).agg(F.sum("weight").alias("sum"))
            step = materialize(sums.join(goals[d], d).join(factors[d], d).select(
                d, F.when(F.col("sum") > 0, F.col("f_" + d) * F.col("goal") / F.col("sum")).otherwise(0.0).alias("f_" + d),
                F.abs(F.col("sum") - F.col("goal")).alias("error")))
            worst = max(worst, step.agg(F.max("error")).first()[0])
            factors[d] = step.drop("error")
        if worst < TOLERANCE:
            break
    result = materialize(weighed().select(*targets, "tokens", "weight"))
    whole = result.agg(F.sum("weight")).first()[0]
    return result.withColumn("weight", F.col("weight") / (whole or 1.0))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: shares of one whose sums per dimension meet ``targets``.

    ``targets`` maps each dimension to (value, share); shares are scaled to sum to one over the values present, and a value
    without a share gets none. Where no fit exists, the last of ``ROUNDS`` rounds stands.
    """
    if cells.isEmpty():
        return cells.withColumn("weight", F.lit(0.0))
    return (_rake_locally if cells.count() <= driver_cells else _rake_by_spark)(cells, targets)


def drawn(rows: DataFrame, weights: DataFrame, id_col: str, dimensions: Sequence[str], wanted: float, seed: int = 42) -> DataFrame:
    """``rows`` with ``weight``, the expected number of draws, and ``copies``, the draws: the whole part of it and one
    more if a hash of the id falls below the rest. ``wanted`` is the number of tokens to expect in all."""
    rates = weights.select(F.struct(*dimensions).alias("__cell"), (F.col("weight") * wanted / F.col("tokens")).alias("__rate"))
    cell = F.struct(*[_value(d).alias(d) for d in dimensions])
    chance = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) / float(1 << 53)
    rate = F.coalesce(F.col("__rate"), F.lit(0.0))
    return (rows.withColumn("__at", cell).join(rates, F.col("__at") == F.col("__cell"), "left").withColumn("weight", rate)
            .withColumn("copies", (F.floor("weight") + (chance < F.col("weight") - F.floor("weight")).cast("int")).cast("int"))
            .drop("__at", "__cell", "__rate"))


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text",
        share: float = 0.5, temperature: float = 2.0, topic_col: str | None = None, seed: int = 42) -> DataFrame:
    """``docs`` with all rows and columns, plus ``topic`` and ``tokens`` if no ``topic_col`` names them, ``weight`` and ``copies``.

    ``targets`` are as for ``raked`` over source, lang and topic; by default the tempered shares of the corpus itself. In
    expectation the draws hold ``share`` of the corpus' tokens, split as the targets say. Null values of a dimension
    are a value of their own. Null and empty texts have no tokens and are drawn at their cell's rate, 0 in a cell without
    tokens. Equal ids draw alike, null ids too. An empty table gives no rows. Columns of ``docs`` named ``topic``, ``tokens``,
    ``weight`` or ``copies`` are replaced.
    """
    marked = docs.withColumn("topic", F.col(topic_col) if topic_col else topic_of(F.col(text_col))).withColumn(
        "tokens", tokens_of(F.col(text_col)))
    cells = materialize(cell_sums(marked, DIMENSIONS, "tokens"))
    targets = targets or {d: tempered(cells, d, temperature) for d in DIMENSIONS}
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    return drawn(marked, raked(cells, targets), id_col, DIMENSIONS, share * total, seed)
