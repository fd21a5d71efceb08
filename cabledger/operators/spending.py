"""Which spendings a balance allows, one after another.

Spendings of a user are taken in order (time, id). One the remaining balance covers is allowed and reduces
it; one it cannot cover is refused and the balance stays. A refusal therefore depends on everything
before it, which no running total alone can express. Users are treated by what they need:

1. All spendings together fit the balance: all are allowed. Needs only a sum.
2. Up to ``hot_rows`` spendings: walked in order, in tasks that each hold many users sorted one after
   another, so nothing is collected per user.
3. More than that: solved in rounds of running totals over range-partitioned chunks, so that a user with
   a third of all rows is spread over all tasks. A round has a threshold T no larger than the balance. As
   long as the balance stays at T or above, every spending under T ("small") is allowed, so the balance
   before any row is known from a running total of the small ones. The round ends at the first row that
   brings the balance under T: a spending of T or more that is covered, or a small one. The next round
   starts behind that row. T is the largest power of two (in cents) within the balance, or one more than
   the user's largest spending if that is less; so the first round passes over everything that is
   certainly covered, and each later one halves the balance: 35 rounds at most for decimal(10,2), and
   usually far fewer, over ever fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cabledger.operators.ordered import CHUNK, HOT_ROWS, cut_chunks
from cabledger.session import materialize

c = F.col
COLUMNS = ["user_id", "ts", "id", "amount"]


def _pos() -> Column:
    return F.struct("ts", "id")


def _cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def allow_in_order(spendings: DataFrame, balances: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``spendings`` (user_id, ts, id, amount) with ``allowed``; ``balances`` holds user_id and balance.

    Users without a balance are allowed nothing.
    """
    needs = spendings.groupBy("user_id").agg(
        F.sum("amount").alias("_total"), F.max("amount").alias("_most"), F.count(F.lit(1)).alias("_n"))
    # One row per spending user, read by every branch below.
    state = materialize(needs.join(balances.select("user_id", "balance"), "user_id", "left").withColumn(
        "_way", F.when(c("balance").isNull(), "none").when(c("_total") <= c("balance"), "all")
        .when(c("_n") <= hot_rows, "walk").otherwise("rounds")))
    tagged = spendings.join(state.select("user_id", "balance", "_way"), "user_id")
    simple = tagged.filter(c("_way").isin("none", "all")).select(*COLUMNS, (c("_way") == "all").alias("allowed"))
    result = simple.unionByName(_walked(tagged.filter(c("_way") == "walk")))
    large = state.filter(c("_way") == "rounds").select("user_id", "balance", "_most")
    if large.isEmpty():
        return result
    return result.unionByName(_rounds(spendings.join(large.select("user_id"), "user_id", "left_semi"), large))


def _walker(columns: list[str]):
    """The row walk as a local function, so that it is sent to workers that do not have this package."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by user and order; a user may go on from one batch to the next.
        user, left = None, 0
        for batch in batches:
            allowed = []
            for who, start, amount in zip(*(batch.column(n).to_pylist() for n in ("user_id", "_start", "_amt"))):
                if who != user:
                    user, left = who, start
                covered = amount <= left
                if covered:
                    left -= amount
                allowed.append(covered)
            kept = [batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(allowed, pa.bool_())], names=[*columns, "allowed"])
    return walk


def _walked(tagged: DataFrame) -> DataFrame:
    rows = tagged.select(*COLUMNS, _cents(c("balance")).alias("_start"), _cents(c("amount")).alias("_amt"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "id")
    out = tagged.select(*COLUMNS, F.lit(True).alias("allowed")).schema
    return ordered.mapInArrow(_walker(COLUMNS), out)


def _rounds(spendings: DataFrame, balances: DataFrame) -> DataFrame:
    """Exact spread form; see the module text."""
    cents = spendings.select(*COLUMNS, _cents(c("amount")).alias("_amt"))
    chunks = cut_chunks(cents, ["user_id"], ["ts", "id"])
    # A user's state: largest spending and balance in cents, and the last decided position (NULL at first).
    no_pos = F.lit(None).cast(chunks.select(_pos().alias("p")).schema["p"].dataType)
    state = balances.select("user_id", _cents(c("_most")).alias("_most"), _cents(c("balance")).alias("_bal"),
                            no_pos.alias("_pos"))
    phases: DataFrame | None = None
    # The largest power of two within a positive number, from the length of its binary form.
    power = F.expr("shiftleft(1L, length(bin(_bal)) - 1)")
    while True:
        state = state.filter(c("_bal") > 0).withColumn("_t", F.least(power, c("_most") + 1))
        if state.isEmpty():
            break
        ends = materialize(_round_ends(chunks, state))
        phase = state.join(ends.drop("_most"), "user_id", "left").select(
            "user_id", F.struct(c("_pos").alias("from"), "_t", c("_end.pos").alias("to"), c("_end.large").alias("large")).alias("phase"))
        phases = phase if phases is None else phases.unionByName(phase)
        state = ends.select("user_id", "_most", c("_end.bal").alias("_bal"), c("_end.pos").alias("_pos"))
    rows = chunks.select(*COLUMNS, "_amt")
    if phases is None:
        return rows.select(*COLUMNS, (c("_amt") == 0).alias("allowed"))
    # At most 35 phases per user, kept as one array; a row lies in at most one of them.
    per_user = materialize(phases.groupBy("user_id").agg(F.collect_list("phase").alias("_phases")))
    joined = rows.join(per_user, "user_id", "left")

    def allows(p: Column) -> Column:
        after = p["from"].isNull() | (_pos() > p["from"])
        within = p["to"].isNull() | (_pos() <= p["to"])
        closing = F.coalesce(p["large"] & (_pos() == p["to"]), F.lit(False))
        return after & within & ((c("_amt") < p["_t"]) | closing)

    ok = (c("_amt") == 0) | F.coalesce(F.exists("_phases", allows), F.lit(False))
    return joined.select(*COLUMNS, ok.alias("allowed"))


def _round_ends(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Per user the row that ends the round: position, balance after it, and whether it was a large one."""
    open_rows = chunks.join(state, "user_id").filter(
        (c("_pos").isNull() | (_pos() > c("_pos"))) & (c("_amt") <= c("_bal")) & (c("_amt") > 0))
    small = F.when(c("_amt") < c("_t"), c("_amt")).otherwise(0)
    sums = open_rows.groupBy("user_id", CHUNK).agg(F.sum(small).alias("_s"))
    earlier = Window.partitionBy("user_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("user_id", CHUNK, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("user_id", CHUNK).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = open_rows.join(carried, ["user_id", CHUNK]).withColumn(
        "_left", c("_bal") - c("_before") - F.coalesce(F.sum(small).over(inside), F.lit(0)))
    large = c("_amt") >= c("_t")
    closes = F.when(large, c("_amt") <= c("_left")).otherwise(c("_left") - c("_amt") < c("_t"))
    return placed.filter(closes).groupBy("user_id", "_most").agg(F.min(F.struct(
        _pos().alias("pos"), (c("_left") - c("_amt")).alias("bal"), large.alias("large"))).alias("_end"))
