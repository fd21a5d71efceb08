"""Requests that compete for two things at once: uses of a code, shared by all users, and a user's balance.

Taken one after another, a request is granted if its item was not granted before, its code has a use left and its user's
balance covers it; a granted request takes all three. So a refusal of one user leaves a use to another, whose
payment then changes what that user can afford. The result of that walk is found without walking over all requests:
each is certainly granted (``YES``), certainly refused (``NO``) or open (``MAYBE``), and two steps narrow this in turns.

* Per code, running counts of certain and of possible uses before a request tell whether a use is certainly left,
  certainly gone, or open. Codes with a use for every request need no counting.
* Per user, requests are walked in order with the bounds between which the balance lies, in tasks that hold
  many users one after another. While nothing is open the bounds are equal, so users without scarce codes are settled at
  once. Users above ``hot_rows`` requests are spread over tasks: if only the balance decides they are solved by
  ``allow_in_order``, else judged by running totals, with certain and possible spending before each request as bounds.

Both steps are right whatever the open requests turn out to be, so what is decided stays decided. The first open request of
all has nothing open before it, so every round decides at least that one, and usually all but a few: rounds grow
with how often a code and a balance decide over one another, not with the number of requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cabledger.operators.ordered import HOT_ROWS, running_sum, split_hot
from cabledger.operators.spending import allow_in_order
from cabledger.session import materialize

c = F.col
NO, MAYBE, YES = 0, 1, 2
#: What a request needs: ``form`` is unique, ``cents`` is NULL where nothing is charged to the balance, ``takes`` is 0
#: for a request that needs a use to be left but takes none.
REQUEST = ["form", "ts", "id", "user", "item", "code", "takes", "cents"]
ORDER = ["ts", "id", "form"]


def allocate(requests: DataFrame, uses: DataFrame, balances: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(form, granted, reason) for every request.

    ``requests`` has the columns ``REQUEST``, ``uses`` (code, left) and ``balances`` (user, cents). Reasons are tested in this
    order: ``item_taken``, ``code_used_up``, ``balance_short``; a user without a balance can be charged nothing.
    """
    wanted = requests.filter(c("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    scarce = materialize(wanted.join(uses, "code", "left").filter(c("n") > F.coalesce("left", F.lit(0))).select(
        "code", F.coalesce("left", F.lit(0)).alias("left"), "n"))
    start = balances.select("user", c("cents").cast("bigint").alias("start"))
    rows = materialize(requests.select(*REQUEST).join(scarce.select("code", "left"), "code", "left").join(start, "user", "left")
                       .select(*REQUEST, "left", "start", F.lit(MAYBE).alias("state")))
    # Whether any code or user is too large for one task is found once; it can only get less.
    large_codes = hot_rows if not scarce.filter(c("n") > hot_rows).isEmpty() else None
    large_users = hot_rows if not rows.groupBy("user").count().filter(c("count") > hot_rows).isEmpty() else None
    told = _round(rows, rows.filter(c("left").isNotNull()), large_codes, large_users)
    decided = []
    while True:
        waiting = told.filter(c("state") == MAYBE).select("user").distinct()
        if waiting.isEmpty():
            decided.append(told)
            break
        waiting = materialize(waiting)
        decided.append(told.join(waiting, "user", "left_anti"))
        open_rows = materialize(told.join(waiting, "user", "left_semi"))
        # Requests decided before still count for the codes that open ones wait for.
        asked = open_rows.filter((c("state") == MAYBE) & c("left").isNotNull()).select("code").distinct()
        coded = reduce(DataFrame.unionByName, [open_rows, *decided]).filter(c("left").isNotNull()).join(asked, "code", "left_semi")
        told = _round(open_rows, coded, large_codes, large_users)
    return _reasons(materialize(reduce(DataFrame.unionByName, decided)), large_codes)


def _round(open_rows: DataFrame, coded: DataFrame, large_codes: int | None, large_users: int | None) -> DataFrame:
    """The open rows with what the codes and then the users tell of them."""
    judged = _code_states(coded, large_codes)
    known = F.when(c("state") == MAYBE, F.coalesce("code_state", F.lit(YES))).otherwise(F.lit(YES))
    told = open_rows.join(judged, "form", "left").withColumn("code_state", known)
    # What was decided stays: a request that was refused can't be granted, and one that was granted had its use.
    told = told.withColumn("code_state", F.when(c("state") == NO, NO).otherwise(c("code_state")))
    return materialize(_user_states(told, large_users).drop("code_state"))


def _code_states(coded: DataFrame, hot_rows: int | None) -> DataFrame:
    """(form, code_state) of requests for scarce codes, from the certain and the possible uses before each."""
    certain = F.when(c("state") == YES, c("takes")).otherwise(0).cast("bigint")
    possible = F.when(c("state") != NO, c("takes")).otherwise(0).cast("bigint")
    if hot_rows is None:
        before = Window.partitionBy("code").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("bigint")
        summed = coded.withColumns({"_certain": F.coalesce(F.sum(certain).over(before), zero), "_possible": F.coalesce(F.sum(possible).over(before), zero)})
    else:
        summed = coded
        for value, out in ((certain, "_certain"), (possible, "_possible")):
            summed = running_sum(summed, ["code"], ORDER, value, out, hot_rows).withColumn(out, c(out) - value)
        summed = materialize(summed)
    return summed.select("form", F.when(c("_possible") < c("left"), YES).when(c("_certain") >= c("left"), NO).otherwise(
        MAYBE).alias("code_state"))


def _user_states(told: DataFrame, hot_rows: int | None) -> DataFrame:
    cold, hot = (told, None) if hot_rows is None else split_hot(materialize(told), ["user"], hot_rows)
    walked = cold.repartition("user").sortWithinPartitions("user", *ORDER).mapInArrow(_walker(told.columns), told.schema)
    return walked if hot is None else walked.unionByName(_hot_states(materialize(hot), hot_rows).select(*told.columns))


def _walker(columns: list[str]):
    """The walk as a local function, so that it is sent to workers that do not have this package."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by user and order; a user may go on from one batch to the next.
        user, low, high, items = object(), 0, 0, {}
        for batch in batches:
            states = []
            for who, start, item, code, cents in zip(*(batch.column(n).to_pylist() for n in ("user", "start", "item", "code_state", "cents"))):
                if who != user:
                    user, low, high, items = who, start, start, {}
                seen = items.get(item, 0)
                if seen == 2 or code == 0 or (cents is not None and (high is None or cents > high)):
                    states.append(0)
                    continue
                others = 2 if seen == 0 and code == 2 else 1
                sure = others == 2 and (cents is None or cents <= low)
                states.append(2 if sure else 1)
                items[item] = 2 if sure else 1
                if cents is not None:
                    # Granted or, where that is open, not: the bounds cover both.
                    kept = high if others == 1 else min(high, cents - 1)
                    high = high - cents if sure else max(high - cents, kept)
                    low = max(low - cents, 0)
            kept = [pa.array(states, pa.int32()) if n == "state" else batch.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays(kept, names=columns)
    return walk


def _hot_states(hot: DataFrame, hot_rows: int) -> DataFrame:
    """Users with many requests: where no code is open and no item is asked for twice only the balance decides, which is
    solved exactly; the others are judged by totals."""
    live = hot.filter((c("state") != NO) & (c("code_state") != NO))
    linked = (live.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n"), F.max((c("code_state") == MAYBE).cast("int")).alias("open"))
              .filter((c("n") > 1) | (c("open") == 1)).select("user").distinct())
    linked = materialize(linked)
    alone = hot.join(linked, "user", "left_anti")
    asked = alone.filter((c("state") != NO) & (c("code_state") == YES) & c("cents").isNotNull()).select(
        c("user").alias("user_id"), "ts", F.struct("id", "form").alias("id"), (c("cents") / 100).cast("decimal(20,2)").alias("amount"))
    start = alone.groupBy("user").agg(F.max("start").alias("start")).filter(c("start").isNotNull()).select(
        c("user").alias("user_id"), (c("start") / 100).cast("decimal(20,2)").alias("balance"))
    allowed = allow_in_order(asked, start, hot_rows).select(c("id.form").alias("form"), "allowed")
    ok = (c("state") != NO) & (c("code_state") == YES) & (c("cents").isNull() | F.coalesce("allowed", F.lit(False)))
    exact = alone.join(allowed, "form", "left").withColumn("state", F.when(ok, YES).otherwise(NO)).select(*hot.columns)
    return exact.unionByName(_by_totals(hot.join(linked, "user", "left_semi"), hot_rows).select(*hot.columns))


def _by_totals(hot: DataFrame, hot_rows: int) -> DataFrame:
    """The same judgement from totals of the states so far; sound, though it may take more rounds."""
    cents = F.coalesce("cents", F.lit(0))
    at = F.struct(*ORDER)
    firsts = hot.groupBy("user", "item").agg(
        F.min(F.when(c("state") == YES, at)).alias("_granted"), F.min(F.when(c("state") != NO, at)).alias("_possible"))
    rows = hot.join(firsts, ["user", "item"]).withColumn("_cents", cents)
    certain = F.when(c("state") == YES, c("_cents")).otherwise(0).cast("bigint")
    possible = F.when(c("state") != NO, c("_cents")).otherwise(0).cast("bigint")
    for value, out in ((certain, "_spent"), (possible, "_at_most")):
        rows = running_sum(rows, ["user"], ORDER, value, out, hot_rows).withColumn(out, c(out) - value)
    charged = c("cents").isNotNull()
    taken = F.coalesce(c("_granted") < at, F.lit(False))
    short = charged & (c("start").isNull() | (c("_spent") + c("cents") > c("start")))
    free = c("_possible").isNull() | (c("_possible") >= at)
    covered = ~charged | (c("_at_most") + c("cents") <= c("start"))
    state = (F.when((c("state") == NO) | taken | (c("code_state") == NO) | short, NO)
             .when(free & (c("code_state") == YES) & covered, YES).otherwise(MAYBE))
    return rows.withColumn("state", state)


def _reasons(decided: DataFrame, hot_rows: int | None) -> DataFrame:
    at = F.struct(*ORDER)
    granted = decided.filter(c("state") == YES).groupBy("user", "item").agg(F.min(at).alias("_granted"))
    codes = _code_states(decided.filter(c("left").isNotNull()), hot_rows)
    refused = (decided.filter(c("state") == NO).join(granted, ["user", "item"], "left").join(codes, "form", "left")
               .select("form", F.lit(False).alias("granted"),
                       F.when(c("_granted") < at, "item_taken").when(c("code_state") == NO, "code_used_up")
                       .otherwise("balance_short").alias("reason")))
    return decided.filter(c("state") == YES).select(
        "form", F.lit(True).alias("granted"), F.lit(None).cast("string").alias("reason")).unionByName(refused)
