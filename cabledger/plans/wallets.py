"""Wallets: top-ups, payout requests and approvals, and the statement of all movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cabledger.functions.clock import moment
from cabledger.functions.money import money, total
from cabledger.functions.text import number
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.forms import check_topup, failed, passed
from cabledger.operators.ordered import HOT_ROWS, running_sum
from cabledger.session import materialize
from cabledger.sources.sinks import update_join

c = F.col


def top_up_wallets(requests: DataFrame, wallet: DataFrame, applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Add every valid top-up (request_id, user_id, amount as text, requested_at) to its user's wallet, each request once.

    Requests in the ledger ``applied`` of earlier runs are left out.
    """
    checked = materialize(check_topup(once(requests, "request_id", ["requested_at"], applied)))
    added = passed(checked).groupBy("user_id").agg(F.sum(number(c("amount"))).cast("decimal(20,2)").alias("added"))
    return {
        "wallet": update_join(wallet, added, ["user_id"], {"balance": c("balance") + c("_d_added")}, carry=["added"]),
        "rejected": failed(checked).drop(FORM),
        "applied": ledger(checked, applied),
    }


def request_payouts(wallet: DataFrame, ids: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Mark the wallets of ``ids`` (user_id) as waiting for payout if they hold money."""
    asked = ids.select("user_id").distinct()
    funded = asked.join(wallet.filter(c("balance") > 0).select("user_id"), "user_id", "left_semi")
    return {
        "wallet": update_join(wallet, funded, ["user_id"],
                              {"payout_status": F.lit("pending"), "last_payout_date": moment(as_of)}),
        "rejected": asked.join(wallet.filter(c("balance") > 0).select("user_id"), "user_id", "left_anti")
        .withColumn("reason", F.lit("no_balance")),
    }


def approve_payouts(driver_ids: DataFrame, driver_earnings: DataFrame, wallet: DataFrame, drivers: DataFrame,
                    as_of: str) -> dict[str, DataFrame]:
    """Pay out drivers: their pending earnings become paid and their wallets are emptied.

    The whole wallet is emptied whatever the pending sum is; ``differences`` shows balance minus pending.
    """
    chosen = drivers.select("driver_id", "user_id").join(driver_ids.select("driver_id").distinct(), "driver_id")
    state = F.when(c("payout_status") == "pending", "paid").otherwise(c("payout_status"))
    pending = driver_earnings.filter(c("payout_status") == "pending").groupBy("driver_id").agg(
        total("net_amount").alias("pending_total"))
    compared = (chosen.join(wallet.select("user_id", "balance"), "user_id").join(pending, "driver_id", "left")
                .withColumn("pending_total", F.coalesce("pending_total", F.lit(0)).cast("decimal(20,2)")))
    return {
        "driver_earnings": update_join(driver_earnings, chosen, ["driver_id"], {"payout_status": state}),
        "wallet": update_join(wallet, chosen, ["user_id"], {
            "balance": money(F.lit(0)), "payout_status": F.lit("completed"), "last_payout_date": moment(as_of)}),
        "differences": compared.select(
            "driver_id", "user_id", "balance", "pending_total",
            (c("balance") - c("pending_total")).cast("decimal(20,2)").alias("difference")),
    }


def wallet_statement(topups: DataFrame, driver_earnings: DataFrame, drivers: DataFrame, payments: DataFrame,
                     payouts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All wallet movements with the running balance per user.

    ``topups`` and ``payouts`` hold user_id, ts, id and amount. Top-ups and net earnings add, wallet
    payments and payouts subtract.
    """
    def moves(df: DataFrame, kind: str, user, ts, id, amount) -> DataFrame:
        return df.select(c(user).alias("user_id"), c(ts).alias("ts"), F.lit(kind).alias("kind"), c(id).alias("id"),
                         amount.cast("decimal(12,2)").alias("amount"))
    earned = driver_earnings.join(drivers.select("driver_id", "user_id"), "driver_id")
    paid = payments.filter((c("pay_method") == "wallet") & (c("pay_status") == "paid"))
    all_moves = (moves(topups, "topup", "user_id", "ts", "id", c("amount"))
                 .unionByName(moves(earned, "earning", "user_id", "earned_at", "earning_id", c("net_amount")))
                 .unionByName(moves(paid, "payment", "rider_id", "transaction_date", "payment_id", -c("amount")))
                 .unionByName(moves(payouts, "payout", "user_id", "ts", "id", -c("amount"))))
    summed = running_sum(all_moves, ["user_id"], ["ts", "kind", "id"], c("amount"), "running_balance", hot_rows)
    return summed.withColumn("running_balance", c("running_balance").cast("decimal(20,2)"))
