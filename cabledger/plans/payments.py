"""Paying for rides: promo discounts, capped redemption, settlement and closing of paid rides.

What several outputs of a job share is written once, so producing all of them joins the requests once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cabledger import schema
from cabledger.functions import money
from cabledger.functions.clock import moment
from cabledger.functions.text import blank, folded, trimmed
from cabledger.operators.allocation import allocate
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.ordered import HOT_ROWS
from cabledger.plans.trips import in_date
from cabledger.session import materialize
from cabledger.sources.sinks import insert_ignore, update_join, upsert

c = F.col
REQUEST = ["request_id", "ride_id", "rider_id", "pay_method", "promo_code", "requested_at"]


def apply_promos(requests: DataFrame, rides: DataFrame, payments: DataFrame, promo_codes: DataFrame, as_of: str,
                 enforce_start: bool = False, applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Price payment requests: ``priced`` (with promo_id, discount, total) and ``rejected`` (with reason).

    Reasons in the order they are tested: unknown payment method, no such ride of this rider with a fare,
    already paid, code unknown or out of date. All good requests of a ride are priced; which of them pays, and whether its code
    has a use left, is decided by ``redeem_promos_capped``. Each request counts once; those in the ledger ``applied`` of earlier runs are left out.
    """
    fresh = once(requests.select(*REQUEST), "request_id", ["requested_at"], applied)
    own = rides.filter(c("fare") != 0).select("ride_id", "rider_id", "fare")
    paid = payments.filter(c("pay_status") == "paid").select("ride_id", F.lit(True).alias("_paid"))
    codes = promo_codes.filter(in_date(as_of, enforce_start)).select(
        folded(c("code")).alias("_code"), "promo_id", "discount_pct")
    joined = (fresh.withColumn("_code", folded(F.when(~blank(trimmed(c("promo_code"))), trimmed(c("promo_code")))))
              .join(own, ["ride_id", "rider_id"], "left").join(paid, "ride_id", "left").join(codes, "_code", "left"))
    reason = (F.when(~F.coalesce(c("pay_method").isin(schema.PAY_METHODS), F.lit(False)), "method_invalid")
              .when(c("fare").isNull(), "ride_not_payable")
              .when(c("_paid"), "already_paid")
              .when(c("_code").isNotNull() & c("promo_id").isNull(), "promo_not_usable"))
    tested = materialize(joined.withColumn("reason", reason).drop("_code"))
    off = F.coalesce(money.discount(c("fare"), c("discount_pct")), money.money(F.lit(0)))
    priced = tested.filter(c("reason").isNull()).withColumn("discount", off)
    return {
        "priced": priced.select("request_id", "ride_id", "rider_id", "pay_method", "requested_at", "fare", "promo_id",
                                "discount", money.after_discount(c("fare"), c("discount")).alias("total"), FORM),
        "rejected": tested.filter(c("reason").isNotNull()).select(*REQUEST, "reason"),
        "applied": ledger(tested, applied),
    }


# What a refusal is called here.
REFUSALS = {"item_taken": "already_paid", "code_used_up": "promo_used_up", "balance_short": "insufficient_balance"}


def redeem_promos_capped(priced: DataFrame, promo_codes: DataFrame, wallet: DataFrame, payments: DataFrame,
                         hot_rows: int = HOT_ROWS) -> dict[str, DataFrame]:
    """Decide priced requests as if they came one after another, by time and id.

    A request is accepted if its ride was not paid by an earlier one, its code has a use left and, from a wallet, the
    balance covers it. One that is refused leaves its use and its ride to later ones. A payment takes a use unless the ride's
    payment held a code before. ``rejected`` are those that found their code used up, ``refused`` those that found their
    ride paid or the balance short; ``reserved`` counts the uses taken per code.
    """
    held = payments.filter(c("promo_id").isNotNull()).select("ride_id", F.lit(0).alias("_held"))
    marked = materialize(priced.join(held, "ride_id", "left").withColumn("takes", F.coalesce("_held", F.lit(1))).drop("_held"))
    cents = (c("total") * 100).cast("bigint")
    asked = marked.select(
        c(FORM).alias("form"), c("requested_at").alias("ts"), c("request_id").alias("id"), c("rider_id").alias("user"),
        c("ride_id").alias("item"), c("promo_id").alias("code"), "takes", F.when(c("pay_method") == "wallet", cents).alias("cents"))
    left = promo_codes.select(c("promo_id").alias("code"), (c("usage_limit") - c("usage_count")).alias("left"))
    balances = wallet.select(c("user_id").alias("user"), (c("balance") * 100).cast("bigint").alias("cents"))
    told = allocate(asked, left, balances, hot_rows).withColumnRenamed("form", FORM)
    decided = materialize(marked.join(told.replace(REFUSALS, subset=["reason"]), FORM))
    accepted, refused = decided.filter("granted"), decided.filter("NOT granted").select(*priced.columns, "reason")
    uses = accepted.filter(c("promo_id").isNotNull() & (c("takes") == 1)).groupBy("promo_id").agg(F.count(F.lit(1)).alias("uses"))
    return {
        "accepted": accepted.select(*priced.columns),
        "rejected": refused.filter(c("reason") == "promo_used_up"),
        "refused": refused.filter(c("reason") != "promo_used_up"),
        "reserved": uses,
    }


def settle_payments(accepted: DataFrame, payments: DataFrame, wallet: DataFrame, as_of: str,
                    promo_codes: DataFrame) -> dict[str, DataFrame]:
    """Take the money of accepted requests, one per ride: paid payments (new, or replacing an unpaid one of the ride), wallets
    less what was spent, and codes with their uses.

    A code is used once more for every paid payment that holds it and was not there before or held no code.
    """
    paid = materialize(accepted.select(
        c("ride_id").alias("payment_id"), "ride_id", "rider_id", "promo_id", c("total").alias("amount"), "pay_method",
        F.lit("paid").alias("pay_status"), c("discount").alias("discount_appld"), moment(as_of).alias("transaction_date")))
    spent = paid.filter("pay_method = 'wallet'").groupBy(c("rider_id").alias("user_id")).agg(F.sum("amount").alias("spent"))
    held = payments.filter(c("promo_id").isNotNull()).select("ride_id")
    used = paid.filter(c("promo_id").isNotNull()).select("ride_id", "promo_id").join(held, "ride_id", "left_anti")
    uses = used.groupBy("promo_id").agg(F.count(F.lit(1)).alias("uses"))
    return {
        "promo_codes": update_join(promo_codes, uses, ["promo_id"],
                                   {"usage_count": c("usage_count") + c("_d_uses")}, carry=["uses"]),
        "payments": upsert(payments, paid, ["ride_id"], ["promo_id", "amount", "pay_method", "pay_status",
                                                         "discount_appld", "transaction_date"]),
        "wallet": update_join(wallet, spent, ["user_id"], {"balance": c("balance") - c("_d_spent")}, carry=["spent"]),
    }


def pay_rides(requests: DataFrame, t: Mapping[str, DataFrame], as_of: str, applied: DataFrame | None = None,
              hot_rows: int = HOT_ROWS) -> dict[str, DataFrame]:
    """The whole chain for payment requests: new payments, wallets and codes, every refused request with its reason, the ledger."""
    priced = apply_promos(requests, t["rides"], t["payments"], t["promo_codes"], as_of, applied=applied)
    decided = redeem_promos_capped(priced["priced"], t["promo_codes"], t["wallet"], t["payments"], hot_rows)
    settled = settle_payments(decided["accepted"], t["payments"], t["wallet"], as_of, t["promo_codes"])
    # A code is looked up only for a ride that no earlier request has paid.
    payer = decided["accepted"].select("ride_id", F.struct("requested_at", "request_id").alias("_paid"))
    late = (c("reason") == "promo_not_usable") & (c("_paid") < F.struct("requested_at", "request_id"))
    barred = priced["rejected"].join(payer, "ride_id", "left").withColumn("reason", F.when(late, "already_paid").otherwise(c("reason")))
    parts = barred, decided["rejected"], decided["refused"]
    return {**settled, "rejected": reduce(DataFrame.unionByName, (p.select("request_id", "reason") for p in parts)),
            "applied": priced["applied"]}


def newly_paid(payments_old: DataFrame, payments_new: DataFrame) -> DataFrame:
    """Rides whose payment turned paid; a payment first seen as paid counts too."""
    now = payments_new.filter(c("pay_status") == "paid").select("ride_id")
    before = payments_old.filter(c("pay_status") == "paid").select("ride_id")
    return now.join(before, "ride_id", "left_anti")


def on_payment_paid(payments_old: DataFrame, payments_new: DataFrame, rides: DataFrame, ride_history: DataFrame,
                    as_of: str) -> dict[str, DataFrame]:
    """Close the rides of new payments unless already closed, and archive those that are completed."""
    paid = newly_paid(payments_old, payments_new)
    open_paid = paid.join(rides.filter(~c("status").isin("completed", "cancelled")).select("ride_id"), "ride_id",
                          "left_semi")
    closed = update_join(rides, open_paid, ["ride_id"],
                         {"status": F.lit("completed"), "completed_at": moment(as_of)})
    done = rides.filter(c("status") != "cancelled").join(paid, "ride_id", "left_semi").select(
        "ride_id", F.lit("completed").alias("outcome"), F.coalesce("fare", F.lit(0)).alias("final_fare"),
        moment(as_of).alias("archived_at"))
    return {"rides": closed, "ride_history": insert_ignore(ride_history, done, ["ride_id"])}
