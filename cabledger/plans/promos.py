"""Promo codes and fare rules: creating, saving and expiring them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cabledger import schema
from cabledger.functions.clock import moment
from cabledger.functions.text import folded, number, trimmed, unfolded, whole
from cabledger.operators.deliveries import FORM, ledger, once
from cabledger.operators.forms import check_fare_rule, check_promo, failed, passed
from cabledger.operators.pick import first_per_key, last_per_key
from cabledger.session import materialize
from cabledger.sources.sinks import update_where, upsert

c = F.col


def create_promos(forms: DataFrame, promo_codes: DataFrame, applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Valid forms with a code not in use become promo codes; the first form of a code wins.

    ``forms`` holds promo_id, submitted_at and the text fields of a promo. Each form counts once; those in the ledger
    ``applied`` of earlier runs are left out.
    """
    checked = materialize(check_promo(once(forms, "promo_id", ["submitted_at"], applied)))
    good = passed(checked).withColumn("_code", folded(F.upper(trimmed(c("code")))))
    free = good.join(promo_codes.select(folded(c("code")).alias("_code")), "_code", "left_anti")
    first = first_per_key(free.select("_code", "submitted_at", "promo_id", FORM), ["_code"], ["submitted_at", "promo_id", FORM])
    taken = materialize(first.select(FORM))
    made = free.join(taken, FORM, "left_semi").select(
        "promo_id", unfolded(c("_code")).alias("code"), number(c("discount_pct")).alias("discount_pct"),
        whole(c("usage_limit")).alias("usage_limit"), F.lit(0).alias("usage_count"),
        c("valid_from").cast("timestamp_ntz"), c("valid_until").cast("timestamp_ntz"))
    double = good.join(taken, FORM, "left_anti").withColumn("reason", F.lit("code_exists"))
    return {
        "promo_codes": promo_codes.unionByName(schema.conform(made, "promo_codes")),
        "rejected": failed(checked).drop(FORM).unionByName(double.select(*forms.columns, "reason")),
        "applied": ledger(checked, applied),
    }


def expire_promos(promo_codes: DataFrame, as_of: str) -> DataFrame:
    """Close codes past their end date that still have uses left."""
    over = (c("valid_until") < moment(as_of)) & (c("usage_count") < c("usage_limit"))
    return update_where(promo_codes, over, {"usage_limit": c("usage_count")})


def upsert_fare_rules(forms: DataFrame, fare_rules: DataFrame) -> dict[str, DataFrame]:
    """Valid forms set the rates of their city and vehicle type; the last form of a pair wins.

    ``forms`` holds rule_id (used for a new pair), submitted_at and the text fields of a rule. An empty or
    zero surge is saved as 1.00.
    """
    checked = check_fare_rule(once(forms, "rule_id", ["submitted_at"]))
    surge = number(c("surge_multi"))
    typed = passed(checked).select(
        "rule_id", "submitted_at", trimmed(c("city")).alias("city"), folded(trimmed(c("city"))).alias("_city"),
        "vehicle_type",
        *[number(c(n)).cast("decimal(8,2)").alias(n) for n in ("base_rate", "per_km_rate", "per_min_rate")],
        F.when(F.coalesce(surge, F.lit(0)) == 0, 1).otherwise(surge).cast("decimal(4,2)").alias("surge_multi"))
    last = last_per_key(typed, ["_city", "vehicle_type"], ["submitted_at", "rule_id"])
    # Known pairs keep the spelling of their city.
    known = fare_rules.select(folded(c("city")).alias("_city"), "vehicle_type", c("city").alias("_spelled"))
    spelled = last.join(known, ["_city", "vehicle_type"], "left").withColumn(
        "city", F.coalesce("_spelled", "city")).drop("_city", "_spelled")
    return {
        "fare_rules": upsert(fare_rules, spelled, ["city", "vehicle_type"],
                             ["base_rate", "per_km_rate", "per_min_rate", "surge_multi"]),
        "rejected": failed(checked).drop(FORM),
    }
