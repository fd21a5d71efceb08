"""Table schemas, keys, links and row rules of the marketplace data model.

Money is always decimal, ids are long, and wall-clock times carry no zone. Passwords are not part of
the data. ``wallet`` and ``ride_history`` are keyed by the user and ride they belong to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

# Columns and types of every table.
COLUMNS = {
    "users": """user_id BIGINT, full_name STRING, email STRING, phone STRING, role STRING,
        acc_status STRING, registration_date TIMESTAMP_NTZ""",
    "drivers": """driver_id BIGINT, user_id BIGINT, cnic STRING, license_num STRING,
        profile_photo STRING, verify_status STRING, avail_status STRING, avg_rating DECIMAL(3,2),
        total_trips BIGINT""",
    "vehicles": """vehicle_id BIGINT, driver_id BIGINT, make STRING, model STRING, year INT,
        color STRING, license_plate STRING, vehicle_type STRING, verify_status STRING""",
    "locations": """location_id BIGINT, latitude DECIMAL(10,7), longitude DECIMAL(10,7),
        address STRING, city STRING""",
    "fare_rules": """rule_id BIGINT, city STRING, vehicle_type STRING, base_rate DECIMAL(8,2),
        per_km_rate DECIMAL(8,2), per_min_rate DECIMAL(8,2), surge_multi DECIMAL(4,2)""",
    "promo_codes": """promo_id BIGINT, code STRING, discount_pct DECIMAL(5,2), usage_limit BIGINT,
        usage_count BIGINT, valid_from TIMESTAMP_NTZ, valid_until TIMESTAMP_NTZ""",
    "wallet": """user_id BIGINT, balance DECIMAL(10,2), last_payout_date TIMESTAMP_NTZ,
        payout_status STRING""",
    "rides": """ride_id BIGINT, rider_id BIGINT, driver_id BIGINT, vehicle_id BIGINT,
        pickup_location_id BIGINT, dropoff_location_id BIGINT, rule_id BIGINT, status STRING,
        fare DECIMAL(10,2), distance DECIMAL(8,2), duration INT, scheduled_at TIMESTAMP_NTZ,
        completed_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ""",
    "payments": """payment_id BIGINT, ride_id BIGINT, rider_id BIGINT, promo_id BIGINT,
        amount DECIMAL(10,2), pay_method STRING, pay_status STRING, discount_appld DECIMAL(10,2),
        transaction_date TIMESTAMP_NTZ""",
    "driver_earnings": """earning_id BIGINT, ride_id BIGINT, driver_id BIGINT,
        gross_amount DECIMAL(10,2), commission DECIMAL(10,2), net_amount DECIMAL(10,2),
        payout_status STRING, earned_at TIMESTAMP_NTZ""",
    "ratings": """rating_id BIGINT, ride_id BIGINT, rated_by BIGINT, rated_user_id BIGINT,
        rater_role STRING, score INT, comment STRING, rated_at TIMESTAMP_NTZ""",
    "complaints": """complaint_id BIGINT, ride_id BIGINT, filed_by BIGINT, against_user_id BIGINT,
        subject STRING, description STRING, status STRING, filed_at TIMESTAMP_NTZ,
        resolved_at TIMESTAMP_NTZ""",
    "ride_history": """ride_id BIGINT, outcome STRING, final_fare DECIMAL(10,2),
        archived_at TIMESTAMP_NTZ""",
    "admin_notifications": """notification_id BIGINT, type STRING, message STRING, related_user_id BIGINT, is_read BOOLEAN,
        created_at TIMESTAMP_NTZ""",
}

# Closed word lists in their declared sort order.
ROLES = ["super_admin", "admin", "rider", "driver"]
ACCOUNT_STATES = ["active", "suspended", "banned"]
VERIFY_STATES = ["pending", "verified", "rejected"]
AVAIL_STATES = ["online", "offline", "on_trip"]
VEHICLE_TYPES = ["economy", "premium", "bike"]
WALLET_PAYOUT_STATES = ["none", "pending", "completed"]
RIDE_STATES = ["requested", "accepted", "driver_en_route", "in_progress", "completed", "cancelled"]
ACTIVE_STATES = ["requested", "accepted", "driver_en_route", "in_progress"]
PAY_METHODS = ["cash", "wallet", "card"]
PAY_STATES = ["pending", "paid", "failed", "refunded"]
EARNING_STATES = ["pending", "paid"]
RATER_ROLES = ["rider", "driver"]
COMPLAINT_STATES = ["open", "under_review", "resolved", "dismissed"]
OUTCOMES = ["completed", "cancelled"]

# Primary keys.
PRIMARY_KEY = {
    "users": "user_id", "drivers": "driver_id", "vehicles": "vehicle_id",
    "locations": "location_id", "fare_rules": "rule_id", "promo_codes": "promo_id",
    "wallet": "user_id", "rides": "ride_id", "payments": "payment_id",
    "driver_earnings": "earning_id", "ratings": "rating_id", "complaints": "complaint_id",
    "ride_history": "ride_id", "admin_notifications": "notification_id",
}

# Further unique keys beside the primary key.
# Unique keys.
UNIQUE_KEYS = {
    "users": [["email"], ["phone"]],
    "drivers": [["user_id"], ["cnic"], ["license_num"]],
    "vehicles": [["license_plate"]],
    "fare_rules": [["city", "vehicle_type"]],
    "promo_codes": [["code"]],
    "payments": [["ride_id"]],
    "driver_earnings": [["ride_id"]],
    "ratings": [["ride_id", "rated_by"]],
}

# Columns that may be empty.
NULLABLE = {
    "drivers": {"profile_photo"},
    "locations": {"address"},
    "wallet": {"last_payout_date"},
    "rides": {"driver_id", "vehicle_id", "rule_id", "fare", "distance", "duration",
              "scheduled_at", "completed_at"},
    "payments": {"promo_id"},
    "ratings": {"comment"},
    "complaints": {"resolved_at"},
    "admin_notifications": {"related_user_id"},
}


@dataclass(frozen=True)
class Link:
    """A child column pointing at a parent key, and what a parent delete does to the child."""

    child: str
    column: str
    parent: str
    on_delete: str

    @property
    def parent_key(self) -> str:
        return PRIMARY_KEY[self.parent]


# Links between tables and what a delete does.
LINKS = [
    Link("drivers", "user_id", "users", "cascade"),
    Link("wallet", "user_id", "users", "cascade"),
    Link("vehicles", "driver_id", "drivers", "cascade"),
    Link("rides", "rider_id", "users", "restrict"),
    Link("rides", "driver_id", "drivers", "set_null"),
    Link("rides", "vehicle_id", "vehicles", "set_null"),
    Link("rides", "pickup_location_id", "locations", "restrict"),
    Link("rides", "dropoff_location_id", "locations", "restrict"),
    Link("rides", "rule_id", "fare_rules", "set_null"),
    Link("payments", "ride_id", "rides", "restrict"),
    Link("payments", "rider_id", "users", "restrict"),
    Link("payments", "promo_id", "promo_codes", "set_null"),
    Link("driver_earnings", "ride_id", "rides", "restrict"),
    Link("driver_earnings", "driver_id", "drivers", "restrict"),
    Link("ratings", "ride_id", "rides", "restrict"),
    Link("ratings", "rated_by", "users", "restrict"),
    Link("ratings", "rated_user_id", "users", "restrict"),
    Link("complaints", "ride_id", "rides", "restrict"),
    Link("complaints", "filed_by", "users", "restrict"),
    Link("complaints", "against_user_id", "users", "restrict"),
    Link("ride_history", "ride_id", "rides", "restrict"),
    Link("admin_notifications", "related_user_id", "users", "set_null"),
]

# Column -> closed word list.
# Which word list a column takes.
DOMAINS = {
    "users": {"role": ROLES, "acc_status": ACCOUNT_STATES},
    "drivers": {"verify_status": VERIFY_STATES, "avail_status": AVAIL_STATES},
    "vehicles": {"vehicle_type": VEHICLE_TYPES, "verify_status": VERIFY_STATES},
    "fare_rules": {"vehicle_type": VEHICLE_TYPES},
    "wallet": {"payout_status": WALLET_PAYOUT_STATES},
    "rides": {"status": RIDE_STATES},
    "payments": {"pay_method": PAY_METHODS, "pay_status": PAY_STATES},
    "driver_earnings": {"payout_status": EARNING_STATES},
    "ratings": {"rater_role": RATER_ROLES},
    "complaints": {"status": COMPLAINT_STATES},
    "ride_history": {"outcome": OUTCOMES},
}

# Column -> longest text allowed.
# Longest texts.
LENGTHS = {
    "users": {"full_name": 100, "email": 150, "phone": 20},
    "drivers": {"cnic": 20, "license_num": 50, "profile_photo": 500},
    "vehicles": {"make": 50, "model": 50, "color": 30, "license_plate": 20},
    "locations": {"address": 300, "city": 100},
    "fare_rules": {"city": 100},
    "promo_codes": {"code": 30},
    "complaints": {"subject": 200},
    "admin_notifications": {"type": 50},
}

# Rule name -> condition every row must meet (unknown counts as met).
# Rules within a row.
ROW_RULES = {
    "drivers": {"avg_rating_range": "avg_rating BETWEEN 0 AND 5"},
    "vehicles": {"year_from_2000": "year >= 2000"},
    "locations": {"latitude_range": "latitude BETWEEN -90 AND 90",
                  "longitude_range": "longitude BETWEEN -180 AND 180"},
    "fare_rules": {"base_rate_positive": "base_rate > 0", "per_km_rate_positive": "per_km_rate > 0",
                   "per_min_rate_positive": "per_min_rate > 0", "surge_at_least_one": "surge_multi >= 1"},
    "promo_codes": {"discount_range": "discount_pct BETWEEN 1 AND 100",
                    "usage_within_limit": "usage_count <= usage_limit",
                    "dates_ordered": "valid_until > valid_from"},
    "wallet": {"balance_not_negative": "balance >= 0"},
    "rides": {"fare_not_negative": "fare >= 0", "distance_positive": "distance > 0",
              "duration_positive": "duration > 0"},
    "payments": {"amount_not_negative": "amount >= 0", "discount_not_negative": "discount_appld >= 0"},
    "driver_earnings": {"gross_not_negative": "gross_amount >= 0",
                        "commission_not_negative": "commission >= 0",
                        "net_not_negative": "net_amount >= 0", "net_within_gross": "net_amount <= gross_amount"},
    "ratings": {"score_range": "score BETWEEN 1 AND 5"},
    "complaints": {"resolved_after_filed": "resolved_at >= filed_at"},
    "ride_history": {"final_fare_not_negative": "final_fare >= 0"},
}

# Pairs of columns that must differ.
# Columns that must differ.
DISTINCT_PAIRS = {
    "rides": ("pickup_location_id", "dropoff_location_id"),
    "ratings": ("rated_by", "rated_user_id"),
    "complaints": ("filed_by", "against_user_id"),
}


def struct(table: str) -> StructType:
    return StructType.fromDDL(COLUMNS[table])


def names(table: str) -> list[str]:
    return struct(table).fieldNames()


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the declared schema; columns the input lacks become NULL, others are dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in struct(table)
    ])


def sort_rank(column: Column | str, words: list[str]) -> Column:
    """Position of a word in its declared list, so it sorts in that order and not by alphabet."""
    return F.array_position(F.array(*[F.lit(w) for w in words]), F.col(column) if isinstance(column, str) else column)
