"""Reference SQL for the checks, over the derived tables."""

NOW = "TIMESTAMP '2000-01-01 00:00:00'"
TYPES = "('economy','premium','bike')"


def _form(table: str, key: str, rules: list[tuple[str, str]]) -> str:
    """Key, first broken rule and all broken rules; a rule that is unknown counts as kept."""
    cases = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules)
    return f"""SELECT {key}, es[1] AS first_error, array_to_string(es, ',') AS errors FROM (
        SELECT {key}, list_filter([{cases}], lambda e: e IS NOT NULL) AS es FROM {table})"""


def _short(col: str, n: int) -> str:
    return f"length(trim(coalesce({col},''))) < {n}"


def _num(col: str) -> str:
    return f"TRY_CAST(trim({col}) AS DECIMAL(18,4))"


def _int(col: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({col}), '[+-]?[0-9]+') THEN TRY_CAST(trim({col}) AS BIGINT) END"


REGISTRATION = [
    ("full_name_too_short", _short("full_name", 3)),
    ("email_invalid", r"NOT coalesce(regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+'), false)"),
    ("phone_invalid", r"NOT coalesce(regexp_full_match(regexp_replace(phone, '[-\s]', '', 'g'), '03[0-9]{9}'), false)"),
    ("role_invalid", "NOT coalesce(role IN ('rider','driver'), false)"),
    ("cnic_invalid", "role='driver' AND NOT (regexp_full_match(cnic, '[0-9]{5}-[0-9]{7}-[0-9]') OR regexp_full_match(replace(cnic,'-',''), '[0-9]{13}'))"),
    ("license_too_short", f"role='driver' AND {_short('license_num', 5)}"),
]
BOOKING = [
    ("pickup_address_too_short", _short("pickup_address", 3)), ("pickup_city_too_short", _short("pickup_city", 2)),
    ("dropoff_address_too_short", _short("dropoff_address", 3)), ("dropoff_city_too_short", _short("dropoff_city", 2)),
    ("ends_identical", "lower(trim(pickup_address))=lower(trim(dropoff_address)) AND lower(trim(pickup_city))=lower(trim(dropoff_city))"),
    ("vehicle_type_invalid", f"NOT coalesce(vehicle_type IN {TYPES}, false)"),
    ("schedule_not_in_future", f"TRY_CAST(scheduled_at AS TIMESTAMP) <= {NOW}"),
]
TRIP = [
    ("distance_not_positive", f"coalesce({_num('distance')} <= 0, true)"), ("distance_too_long", f"{_num('distance')} > 500"),
    ("duration_not_positive", f"coalesce(({_int('duration')}) <= 0, true)"), ("duration_too_long", f"({_int('duration')}) > 600"),
]
VEHICLE = [
    ("make_too_short", _short("make", 2)), ("model_missing", _short("model", 1)),
    ("year_out_of_range", f"coalesce(({_int('year')}) NOT BETWEEN 2000 AND 2000, true)"), ("color_too_short", _short("color", 2)),
    ("plate_too_short", _short("license_plate", 4)), ("vehicle_type_invalid", f"vehicle_type NOT IN {TYPES}"),
]
TOPUP = [
    ("amount_invalid", f"{_num('amount')} IS NULL"), ("amount_too_small", f"{_num('amount')} < 100"),
    ("amount_too_large", f"{_num('amount')} > 50000"),
]
FARE_RULE = [
    ("city_too_short", _short("city", 2)), ("vehicle_type_invalid", f"vehicle_type NOT IN {TYPES}"),
    ("base_rate_not_positive", f"coalesce({_num('base_rate')} <= 0, true)"),
    ("per_km_rate_not_positive", f"coalesce({_num('per_km_rate')} <= 0, true)"),
    ("per_min_rate_not_positive", f"coalesce({_num('per_min_rate')} <= 0, true)"), ("surge_below_one", f"{_num('surge_multi')} < 1"),
]
PROMO = [
    ("code_too_short", _short("code", 3)), ("code_not_alphanumeric", "NOT regexp_full_match(trim(code), '[A-Za-z0-9]+')"),
    ("discount_out_of_range", f"coalesce({_num('discount_pct')} NOT BETWEEN 1 AND 100, true)"),
    ("usage_limit_below_one", f"coalesce(({_int('usage_limit')}) < 1, true)"),
    ("valid_from_missing", "coalesce(valid_from,'')=''"), ("valid_until_missing", "coalesce(valid_until,'')=''"),
    ("dates_not_ordered", "TRY_CAST(valid_until AS TIMESTAMP) <= TRY_CAST(valid_from AS TIMESTAMP)"),
]
RATING = [
    ("score_out_of_range", f"coalesce(({_int('score')}) NOT BETWEEN 1 AND 5, true)"), ("target_missing", "rated_user_id IS NULL"),
]
PLATE = [("plate_format", r"NOT regexp_full_match(regexp_replace(upper(license_plate), '\s', '-', 'g'), '[A-Z]{2,4}[-\s]?[0-9]{3,4}')")]


def good(rules: list[tuple[str, str]]) -> str:
    """Condition for a form without errors."""
    return " AND ".join(f"NOT coalesce({bad}, false)" for _, bad in rules)


def reason(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {bad} THEN '{code}'" for code, bad in rules) + " END"


PLACE = ("pickup_location_id", "locations", "location_id"), ("dropoff_location_id", "locations", "location_id")
RIDE, USER, DRV = ("ride_id", "rides", "ride_id"), ("user_id", "users", "user_id"), ("driver_id", "drivers", "driver_id")
#: Table, its key, and (column, parent, parent's key) of its links.
LINKS = [
    ("rides", "ride_id", [("rider_id", "users", "user_id"), DRV, ("vehicle_id", "vehicles", "vehicle_id"), *PLACE, ("rule_id", "fare_rules", "rule_id")]),
    ("drivers", "driver_id", [USER]), ("wallet", "user_id", [USER]), ("vehicles", "vehicle_id", [DRV]),
    ("payments", "payment_id", [RIDE, ("rider_id", "users", "user_id"), ("promo_id", "promo_codes", "promo_id")]),
    ("driver_earnings", "earning_id", [RIDE, DRV]), ("ride_history", "ride_id", [RIDE]),
    ("ratings", "rating_id", [RIDE, ("rated_by", "users", "user_id"), ("rated_user_id", "users", "user_id")]),
    ("complaints", "complaint_id", [RIDE, ("filed_by", "users", "user_id"), ("against_user_id", "users", "user_id")]),
    ("admin_notifications", "notification_id", [("related_user_id", "users", "user_id")]),
]


def _source(table: str) -> str:
    return table if table == "complaints" else f"dirty_{table}"


def _rule(table: str, key: str, source: str, name: str, bad: str) -> str:
    return f"SELECT '{table}' AS \"table\", '{name}' AS rule, CAST({key} AS VARCHAR) AS key FROM {source} WHERE {bad}"


#: Table, key, columns that must be there, and (rule, what breaks it) for the others.
ROWS = [
    ("rides", "ride_id", "ride_id rider_id pickup_location_id dropoff_location_id status created_at", [
        ("status_unknown", "status NOT IN ('requested','accepted','driver_en_route','in_progress','completed','cancelled')"),
        ("fare_not_negative", "fare < 0"), ("distance_positive", "distance <= 0"), ("duration_positive", "duration <= 0")]),
    ("complaints", "complaint_id", "complaint_id ride_id filed_by against_user_id subject description status filed_at", [
        ("status_unknown", "status NOT IN ('open','under_review','resolved','dismissed')"), ("subject_too_long", "length(subject) > 200"),
        ("resolved_after_filed", "resolved_at < filed_at")]),
    ("users", "user_id", "user_id full_name email phone role acc_status registration_date", [
        ("role_unknown", "role NOT IN ('super_admin','admin','rider','driver')"), ("acc_status_unknown", "acc_status NOT IN ('active','suspended','banned')"),
        ("full_name_too_long", "length(full_name) > 100"), ("email_too_long", "length(email) > 150"), ("phone_too_long", "length(phone) > 20")]),
    ("drivers", "driver_id", "driver_id user_id cnic license_num verify_status avail_status avg_rating total_trips", [
        ("verify_status_unknown", "verify_status NOT IN ('pending','verified','rejected')"), ("avail_status_unknown", "avail_status NOT IN ('online','offline','on_trip')"),
        ("avg_rating_range", "avg_rating > 5 OR avg_rating < 0"), ("cnic_too_long", "length(cnic) > 20")]),
    ("vehicles", "vehicle_id", "vehicle_id driver_id make model year color license_plate vehicle_type verify_status", [
        ("vehicle_type_unknown", "vehicle_type NOT IN ('economy','premium','bike')"), ("verify_status_unknown", "verify_status NOT IN ('pending','verified','rejected')"),
        ("year_from_2000", "year < 2000"), ("model_too_long", "length(model) > 50")]),
    ("locations", "location_id", "location_id latitude longitude city", [
        ("latitude_range", "abs(latitude) > 90"), ("longitude_range", "abs(longitude) > 180"), ("address_too_long", "length(address) > 300")]),
    ("fare_rules", "rule_id", "rule_id city vehicle_type base_rate per_km_rate per_min_rate surge_multi", [
        ("vehicle_type_unknown", "vehicle_type NOT IN ('economy','premium','bike')"), ("base_rate_positive", "base_rate <= 0"),
        ("per_km_rate_positive", "per_km_rate <= 0"), ("per_min_rate_positive", "per_min_rate <= 0"), ("surge_at_least_one", "surge_multi < 1")]),
    ("promo_codes", "promo_id", "promo_id code discount_pct usage_limit usage_count valid_from valid_until", [
        ("discount_range", "discount_pct < 1 OR discount_pct > 100"), ("usage_within_limit", "usage_count > usage_limit"), ("dates_ordered", "valid_until <= valid_from")]),
    ("wallet", "user_id", "user_id balance payout_status", [
        ("payout_status_unknown", "payout_status NOT IN ('none','pending','completed')"), ("balance_not_negative", "balance < 0")]),
    ("payments", "payment_id", "payment_id ride_id rider_id amount pay_method pay_status discount_appld transaction_date", [
        ("pay_method_unknown", "pay_method NOT IN ('cash','wallet','card')"), ("pay_status_unknown", "pay_status NOT IN ('pending','paid','failed','refunded')"),
        ("amount_not_negative", "amount < 0"), ("discount_not_negative", "discount_appld < 0")]),
    ("driver_earnings", "earning_id", "earning_id ride_id driver_id gross_amount commission net_amount payout_status earned_at", [
        ("payout_status_unknown", "payout_status NOT IN ('pending','paid')"), ("gross_not_negative", "gross_amount < 0"), ("commission_not_negative", "commission < 0"),
        ("net_not_negative", "net_amount < 0"), ("net_within_gross", "net_amount > gross_amount")]),
    ("ratings", "rating_id", "rating_id ride_id rated_by rated_user_id rater_role score rated_at", [
        ("rater_role_unknown", "rater_role NOT IN ('rider','driver')"), ("score_range", "score < 1 OR score > 5")]),
    ("admin_notifications", "notification_id", "notification_id type message is_read created_at", [("type_too_long", "length(type) > 50")]),
    ("ride_history", "ride_id", "ride_id outcome final_fare archived_at", [
        ("outcome_unknown", "outcome NOT IN ('completed','cancelled')"), ("final_fare_not_negative", "final_fare < 0")]),
]


def _constraints() -> str:
    return " UNION ALL ".join(_rule(t, key, _source(t), name, bad) for t, key, needed, rules in ROWS
                              for name, bad in [*((f"{c}_missing", f"{c} IS NULL") for c in needed.split()), *rules])


def _deletes() -> str:
    def part(table, key, column, action, source):
        return f"SELECT '{table}' AS \"table\", CAST({key} AS VARCHAR) AS key, '{column}' AS \"column\", '{action}' AS action FROM {source}"
    u, d, v = ("(SELECT user_id FROM gu)", "(SELECT driver_id FROM gd)", "(SELECT vehicle_id FROM gv)")
    parts = [
        part("users", "user_id", "user_id", "delete", "gu"), part("drivers", "driver_id", "driver_id", "delete", "gd"),
        part("vehicles", "vehicle_id", "vehicle_id", "delete", "gv"),
        part("wallet", "user_id", "user_id", "delete", f"wallet WHERE user_id IN {u}"),
        part("rides", "ride_id", "rider_id", "blocked", f"rides WHERE rider_id IN {u}"),
        part("rides", "ride_id", "driver_id", "set_null", f"rides WHERE driver_id IN {d}"),
        part("rides", "ride_id", "vehicle_id", "set_null", f"rides WHERE vehicle_id IN {v}"),
        part("payments", "payment_id", "rider_id", "blocked", f"payments WHERE rider_id IN {u}"),
        part("driver_earnings", "earning_id", "driver_id", "blocked", f"driver_earnings WHERE driver_id IN {d}"),
        part("ratings", "rating_id", "rated_by", "blocked", f"ratings WHERE rated_by IN {u}"),
        part("ratings", "rating_id", "rated_user_id", "blocked", f"ratings WHERE rated_user_id IN {u}"),
        part("complaints", "complaint_id", "filed_by", "blocked", f"complaints WHERE filed_by IN {u}"),
        part("complaints", "complaint_id", "against_user_id", "blocked", f"complaints WHERE against_user_id IN {u}"),
        part("admin_notifications", "notification_id", "related_user_id", "set_null", f"admin_notifications WHERE related_user_id IN {u}"),
    ]
    return (", gu AS (SELECT user_id FROM users WHERE user_id IN (SELECT user_id FROM leavers)), "
            "gd AS (SELECT driver_id FROM drivers WHERE user_id IN (SELECT user_id FROM gu)), "
            "gv AS (SELECT vehicle_id FROM vehicles WHERE driver_id IN (SELECT driver_id FROM gd)) " + " UNION ALL ".join(parts))


def _repeats(table: str, *keys: str) -> str:
    """Values held by several rows; text keys in lower case without trailing blanks."""
    texts = {"email", "phone", "cnic", "license_num", "license_plate", "code", "city"}
    folds = ", ".join(f"lower(rtrim({k}))" if k in texts else k for k in keys)
    shown = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    there = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (f"SELECT '{table}' AS \"table\", '{'_'.join(keys)}_repeated' AS rule, min({shown}) AS key, CAST(count(*) AS BIGINT) AS \"rows\" "
            f"FROM {_source(table)} WHERE {there} GROUP BY {folds} HAVING count(*) > 1")


#: Keys beside the first column of each table.
UNIQUE = [("users", "email"), ("users", "phone"), ("drivers", "user_id"), ("drivers", "cnic"), ("drivers", "license_num"), ("vehicles", "license_plate"),
          ("fare_rules", "city", "vehicle_type"), ("promo_codes", "code"), ("payments", "ride_id"), ("driver_earnings", "ride_id"),
          ("ratings", "ride_id", "rated_by")]


def _emptied(table: str, key: str, column: str, keys: str) -> str:
    return f"SELECT '{table}' AS \"table\", CAST({key} AS VARCHAR) AS key, '{column}' AS \"column\", 'set_null' AS action FROM {table} WHERE {column} IN ({keys})"


def _gone(table: str, column: str, keys: str, key: str = "") -> str:
    return f"SELECT '{table}' AS \"table\", CAST({key or column} AS VARCHAR) AS key, '{key or column}' AS \"column\", 'delete' AS action FROM {table} WHERE {column} IN ({keys})"


SQL = {
    "check_registration": _form("raw_registrations", "user_id", REGISTRATION),
    "check_booking": _form("raw_bookings", "ride_id", BOOKING),
    "check_trip_completion": _form("raw_trips", "trip_id", TRIP),
    "check_vehicle": _form("raw_vehicles", "vehicle_id", VEHICLE),
    "check_topup": _form("raw_topups", "request_id", TOPUP),
    "check_fare_rule": _form("raw_fare_rules", "rule_id", FARE_RULE),
    "check_promo": _form("raw_promos", "promo_id", PROMO),
    "check_rating": _form("raw_ratings", "rating_id", RATING),
    "check_plate_format": _form("raw_vehicles", "vehicle_id", PLATE),
    "check_constraints": _constraints(),
    "check_unique": " UNION ALL ".join([_repeats(t, key) for t, key, *_ in ROWS] + [_repeats(*u) for u in UNIQUE]),
    "check_foreign_keys": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{col}_unknown' AS rule, CAST({key} AS VARCHAR) AS key FROM {_source(t)} x "
        f"WHERE {col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk}=x.{col})" for t, key, links in LINKS for col, p, pk in links),
    "check_not_self": " UNION ALL ".join(
        _rule(t, key, _source(t), f"{a}_equals_{b}", f"{a}={b}") for t, key, a, b in (
            ("rides", "ride_id", "pickup_location_id", "dropoff_location_id"), ("ratings", "rating_id", "rated_by", "rated_user_id"),
            ("complaints", "complaint_id", "filed_by", "against_user_id"))),
    "propagate_delete_drivers": " UNION ALL ".join([
        _gone("drivers", "driver_id", (GD := "SELECT driver_id FROM leaving_drivers")), _gone("vehicles", "driver_id", GD, "vehicle_id"),
        _emptied("rides", "ride_id", "driver_id", GD),
        _emptied("rides", "ride_id", "vehicle_id", f"SELECT vehicle_id FROM vehicles WHERE driver_id IN ({GD})"),
        f"SELECT 'driver_earnings', CAST(earning_id AS VARCHAR), 'driver_id', 'blocked' FROM driver_earnings WHERE driver_id IN ({GD})"]),
    "propagate_delete_promo_codes": " UNION ALL ".join([
        _gone("promo_codes", "promo_id", "SELECT promo_id FROM ended_codes"), _emptied("payments", "payment_id", "promo_id", "SELECT promo_id FROM ended_codes")]),
    "propagate_delete_fare_rules": " UNION ALL ".join([
        _gone("fare_rules", "rule_id", "SELECT rule_id FROM ended_rules"), _emptied("rides", "ride_id", "rule_id", "SELECT rule_id FROM ended_rules")]),
    "propagate_delete": _deletes(),
}
