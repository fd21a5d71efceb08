"""Reference SQL for the jobs, over the derived tables."""

from checks.report_sql import SQL as REPORTS
from checks.quality_sql import (BOOKING, FARE_RULE, PROMO, RATING, REGISTRATION, TOPUP, TRIP, VEHICLE, good, reason)

NOW = "TIMESTAMP '2000-01-01 00:00:00'"
LIVE = "('requested','accepted','driver_en_route','in_progress')"
ZERO = "CAST(0 AS DECIMAL(10,2))"
NULL_TS = "CAST(NULL AS TIMESTAMP)"


def _d(x: str, p: int = 10, s: int = 2) -> str:
    return f"CAST({x} AS DECIMAL({p},{s}))"


FIRST_FORMS = f"FROM raw_trips WHERE {good(TRIP)} QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY submitted_at, trip_id)=1"

RATED = f""", trips AS (SELECT ride_id, CAST(trim(distance) AS DECIMAL(8,2)) AS distance, CAST(trim(duration) AS INTEGER) AS duration
    {FIRST_FORMS}),
  rated AS (SELECT x.*, {_d('round(fare*CAST(0.20 AS DECIMAL(3,2)),2)')} AS commission,
      {_d('fare-round(fare*CAST(0.20 AS DECIMAL(3,2)),2)')} AS net_amount FROM (
    SELECT t.ride_id, r.driver_id, r.rider_id, t.distance, t.duration,
      CAST((coalesce(f.base_rate,CAST(50 AS DECIMAL(8,2)))+coalesce(f.per_km_rate,CAST(20 AS DECIMAL(8,2)))*t.distance
        +coalesce(f.per_min_rate,CAST(2 AS DECIMAL(8,2)))*t.duration)*coalesce(f.surge_multi,CAST(1 AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS fare
    FROM trips t JOIN rides r ON r.ride_id=t.ride_id LEFT JOIN fare_rules f ON f.rule_id=r.rule_id) x)"""

HISTORY = "SELECT ride_id, outcome, final_fare, archived_at FROM history_before"

PRICED = f""", tested AS (SELECT q.*, r.fare, c.promo_id, c.discount_pct,
      CASE WHEN q.pay_method NOT IN ('cash','wallet','card') THEN 'method_invalid' WHEN r.fare IS NULL THEN 'ride_not_payable'
        WHEN p.ride_id IS NOT NULL THEN 'already_paid' WHEN coalesce(q.promo_code,'')<>'' AND c.promo_id IS NULL THEN 'promo_not_usable' END AS why
    FROM payment_requests q LEFT JOIN rides r ON r.ride_id=q.ride_id AND r.rider_id=q.rider_id AND r.fare<>0
    LEFT JOIN payments p ON p.ride_id=q.ride_id AND p.pay_status='paid'
    LEFT JOIN promo_codes c ON lower(c.code)=lower(trim(q.promo_code)) AND c.valid_until > {NOW}),
  ranked AS (SELECT *, why AS reason FROM tested),
  priced AS (SELECT request_id, ride_id, rider_id, pay_method, requested_at, fare, promo_id,
    {_d('coalesce(round(fare*discount_pct*0.01,2),0)')} AS discount, {_d('fare-coalesce(round(fare*discount_pct*0.01,2),0)')} AS total
    FROM ranked WHERE reason IS NULL)"""

# Requests are walked one by one: what is paid, which uses are taken and what is spent so far decide about the next.
SETTLED = PRICED + """, queue AS (SELECT p.*, c.usage_limit-c.usage_count AS room, coalesce(w.balance,-1) AS balance, b.promo_id IS NULL AS takes,
      row_number() OVER (ORDER BY p.requested_at, p.request_id) AS n
    FROM priced p LEFT JOIN promo_codes c ON c.promo_id=p.promo_id LEFT JOIN wallet w ON w.user_id=p.rider_id LEFT JOIN payments b ON b.ride_id=p.ride_id),
  walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS paid, CAST([] AS BIGINT[]) AS uses, CAST([] AS STRUCT(u BIGINT, a DECIMAL(20,2))[]) AS spent,
      CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS why
    UNION ALL SELECT q.n, CASE WHEN s.why IS NULL THEN list_append(k.paid, q.ride_id) ELSE k.paid END,
      CASE WHEN s.why IS NULL AND q.takes AND q.promo_id IS NOT NULL THEN list_append(k.uses, q.promo_id) ELSE k.uses END,
      CASE WHEN s.why IS NULL AND q.pay_method='wallet' THEN list_append(k.spent, {'u': q.rider_id, 'a': CAST(q.total AS DECIMAL(20,2))}) ELSE k.spent END,
      q.request_id, s.why
    FROM walk k JOIN queue q ON q.n=k.n+1, LATERAL (SELECT CASE WHEN list_contains(k.paid, q.ride_id) THEN 'already_paid'
      WHEN q.promo_id IS NOT NULL AND len(list_filter(k.uses, lambda x: x=q.promo_id)) >= q.room THEN 'promo_used_up'
      WHEN q.pay_method='wallet' AND q.total > q.balance-coalesce(list_sum(list_transform(list_filter(k.spent, lambda x: x.u=q.rider_id), lambda x: x.a)),0)
        THEN 'insufficient_balance' END AS why) s),
  settled AS (SELECT q.*, k.why, k.why IS NULL AS ok FROM queue q JOIN walk k ON k.request_id=q.request_id),
  accepted AS (SELECT * FROM settled WHERE ok)"""

ATTEMPTS = """, tested AS (SELECT a.*, v.vehicle_id, CASE WHEN d.driver_id IS NULL THEN 'driver_not_verified' WHEN v.vehicle_id IS NULL THEN 'no_verified_vehicle'
      WHEN r.ride_id IS NULL THEN 'ride_not_requested' END AS why
    FROM accept_attempts a LEFT JOIN drivers d ON d.driver_id=a.driver_id AND d.verify_status='verified'
    LEFT JOIN (SELECT driver_id, min(vehicle_id) AS vehicle_id FROM vehicles WHERE verify_status='verified' GROUP BY driver_id) v ON v.driver_id=a.driver_id
    LEFT JOIN rides r ON r.ride_id=a.ride_id AND r.status='requested'),
  judged AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY ride_id, why IS NULL ORDER BY attempted_at, driver_id) > 1
    THEN 'ride_taken' ELSE why END AS reason FROM tested),
  won AS (SELECT ride_id, driver_id, vehicle_id FROM judged WHERE reason IS NULL)"""

RIDE = ("r.ride_id, r.rider_id, r.driver_id, r.vehicle_id, r.pickup_location_id, r.dropoff_location_id, r.rule_id, r.status, r.fare, "
        "r.distance, r.duration, r.scheduled_at, r.completed_at, r.created_at")

BOOKED = f""", tested AS (SELECT b.*, coalesce({reason(BOOKING)}, CASE WHEN a.rider_id IS NOT NULL THEN 'active_ride' END) AS why
    FROM raw_bookings b LEFT JOIN (SELECT DISTINCT rider_id FROM rides WHERE status IN {LIVE}) a ON a.rider_id=b.rider_id),
  judged AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY rider_id, why IS NULL ORDER BY requested_at, ride_id) > 1
    THEN 'active_ride' ELSE why END AS reason FROM tested),
  booked AS (SELECT j.*, f.rule_id FROM judged j LEFT JOIN fare_rules f ON f.city=trim(j.pickup_city) AND f.vehicle_type=j.vehicle_type WHERE j.reason IS NULL)"""


def _typed_promo() -> str:
    return f"""SELECT *, upper(trim(code)) AS ucode, row_number() OVER (PARTITION BY upper(trim(code)) ORDER BY submitted_at, promo_id) AS rn,
        upper(trim(code)) IN (SELECT upper(code) FROM promo_codes) AS known FROM raw_promos WHERE {good(PROMO)}"""


PLATES = f""", typed AS (SELECT *, upper(trim(license_plate)) AS plate, row_number() OVER (PARTITION BY upper(trim(license_plate)) ORDER BY submitted_at, vehicle_id) AS rn,
      upper(trim(license_plate)) IN (SELECT upper(license_plate) FROM vehicles) AS known FROM raw_vehicles WHERE {good(VEHICLE)})"""

# Forms are walked one by one, so that every form sees exactly what was accepted before it.
REGISTERED = f""", typed AS (SELECT *, row_number() OVER (ORDER BY submitted_at, user_id) AS n FROM (
    SELECT user_id, driver_id, submitted_at, trim(full_name) AS full_name, lower(trim(email)) AS email, trim(phone) AS phone, role,
      CASE WHEN role='driver' THEN trim(cnic) END AS cnic, CASE WHEN role='driver' THEN trim(license_num) END AS license_num
    FROM raw_registrations WHERE {good(REGISTRATION)}) v),
  walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS user_id, false AS ok
    UNION ALL SELECT t.n, CASE WHEN hit.ok THEN list_concat(w.used, ['e'||t.email, 'p'||t.phone, 'c'||coalesce(t.cnic,'-'||t.n), 'l'||coalesce(t.license_num,'-'||t.n)]) ELSE w.used END,
      t.user_id, hit.ok
    FROM walk w JOIN typed t ON t.n=w.n+1,
    LATERAL (SELECT NOT list_has_any(w.used, ['e'||t.email, 'p'||t.phone, 'c'||coalesce(t.cnic,'-'), 'l'||coalesce(t.license_num,'-')])
      AND t.email NOT IN (SELECT lower(email) FROM users) AND t.phone NOT IN (SELECT phone FROM users)
      AND coalesce(t.cnic NOT IN (SELECT cnic FROM drivers), true) AND coalesce(t.license_num NOT IN (SELECT license_num FROM drivers), true) AS ok) hit),
  kept AS (SELECT t.* FROM typed t JOIN walk w ON w.user_id=t.user_id WHERE w.ok)"""

RULES = f""", typed AS (SELECT rule_id, trim(city) AS city, vehicle_type, CAST(trim(base_rate) AS DECIMAL(8,2)) AS base_rate,
      CAST(trim(per_km_rate) AS DECIMAL(8,2)) AS per_km_rate, CAST(trim(per_min_rate) AS DECIMAL(8,2)) AS per_min_rate,
      CAST(coalesce(nullif(TRY_CAST(trim(surge_multi) AS DECIMAL(18,4)),0),1) AS DECIMAL(4,2)) AS surge_multi
    FROM raw_fare_rules WHERE {good(FARE_RULE)}
    QUALIFY row_number() OVER (PARTITION BY lower(trim(city)), vehicle_type ORDER BY submitted_at DESC, rule_id DESC)=1)"""

RATINGS = f""", tested AS (SELECT f.*, d.user_id AS driver_user, r.rider_id, coalesce({reason(RATING)},
      CASE WHEN r.ride_id IS NULL OR (f.rater_role='rider' AND r.rider_id<>f.rated_by) THEN 'not_own_ride'
        WHEN f.rater_role='rider' AND r.status<>'completed' THEN 'ride_not_completed'
        WHEN EXISTS (SELECT 1 FROM ratings g WHERE g.ride_id=f.ride_id AND g.rated_by=f.rated_by) THEN 'already_rated'
        WHEN f.rated_by=f.rated_user_id THEN 'self_rating' END) AS why
    FROM raw_ratings f LEFT JOIN rides r ON r.ride_id=f.ride_id LEFT JOIN drivers d ON d.driver_id=r.driver_id),
  judged AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY ride_id, rated_by, why IS NULL ORDER BY rated_at, rating_id) > 1
    THEN 'already_rated' ELSE why END AS reason FROM tested)"""


# Ride by ride: each takes the best driver who is left, has a vehicle of its type and did not refuse it.
MATCHED = """, waiting AS (SELECT r.ride_id, coalesce(f.vehicle_type,'economy') AS vt, coalesce(x.no, []) AS no, row_number() OVER (ORDER BY r.created_at, r.ride_id) AS n
    FROM rides r LEFT JOIN fare_rules f ON f.rule_id=r.rule_id LEFT JOIN (SELECT ride_id, list(driver_id) AS no FROM rejections GROUP BY ride_id) x ON x.ride_id=r.ride_id
    WHERE r.status='requested' AND r.driver_id IS NULL),
  ready AS (SELECT driver_id, vehicle_type, vehicle_id, dense_rank() OVER (ORDER BY avg_rating DESC, driver_id) AS place FROM (
    SELECT d.driver_id, v.vehicle_type, min(v.vehicle_id) AS vehicle_id, any_value(d.avg_rating) AS avg_rating FROM drivers d
    JOIN vehicles v ON v.driver_id=d.driver_id AND v.verify_status='verified' WHERE d.avail_status='online' AND d.verify_status='verified' GROUP BY ALL) y),
  walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS ride_id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS vt
    UNION ALL SELECT q.n, CASE WHEN b.place IS NULL THEN k.used ELSE list_append(k.used, b.place) END, q.ride_id, b.place, q.vt
    FROM walk k JOIN waiting q ON q.n=k.n+1, LATERAL (SELECT min(place) AS place FROM ready y
      WHERE y.vehicle_type=q.vt AND NOT list_contains(k.used, y.place) AND NOT list_contains(q.no, y.driver_id)) b),
  matched AS (SELECT w.ride_id, y.driver_id, y.vehicle_id FROM walk w JOIN ready y ON y.place=w.place AND y.vehicle_type=w.vt)"""


def _history(extra: str) -> str:
    return f"{HISTORY} UNION ALL SELECT * FROM ({extra}) n WHERE ride_id NOT IN (SELECT ride_id FROM history_before)"


USERS = "user_id, full_name, email, phone, role, acc_status, registration_date"
DRIVER = ("d.driver_id, d.user_id, d.cnic, d.license_num, d.profile_photo, d.verify_status, d.avail_status, d.avg_rating, d.total_trips")
EARN = "earning_id, ride_id, driver_id, gross_amount, commission, net_amount, payout_status, earned_at"
PAY = "payment_id, ride_id, rider_id, promo_id, amount, pay_method, pay_status, discount_appld, transaction_date"
REQ = "request_id, ride_id, rider_id, pay_method, promo_code, requested_at"
ACC = "request_id, ride_id, rider_id, pay_method, requested_at, fare, promo_id, discount, total"

SQL = {
    "rate_fares": RATED + " SELECT ride_id, driver_id, rider_id, distance, duration, fare FROM rated",
    "split_commission": RATED + " SELECT ride_id, driver_id, rider_id, distance, duration, fare, commission, net_amount FROM rated",
    "post_earnings": RATED + f""" SELECT b.earning_id, b.ride_id, b.driver_id, coalesce(n.fare,b.gross_amount) AS gross_amount, coalesce(n.commission,b.commission) AS commission,
        coalesce(n.net_amount,b.net_amount) AS net_amount, b.payout_status, b.earned_at FROM earnings_before b LEFT JOIN rated n ON n.ride_id=b.ride_id
        UNION ALL SELECT ride_id, ride_id, driver_id, fare, commission, net_amount, 'pending', {NOW} FROM rated
        WHERE driver_id IS NOT NULL AND ride_id NOT IN (SELECT ride_id FROM earnings_before)""",
    "open_payments": RATED + f""" SELECT b.payment_id, b.ride_id, b.rider_id, b.promo_id, coalesce(n.fare,b.amount) AS amount, b.pay_method, b.pay_status, b.discount_appld, b.transaction_date
        FROM payments_before b LEFT JOIN rated n ON n.ride_id=b.ride_id
        UNION ALL SELECT ride_id, ride_id, rider_id, NULL, fare, 'cash', 'pending', {ZERO}, {NOW} FROM rated WHERE ride_id NOT IN (SELECT ride_id FROM payments_before)""",
    "credit_wallets": RATED + f""" SELECT w.user_id, {_d('w.balance+coalesce(c.credit,0)')} AS balance, w.last_payout_date, w.payout_status FROM wallet w LEFT JOIN (
        SELECT d.user_id, sum(n.net_amount-coalesce(b.net_amount,0)) AS credit FROM rated n JOIN drivers d ON d.driver_id=n.driver_id
        LEFT JOIN earnings_before b ON b.ride_id=n.ride_id GROUP BY d.user_id) c ON c.user_id=w.user_id""",
    "complete_rides": RATED + f""" SELECT r.ride_id, r.rider_id, r.driver_id, r.vehicle_id, r.pickup_location_id, r.dropoff_location_id, r.rule_id,
        CASE WHEN n.ride_id IS NULL THEN r.status ELSE 'completed' END AS status, coalesce(n.fare,r.fare) AS fare, coalesce(n.distance,r.distance) AS distance,
        coalesce(n.duration,r.duration) AS duration, r.scheduled_at, CASE WHEN n.ride_id IS NULL THEN r.completed_at ELSE {NOW} END AS completed_at, r.created_at
        FROM rides r LEFT JOIN rated n ON n.ride_id=r.ride_id""",
    "complete_rides_drivers": RATED + f""" SELECT d.driver_id, d.user_id, d.cnic, d.license_num, d.profile_photo, d.verify_status,
        CASE WHEN x.driver_id IS NULL THEN d.avail_status ELSE 'online' END AS avail_status, d.avg_rating, CAST(d.total_trips+coalesce(x.n,0) AS BIGINT) AS total_trips
        FROM drivers d LEFT JOIN (SELECT r.driver_id, count(*) FILTER (r.status<>'completed') AS n FROM rated t JOIN rides r ON r.ride_id=t.ride_id GROUP BY r.driver_id) x
        ON x.driver_id=d.driver_id""",
    "complete_rides_ride_history": RATED + " " + _history(f"SELECT ride_id, 'completed', fare, {NOW} FROM rated"),
    "archive_cancelled": _history(f"""SELECT n.ride_id, 'cancelled', coalesce(n.fare,{ZERO}), {NOW} FROM rides n JOIN rides_before o ON o.ride_id=n.ride_id
        WHERE n.status='cancelled' AND o.status<>'cancelled'"""),
    "count_completed_trips": """SELECT d.driver_id, d.user_id, d.cnic, d.license_num, d.profile_photo, d.verify_status, d.avail_status, d.avg_rating,
        count(r.ride_id) AS total_trips FROM drivers d LEFT JOIN rides r ON r.driver_id=d.driver_id AND r.status='completed' GROUP BY ALL""",
    "driver_rating_rollup": """SELECT d.driver_id, d.user_id, d.cnic, d.license_num, d.profile_photo, d.verify_status, d.avail_status,
        CAST(coalesce((SELECT round(sum(score)*1.0000/count(*),2) FROM ratings g WHERE g.rated_user_id=d.user_id),0) AS DECIMAL(3,2)) AS avg_rating, d.total_trips FROM drivers d""",
    "expire_promos": f"""SELECT promo_id, code, discount_pct, CASE WHEN valid_until<{NOW} AND usage_count<usage_limit THEN usage_count ELSE usage_limit END AS usage_limit,
        usage_count, valid_from, valid_until FROM promo_codes""",
    "first_verified_vehicle": "SELECT driver_id, min(vehicle_id) AS vehicle_id FROM vehicles WHERE verify_status='verified' GROUP BY driver_id",
    "match_drivers": MATCHED + " SELECT ride_id, driver_id, vehicle_id FROM matched",
    "toggle_availability": """SELECT d.driver_id, d.user_id, d.cnic, d.license_num, d.profile_photo, d.verify_status,
        CASE WHEN t.n IS NULL THEN d.avail_status WHEN (d.avail_status='online') <> (t.n%2=1) THEN 'online' ELSE 'offline' END AS avail_status, d.avg_rating, d.total_trips
        FROM drivers d LEFT JOIN (SELECT driver_id, count(*) AS n FROM toggles GROUP BY driver_id) t ON t.driver_id=d.driver_id""",
    "wallet_statement": """, moves AS (SELECT user_id, ts, 'topup' AS kind, id, amount FROM topups
        UNION ALL SELECT d.user_id, e.earned_at, 'earning', e.earning_id, e.net_amount FROM driver_earnings e JOIN drivers d ON d.driver_id=e.driver_id
        UNION ALL SELECT rider_id, transaction_date, 'payment', payment_id, -amount FROM payments WHERE pay_method='wallet' AND pay_status='paid'
        UNION ALL SELECT user_id, ts, 'payout', id, -amount FROM payouts)
        SELECT user_id, ts, kind, id, CAST(amount AS DECIMAL(12,2)) AS amount,
        CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, kind, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(20,2)) AS running_balance FROM moves""",
    "apply_promos": PRICED + f" SELECT {ACC} FROM priced",
    "apply_promos_rejected": PRICED + f" SELECT {REQ}, reason FROM ranked WHERE reason IS NOT NULL",
    "redeem_promos_capped": SETTLED + f" SELECT {ACC} FROM accepted",
    "redeem_promos_capped_rejected": SETTLED + f" SELECT {ACC}, why AS reason FROM settled WHERE why='promo_used_up'",
    "redeem_promos_capped_reserved": SETTLED + " SELECT promo_id, count(*) AS uses FROM accepted WHERE promo_id IS NOT NULL AND takes GROUP BY promo_id",
    "settle_payments_promo_codes": SETTLED + """ SELECT c.promo_id, c.code, c.discount_pct, c.usage_limit, CAST(c.usage_count+coalesce(u.n,0) AS BIGINT) AS usage_count,
        c.valid_from, c.valid_until FROM promo_codes c LEFT JOIN (SELECT s.promo_id, count(*) AS n FROM settled s LEFT JOIN payments b ON b.ride_id=s.ride_id
          WHERE s.ok AND s.promo_id IS NOT NULL AND b.promo_id IS NULL GROUP BY s.promo_id) u ON u.promo_id=c.promo_id""",
    "settle_payments": SETTLED + f""" SELECT b.payment_id, b.ride_id, b.rider_id, CASE WHEN s.ride_id IS NULL THEN b.promo_id ELSE s.promo_id END AS promo_id, coalesce(s.total,b.amount) AS amount,
        coalesce(s.pay_method,b.pay_method) AS pay_method, CASE WHEN s.ride_id IS NULL THEN b.pay_status ELSE 'paid' END AS pay_status, coalesce(s.discount,b.discount_appld) AS discount_appld,
        CASE WHEN s.ride_id IS NULL THEN b.transaction_date ELSE {NOW} END AS transaction_date FROM payments b LEFT JOIN settled s ON s.ride_id=b.ride_id AND s.ok
        UNION ALL SELECT ride_id, ride_id, rider_id, promo_id, total, pay_method, 'paid', discount, {NOW} FROM settled WHERE ok AND ride_id NOT IN (SELECT ride_id FROM payments)""",
    "settle_payments_wallet": SETTLED + f""" SELECT w.user_id, {_d('w.balance-coalesce(s.spent,0)')} AS balance, w.last_payout_date, w.payout_status FROM wallet w
        LEFT JOIN (SELECT rider_id, sum(total) AS spent FROM settled WHERE ok AND pay_method='wallet' GROUP BY rider_id) s ON s.rider_id=w.user_id""",
    "settle_payments_rejected": SETTLED + f" SELECT {ACC}, why AS reason FROM settled WHERE why<>'promo_used_up'",
    "pay_rides_rejected": SETTLED + """ SELECT r.request_id, CASE WHEN r.reason='promo_not_usable' AND (a.requested_at, a.request_id) < (r.requested_at, r.request_id)
        THEN 'already_paid' ELSE r.reason END AS reason FROM ranked r LEFT JOIN accepted a ON a.ride_id=r.ride_id WHERE r.reason IS NOT NULL
        UNION ALL SELECT request_id, why FROM settled WHERE NOT ok""",
    "on_payment_paid": f""", fresh AS (SELECT n.ride_id FROM payments n LEFT JOIN payments_before o ON o.ride_id=n.ride_id WHERE n.pay_status='paid' AND coalesce(o.pay_status,'')<>'paid')
        SELECT r.ride_id, r.rider_id, r.driver_id, r.vehicle_id, r.pickup_location_id, r.dropoff_location_id, r.rule_id, CASE WHEN f.ride_id IS NULL THEN r.status ELSE 'completed' END AS status,
        r.fare, r.distance, r.duration, r.scheduled_at, CASE WHEN f.ride_id IS NULL THEN r.completed_at ELSE {NOW} END AS completed_at, r.created_at
        FROM rides_before r LEFT JOIN fresh f ON f.ride_id=r.ride_id AND r.status NOT IN ('completed','cancelled')""",
    "on_payment_paid_ride_history": _history(f"""SELECT r.ride_id, 'completed', coalesce(r.fare,{ZERO}), {NOW} FROM rides_before r JOIN payments n ON n.ride_id=r.ride_id
        LEFT JOIN payments_before o ON o.ride_id=n.ride_id WHERE n.pay_status='paid' AND coalesce(o.pay_status,'')<>'paid' AND r.status<>'cancelled'"""),
    "flag_low_rated": """SELECT u.user_id, u.full_name, u.email, u.phone, u.role, CASE WHEN d.user_id IS NULL THEN u.acc_status ELSE 'suspended' END AS acc_status, u.registration_date
        FROM users u LEFT JOIN drivers d ON d.user_id=u.user_id AND d.avg_rating>0 AND d.avg_rating<3.5""",
    "flag_low_rated_admin_notifications": f"""SELECT CAST(epoch({NOW}) AS BIGINT)*4294967296+u.user_id AS notification_id, 'low_rating_flag' AS type, 'ALERT: Driver "'||u.full_name||'" (driver_id='||d.driver_id||') has been auto-suspended. Average rating dropped to '
        ||d.avg_rating||' (below 3.5). Please review.' AS message, u.user_id AS related_user_id, false AS is_read, {NOW} AS created_at
        FROM drivers d JOIN users u ON u.user_id=d.user_id WHERE d.avg_rating>0 AND d.avg_rating<3.5""",
    "accept_rides": ATTEMPTS + """ SELECT r.ride_id, r.rider_id, coalesce(w.driver_id,r.driver_id) AS driver_id, coalesce(w.vehicle_id,r.vehicle_id) AS vehicle_id, r.pickup_location_id,
        r.dropoff_location_id, r.rule_id, CASE WHEN w.ride_id IS NULL THEN r.status ELSE 'accepted' END AS status, r.fare, r.distance, r.duration, r.scheduled_at, r.completed_at, r.created_at
        FROM rides r LEFT JOIN won w ON w.ride_id=r.ride_id""",
    "accept_rides_drivers": ATTEMPTS + """ SELECT d.driver_id, d.user_id, d.cnic, d.license_num, d.profile_photo, d.verify_status,
        CASE WHEN d.driver_id IN (SELECT driver_id FROM won) THEN 'on_trip' ELSE d.avail_status END AS avail_status, d.avg_rating, d.total_trips FROM drivers d""",
    "accept_rides_rejected": ATTEMPTS + " SELECT ride_id, driver_id, attempted_at, reason FROM judged WHERE reason IS NOT NULL",
    "advance_status": f"""SELECT r.ride_id, r.rider_id, r.driver_id, r.vehicle_id, r.pickup_location_id, r.dropoff_location_id, r.rule_id, coalesce(s.new_status,r.status) AS status, r.fare, r.distance,
        r.duration, r.scheduled_at, r.completed_at, r.created_at FROM rides_before r LEFT JOIN (SELECT ride_id, new_status FROM status_changes WHERE new_status IN ('driver_en_route','in_progress')
        QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY changed_at DESC, change_id DESC)=1) s ON s.ride_id=r.ride_id""",
    "advance_status_illegal": """, steps AS (SELECT * FROM (VALUES ('requested',1),('accepted',2),('driver_en_route',3),('in_progress',4),('completed',5)) AS v(status,pos)),
        moves AS (SELECT c.*, coalesce(lag(c.new_status) OVER (PARTITION BY c.ride_id ORDER BY c.changed_at, c.change_id), r.status) AS old_status
          FROM status_changes c JOIN rides_before r ON r.ride_id=c.ride_id WHERE c.new_status IN ('driver_en_route','in_progress'))
        SELECT m.change_id, m.ride_id, m.old_status, m.new_status, m.changed_at, 'out_of_order' AS reason FROM moves m LEFT JOIN steps o ON o.status=m.old_status
        LEFT JOIN steps n ON n.status=m.new_status WHERE n.pos<>coalesce(o.pos,0)+1
        UNION ALL SELECT c.change_id, c.ride_id, r.status, c.new_status, c.changed_at, 'status_not_allowed' FROM status_changes c JOIN rides_before r ON r.ride_id=c.ride_id
        WHERE c.new_status NOT IN ('driver_en_route','in_progress')""",
    "book_rides": BOOKED + f""" SELECT {RIDE} FROM rides r UNION ALL SELECT ride_id, rider_id, NULL, NULL, ride_id*2, ride_id*2+1, rule_id, 'requested', NULL, NULL, NULL,
        TRY_CAST(scheduled_at AS TIMESTAMP), NULL, requested_at FROM booked""",
    "book_rides_locations": BOOKED + """ SELECT ride_id*2 AS location_id, CAST(coalesce(pickup_lat,'0') AS DECIMAL(10,7)) AS latitude, CAST(coalesce(pickup_lon,'0') AS DECIMAL(10,7)) AS longitude,
        trim(pickup_address) AS address, trim(pickup_city) AS city FROM booked UNION ALL SELECT ride_id*2+1, CAST(coalesce(dropoff_lat,'0') AS DECIMAL(10,7)),
        CAST(coalesce(dropoff_lon,'0') AS DECIMAL(10,7)), trim(dropoff_address), trim(dropoff_city) FROM booked""",
    "book_rides_rejected": BOOKED + " SELECT ride_id, rider_id, reason FROM judged WHERE reason IS NOT NULL",
    "register_users": REGISTERED + f" SELECT {USERS} FROM users UNION ALL SELECT user_id, full_name, email, phone, role, 'active', {NOW} FROM kept",
    "register_users_drivers": REGISTERED + f""" SELECT {DRIVER} FROM drivers d UNION ALL SELECT driver_id, user_id, cnic, license_num, NULL, 'pending', 'offline', CAST(0 AS DECIMAL(3,2)), CAST(0 AS BIGINT)
        FROM kept WHERE role='driver'""",
    "register_users_wallet": REGISTERED + f" SELECT user_id, {ZERO} AS balance, {NULL_TS} AS last_payout_date, 'none' AS payout_status FROM kept",
    "register_users_rejected": REGISTERED + f""" SELECT user_id, {reason(REGISTRATION)} AS reason FROM raw_registrations WHERE NOT ({good(REGISTRATION)})
        UNION ALL SELECT user_id, 'already_registered' FROM typed WHERE user_id NOT IN (SELECT user_id FROM kept)""",
    "add_vehicles": PLATES + """ SELECT vehicle_id, driver_id, make, model, year, color, license_plate, vehicle_type, verify_status FROM vehicles
        UNION ALL SELECT vehicle_id, driver_id, trim(make), trim(model), CAST(year AS INTEGER), trim(color), plate, vehicle_type, 'pending' FROM typed WHERE rn=1 AND NOT known""",
    "add_vehicles_rejected": PLATES + f""" SELECT *, {reason(VEHICLE)} AS reason FROM raw_vehicles WHERE NOT ({good(VEHICLE)})
        UNION ALL SELECT * EXCLUDE (plate, rn, known), 'plate_exists' FROM typed WHERE rn>1 OR known""",
    "upsert_fare_rules": RULES + """ SELECT f.rule_id, f.city, f.vehicle_type, coalesce(t.base_rate,f.base_rate) AS base_rate, coalesce(t.per_km_rate,f.per_km_rate) AS per_km_rate,
        coalesce(t.per_min_rate,f.per_min_rate) AS per_min_rate, coalesce(t.surge_multi,f.surge_multi) AS surge_multi
        FROM fare_rules f LEFT JOIN typed t ON lower(t.city)=lower(f.city) AND t.vehicle_type=f.vehicle_type
        UNION ALL SELECT rule_id, city, vehicle_type, base_rate, per_km_rate, per_min_rate, surge_multi FROM typed t
        WHERE NOT EXISTS (SELECT 1 FROM fare_rules f WHERE lower(t.city)=lower(f.city) AND t.vehicle_type=f.vehicle_type)""",
    "upsert_fare_rules_rejected": f"SELECT *, {reason(FARE_RULE)} AS reason FROM raw_fare_rules WHERE NOT ({good(FARE_RULE)})",
    "create_promos": f""", typed AS ({_typed_promo()}) SELECT promo_id, code, discount_pct, usage_limit, usage_count, valid_from, valid_until FROM promo_codes
        UNION ALL SELECT promo_id, ucode, CAST(discount_pct AS DECIMAL(5,2)), CAST(usage_limit AS BIGINT), CAST(0 AS BIGINT), CAST(valid_from AS TIMESTAMP), CAST(valid_until AS TIMESTAMP)
        FROM typed WHERE rn=1 AND NOT known""",
    "create_promos_rejected": f""", typed AS ({_typed_promo()}) SELECT *, {reason(PROMO)} AS reason FROM raw_promos WHERE NOT ({good(PROMO)})
        UNION ALL SELECT * EXCLUDE (ucode, rn, known), 'code_exists' FROM typed WHERE rn>1 OR known""",
    "top_up_wallets": f"""SELECT w.user_id, {_d('w.balance+coalesce(a.added,0)')} AS balance, w.last_payout_date, w.payout_status FROM wallet w LEFT JOIN (
        SELECT user_id, sum(CAST(amount AS DECIMAL(18,4))) AS added FROM raw_topups WHERE {good(TOPUP)} GROUP BY user_id) a ON a.user_id=w.user_id""",
    "top_up_wallets_rejected": f"SELECT *, {reason(TOPUP)} AS reason FROM raw_topups WHERE NOT ({good(TOPUP)})",
    "request_payouts": f"""SELECT user_id, balance, CASE WHEN balance<=0 THEN last_payout_date ELSE {NOW} END AS last_payout_date,
        CASE WHEN balance<=0 THEN payout_status ELSE 'pending' END AS payout_status FROM wallet""",
    "request_payouts_rejected": "SELECT user_id, 'no_balance' AS reason FROM wallet WHERE balance<=0",
    "approve_payouts": f"""SELECT earning_id, ride_id, driver_id, gross_amount, commission, net_amount, CASE WHEN driver_id%2=0 THEN 'paid' ELSE payout_status END AS payout_status, earned_at
        FROM driver_earnings""",
    "approve_payouts_wallet": f"""SELECT w.user_id, CASE WHEN d.user_id IS NULL THEN w.balance ELSE {ZERO} END AS balance, CASE WHEN d.user_id IS NULL THEN w.last_payout_date ELSE {NOW} END AS last_payout_date,
        CASE WHEN d.user_id IS NULL THEN w.payout_status ELSE 'completed' END AS payout_status FROM wallet w LEFT JOIN drivers d ON d.user_id=w.user_id AND d.driver_id%2=0""",
    "approve_payouts_differences": """SELECT d.driver_id, d.user_id, w.balance, CAST(coalesce(e.s,0) AS DECIMAL(20,2)) AS pending_total, CAST(w.balance-coalesce(e.s,0) AS DECIMAL(20,2)) AS difference
        FROM drivers d JOIN wallet w ON w.user_id=d.user_id LEFT JOIN (SELECT driver_id, sum(net_amount) AS s FROM driver_earnings WHERE payout_status='pending' GROUP BY driver_id) e
        ON e.driver_id=d.driver_id WHERE d.driver_id%2=0""",
    "accept_ratings": RATINGS + """ SELECT rating_id, ride_id, rated_by, rated_user_id, rater_role, score, comment, rated_at FROM ratings
        UNION ALL SELECT rating_id, ride_id, rated_by, rated_user_id, rater_role, CAST(score AS INTEGER), nullif(trim(comment),''), rated_at FROM judged WHERE reason IS NULL""",
    "accept_ratings_accepted": RATINGS + """ SELECT rating_id, ride_id, rated_by, rated_user_id,
        NOT coalesce(rated_user_id=CASE WHEN rater_role='rider' THEN driver_user ELSE rider_id END, false) AS target_mismatch FROM judged WHERE reason IS NULL""",
    "accept_ratings_rejected": RATINGS + " SELECT rating_id, ride_id, rated_by, reason FROM judged WHERE reason IS NOT NULL",
    "apply_status_changes": """SELECT u.user_id, u.full_name, u.email, u.phone, u.role, coalesce(c.new_status,u.acc_status) AS acc_status, u.registration_date FROM users u LEFT JOIN (
        SELECT user_id, new_status FROM account_changes WHERE new_status IN ('active','suspended','banned')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC, change_id DESC)=1) c ON c.user_id=u.user_id""",
    "apply_status_changes_rejected": "SELECT *, 'status_not_allowed' AS reason FROM account_changes WHERE new_status NOT IN ('active','suspended','banned')",
    "review_vehicles": """SELECT v.vehicle_id, v.driver_id, v.make, v.model, v.year, v.color, v.license_plate, v.vehicle_type, CASE WHEN c.new_status IN ('pending','verified','rejected')
        THEN c.new_status ELSE v.verify_status END AS verify_status FROM vehicles v LEFT JOIN review_changes c ON c.vehicle_id=v.vehicle_id""",
    "review_vehicles_rejected": "SELECT *, 'status_not_allowed' AS reason FROM review_changes WHERE coalesce(new_status,'lost')='lost'",
}

# Every rating that takes a running mean below the limit; ``{ratings}`` is where they come from.
ALERTS = """, running AS (SELECT rated_user_id, rating_id, rated_at, CAST(sum(score) OVER w AS BIGINT) AS score_sum, count(*) OVER w AS n
      FROM {ratings} g WINDOW w AS (PARTITION BY rated_user_id ORDER BY rated_at, rating_id ROWS UNBOUNDED PRECEDING)),
    means AS (SELECT *, CAST(round(score_sum*1.0000/n,2) AS DECIMAL(3,2)) AS mean FROM running)
    SELECT rated_user_id, rating_id, rated_at, score_sum, n, mean FROM means
    QUALIFY mean<3.5 AND coalesce(lag(mean) OVER (PARTITION BY rated_user_id ORDER BY rated_at, rating_id)>=3.5, true)"""


def _timely(table: str, key: str, time: str, delay: str, lots: int = 4) -> str:
    """The events of a table sent in lots by key, with the watermark that the earlier lots have set."""
    return f"""(SELECT e.*, m.seen - INTERVAL {delay} AS passed FROM (SELECT DISTINCT * FROM {table}) e LEFT JOIN
        (SELECT k, max({time}) FILTER (lot < k) AS seen FROM (SELECT {key}%{lots} AS lot, {time} FROM {table}) x, range({lots}) r(k) GROUP BY k) m ON m.k={key}%{lots})"""


TRIP_LOTS = _timely("trip_events", "trip_id", "submitted_at", "4 MINUTE")
RATING_LOTS = _timely("rating_events", "rating_id", "rated_at", "400 DAY")
ON_TIME = f"(SELECT * EXCLUDE (passed) FROM {RATING_LOTS} y WHERE passed IS NULL OR rated_at > passed)"

SQL.update({
    "stream_rate_fares": SQL["split_commission"],
    "stream_rate_forms": SQL["split_commission"],
    "stream_timely_fares": SQL["split_commission"].replace("FROM raw_trips WHERE", f"FROM {TRIP_LOTS} y WHERE (passed IS NULL OR submitted_at > passed) AND"),
    "stream_late_forms": f"SELECT trip_id, submitted_at, ride_id, distance, duration FROM {TRIP_LOTS} y WHERE submitted_at <= passed",
    "stream_driver_ratings": """SELECT rated_user_id, CAST(sum(score) AS BIGINT) AS score_sum, count(*) AS n,
        CAST(round(sum(score)*1.0000/count(*),2) AS DECIMAL(3,2)) AS mean, round(sum(score)*1.0000/count(*),2) < 3.5 AS low FROM ratings GROUP BY rated_user_id""",
    "stream_rating_alerts": ALERTS.format(ratings="ratings"),
    "stream_rating_alerts_by_year": ALERTS.format(ratings="ratings"),
    "stream_timely_alerts": ALERTS.format(ratings=ON_TIME),
    "stream_late_ratings": f"SELECT rating_id, rated_user_id, score, rated_at FROM {RATING_LOTS} y WHERE rated_at <= passed",
    "stream_ride_closures": f"""SELECT ride_id, status AS outcome, coalesce(fare,{ZERO}) AS final_fare, {NOW} AS archived_at FROM rides r
        WHERE ride_id NOT IN (SELECT ride_id FROM history_before) AND (status='cancelled' OR
          (status='completed' AND EXISTS (SELECT 1 FROM payments p WHERE p.ride_id=r.ride_id AND p.pay_status='paid')))""",
    "stream_trip_counts": """SELECT driver_id, count(*) AS total_trips FROM rides WHERE status='completed' AND driver_id IS NOT NULL GROUP BY driver_id""",
})

SQL.update({
    "complete_rides_rejected": f"""SELECT *, {reason(TRIP)} AS reason FROM raw_trips WHERE NOT ({good(TRIP)}) UNION ALL
        SELECT *, 'repeated_form' FROM (SELECT * FROM raw_trips WHERE {good(TRIP)} QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY submitted_at, trip_id)>1)""",
    "load_tables": "SELECT r.ride_id, l.city, r.fare, r.created_at FROM rides r JOIN locations l ON l.location_id=r.pickup_location_id",
    "append": f"SELECT {RIDE} FROM rides r",
    "upsert": f"""SELECT b.payment_id, b.ride_id, b.rider_id, p.promo_id, b.amount, b.pay_method, p.pay_status, b.discount_appld, b.transaction_date
        FROM payments_before b JOIN payments p ON p.ride_id=b.ride_id UNION ALL SELECT {PAY} FROM payments WHERE ride_id NOT IN (SELECT ride_id FROM payments_before)""",
    "insert_ignore": _history(f"""SELECT ride_id, 'completed', {ZERO}, happened_at FROM closure_events
        QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY happened_at, event_id)=1"""),
    "update_where": f"""SELECT user_id, balance, CASE WHEN balance<500 THEN {NOW} ELSE last_payout_date END AS last_payout_date,
        CASE WHEN balance<500 THEN 'none' ELSE payout_status END AS payout_status FROM wallet""",
    "update_join": """SELECT v.vehicle_id, v.driver_id, v.make, v.model, v.year, v.color, v.license_plate, v.vehicle_type,
        coalesce(d.verify_status,v.verify_status) AS verify_status FROM vehicles v LEFT JOIN drivers d ON d.driver_id=v.driver_id AND d.verify_status<>'verified'""",
    "ids_of_inserted": "SELECT email, CAST(0 AS INTEGER) AS balance, user_id FROM users",
    "assign_drivers": MATCHED + """ SELECT r.ride_id, r.rider_id, coalesce(o.driver_id,r.driver_id) AS driver_id, coalesce(o.vehicle_id,r.vehicle_id) AS vehicle_id, r.pickup_location_id,
        r.dropoff_location_id, r.rule_id, r.status, r.fare, r.distance, r.duration, r.scheduled_at, r.completed_at, r.created_at FROM rides r LEFT JOIN matched o ON o.ride_id=r.ride_id""",
})

# Tables laid out by month and daily sums give what whole tables give.
SQL.update({
    "upsert_by_month": f"""SELECT b.payment_id, b.ride_id, b.rider_id, CASE WHEN p.ride_id IS NULL THEN b.promo_id ELSE p.promo_id END AS promo_id, b.amount, b.pay_method,
        coalesce(p.pay_status, b.pay_status) AS pay_status, b.discount_appld, coalesce(p.transaction_date + INTERVAL 40 DAY, b.transaction_date) AS transaction_date
        FROM payments_before b LEFT JOIN (SELECT * FROM payments WHERE ride_id%200<3) p ON p.ride_id=b.ride_id
        UNION ALL SELECT payment_id, ride_id, rider_id, promo_id, amount, pay_method, pay_status, discount_appld, transaction_date + INTERVAL 40 DAY
        FROM payments WHERE ride_id%200<3 AND ride_id NOT IN (SELECT ride_id FROM payments_before)""",
    "insert_ignore_by_month": SQL["insert_ignore"],
    "update_where_by_month": """SELECT earning_id, ride_id, driver_id, gross_amount, commission, net_amount,
        CASE WHEN earned_at BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-04-15' THEN 'paid' ELSE payout_status END AS payout_status, earned_at FROM driver_earnings""",
    "update_join_by_month": f"""SELECT r.ride_id, r.rider_id, r.driver_id, r.vehicle_id, r.pickup_location_id, r.dropoff_location_id, r.rule_id,
        CASE WHEN p.ride_id IS NULL THEN r.status ELSE 'cancelled' END AS status, {_d('r.fare-coalesce(p.amount,0)')} AS fare, r.distance, r.duration,
        r.scheduled_at, r.completed_at, r.created_at FROM rides r LEFT JOIN payments p ON p.ride_id=r.ride_id AND p.pay_status='refunded'""",
    "recent_rides_by_month": f"SELECT {RIDE} FROM rides r ORDER BY r.created_at DESC, r.ride_id DESC LIMIT 10",
    "daily_revenue_in_range": REPORTS["revenue_in_range"],
    "daily_refunds_in_range": REPORTS["refunds_in_range"],
    "daily_revenue_per_city": REPORTS["revenue_per_city"],
    "daily_revenue_by_method": REPORTS["revenue_by_method"],
})

for _name in ("stream_rate_fares_rejected", "stream_rate_forms_rejected"):
    SQL[_name] = f"SELECT trip_id, ride_id, distance, duration, reason FROM ({SQL['complete_rides_rejected']}) x"
