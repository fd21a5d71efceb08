"""Marketplace tables and job inputs derived from the star-schema test tables.

customers act as riders and places, suppliers as drivers, parts as vehicles, nations as cities, orders as
rides. The statements below run unchanged on Spark and on the engine the results are checked against, use
integer-key arithmetic only, and damage some rows by key so that every check has something to find.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from cabledger import schema
from cabledger.session import shared_dir

AS_OF = "2000-01-01 00:00:00"
STAR = ["region", "nation", "customer", "supplier", "part", "orders"]

NS = "(SELECT count(*) FROM supplier)"
NC = "(SELECT count(*) FROM customer)"


def _typed(n: int, kind: str) -> str:
    return (f"SELECT CAST(n_nationkey*3+{n}+1 AS BIGINT) AS rule_id, n_name AS city, '{kind}' AS vehicle_type, "
            f"CAST(40+n_nationkey+30*{n} AS DECIMAL(8,2)) AS base_rate, "
            f"CAST(15+5*{n}+(n_nationkey%4) AS DECIMAL(8,2)) AS per_km_rate, "
            f"CAST(1+{n} AS DECIMAL(8,2)) AS per_min_rate, "
            "CAST(CAST(100+25*(n_nationkey%3) AS DECIMAL(4,0))*CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(4,2)) AS surge_multi "
            "FROM nation WHERE n_nationkey%5<>4")


STEPS: dict[str, str] = {}

STEPS["locations"] = """
SELECT CAST(c_custkey+1 AS BIGINT) AS location_id,
  CAST((c_custkey*7919)%181-90 AS DECIMAL(10,7)) AS latitude,
  CAST((c_custkey*6007)%361-180 AS DECIMAL(10,7)) AS longitude, c_name AS address, n_name AS city
FROM customer JOIN nation ON c_nationkey=n_nationkey"""

STEPS["fare_rules"] = " UNION ALL ".join(_typed(n, k) for n, k in enumerate(["bike", "economy", "premium"]))

STEPS["promo_codes"] = """
SELECT CAST(p_partkey+1 AS BIGINT) AS promo_id, concat('PROMO',CAST(p_partkey+1 AS STRING)) AS code,
  CAST(5*(p_partkey%20+1) AS DECIMAL(5,2)) AS discount_pct, CAST(10*(p_partkey%10+1) AS BIGINT) AS usage_limit,
  CAST(p_partkey%10+1 AS BIGINT) AS usage_count, TIMESTAMP '1995-01-01 00:00:00' AS valid_from,
  CASE WHEN p_partkey%2=1 THEN TIMESTAMP '1998-01-01 00:00:00' ELSE TIMESTAMP '2001-06-01 00:00:00' END AS valid_until
FROM part WHERE p_partkey%20=0 OR p_partkey<10"""

STEPS["vehicles"] = f"""
SELECT CAST(p_partkey+1 AS BIGINT) AS vehicle_id, CAST(p_partkey%{NS}+1 AS BIGINT) AS driver_id, p_brand AS make,
  p_name AS model, CAST(2000+p_size%25 AS INT) AS year, 'white' AS color,
  concat('LEA-',CAST(1000+p_partkey AS STRING)) AS license_plate,
  CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN 'economy' WHEN p_type IN ('PROMO','LARGE') THEN 'premium' ELSE 'bike' END AS vehicle_type,
  CASE p_partkey%3 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' ELSE 'rejected' END AS verify_status
FROM part WHERE (p_partkey%{NS}+1)%10<>7"""

STEPS["rides"] = f"""
SELECT ride_id, rider_id, CASE WHEN status='requested' THEN NULL ELSE drv END AS driver_id,
  CASE WHEN status='requested' OR drv%10=7 THEN NULL ELSE drv END AS vehicle_id, pickup_location_id,
  dropoff_location_id, rule_id, status,
  CASE WHEN status='completed' THEN CAST((coalesce(base_rate,CAST('50.00' AS DECIMAL(8,2)))+coalesce(per_km_rate,CAST('20.00' AS DECIMAL(8,2)))*dist0
    +coalesce(per_min_rate,CAST('2.00' AS DECIMAL(8,2)))*dur0)*coalesce(surge_multi,CAST('1.00' AS DECIMAL(4,2))) AS DECIMAL(10,2)) END AS fare,
  CASE WHEN status='completed' THEN dist0 END AS distance, CASE WHEN status='completed' THEN dur0 END AS duration,
  CAST(NULL AS TIMESTAMP) AS scheduled_at,
  CASE WHEN status='completed' THEN created_at + INTERVAL '1' MINUTE * dur0 END AS completed_at, created_at
FROM (SELECT CAST(o_orderkey+1 AS BIGINT) AS ride_id, CAST(o_custkey+1 AS BIGINT) AS rider_id,
  CASE WHEN o_orderstatus='P' AND o_orderkey%4=0 THEN 'requested' WHEN o_orderstatus='P' AND o_orderkey%4=1 THEN 'accepted'
       WHEN o_orderstatus='P' AND o_orderkey%4=2 THEN 'driver_en_route' WHEN o_orderstatus='P' THEN 'in_progress'
       WHEN o_orderstatus='O' AND o_orderkey%5=0 THEN 'cancelled' ELSE 'completed' END AS status,
  CAST((o_orderkey*13+o_custkey)%{NS}+1 AS BIGINT) AS drv,
  CAST(o_custkey+1 AS BIGINT) AS pickup_location_id, CAST((o_custkey+1)%{NC}+1 AS BIGINT) AS dropoff_location_id,
  CAST(CAST((o_orderkey*37)%4999+1 AS DECIMAL(8,0))*CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(8,2)) AS dist0,
  CAST((o_orderkey*17)%119+1 AS INT) AS dur0,
  CASE o_orderkey%3 WHEN 0 THEN 'bike' WHEN 1 THEN 'economy' ELSE 'premium' END AS vt, o_orderdate AS created_at
  FROM orders) r
JOIN (SELECT location_id, city AS pickup_city FROM locations) l ON r.pickup_location_id=l.location_id
LEFT JOIN fare_rules f ON f.city=l.pickup_city AND f.vehicle_type=r.vt"""

STEPS["payments"] = """
SELECT ride_id AS payment_id, ride_id, rider_id, promo_id, CAST(fare-off AS DECIMAL(10,2)) AS amount,
  CASE ride_id%4 WHEN 0 THEN 'cash' WHEN 1 THEN 'wallet' ELSE 'card' END AS pay_method, pay_status,
  off AS discount_appld, created_at AS transaction_date
FROM (SELECT q.*, CASE WHEN promo_id IS NOT NULL AND pay_status='paid'
    THEN CAST(round(fare*CAST(5*promo_id AS DECIMAL(5,2))*CAST('0.01' AS DECIMAL(3,2)),2) AS DECIMAL(10,2))
    ELSE CAST('0.00' AS DECIMAL(10,2)) END AS off
  FROM (SELECT rides.*, CASE WHEN ride_id%3=0 THEN CAST(ride_id%10+1 AS BIGINT) END AS promo_id,
    CASE WHEN o_orderpriority='1-URGENT' THEN 'pending' WHEN o_orderpriority='5-LOW' AND ride_id%4=0 THEN 'refunded'
         WHEN o_orderpriority='5-LOW' AND ride_id%4=1 THEN 'failed' ELSE 'paid' END AS pay_status
    FROM rides JOIN orders ON o_orderkey=ride_id-1 WHERE status='completed') q) p"""

STEPS["driver_earnings"] = """
SELECT ride_id AS earning_id, ride_id, driver_id, fare AS gross_amount, commission,
  CAST(fare-commission AS DECIMAL(10,2)) AS net_amount, CASE WHEN ride_id%4=0 THEN 'pending' ELSE 'paid' END AS payout_status,
  created_at AS earned_at
FROM (SELECT rides.*, CAST(round(fare*CAST('0.20' AS DECIMAL(3,2)),2) AS DECIMAL(10,2)) AS commission
  FROM rides WHERE status='completed') r"""

STEPS["ratings"] = """
SELECT ride_id AS rating_id, ride_id, rider_id AS rated_by, CAST(1000000+driver_id AS BIGINT) AS rated_user_id,
  'rider' AS rater_role,
  CAST(CASE WHEN driver_id%10=0 THEN 1+ride_id%3 WHEN driver_id%10=1 THEN 5-CASE WHEN ride_id%5=0 THEN 1 ELSE 0 END ELSE 3+ride_id%3 END AS INT) AS score,
  CAST(NULL AS STRING) AS comment, created_at AS rated_at
FROM rides WHERE status='completed' AND ride_id%2=0 AND driver_id%10<>5"""

STEPS["drivers"] = """
SELECT CAST(s_suppkey+1 AS BIGINT) AS driver_id, CAST(1000001+s_suppkey AS BIGINT) AS user_id,
  concat('42201-',lpad(CAST(s_suppkey AS STRING),7,'0'),'-1') AS cnic, concat('LIC-',lpad(CAST(s_suppkey AS STRING),6,'0')) AS license_num,
  CAST(NULL AS STRING) AS profile_photo,
  CASE WHEN s_suppkey%7=3 THEN 'pending' WHEN s_suppkey%11=5 THEN 'rejected' ELSE 'verified' END AS verify_status,
  CASE s_suppkey%3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'on_trip' END AS avail_status,
  CAST(coalesce(a.v,0) AS DECIMAL(3,2)) AS avg_rating, CAST(coalesce(t.n,0) AS BIGINT) AS total_trips
FROM supplier LEFT JOIN (SELECT driver_id, count(*) AS n FROM rides WHERE status='completed' GROUP BY driver_id) t ON t.driver_id=s_suppkey+1
LEFT JOIN (SELECT rated_user_id, round(CAST(sum(score) AS DECIMAL(18,0))*CAST('1.0000' AS DECIMAL(5,4))/count(*),2) AS v FROM ratings GROUP BY rated_user_id) a
  ON a.rated_user_id=1000001+s_suppkey"""

STEPS["users"] = """
SELECT user_id, full_name, email, phone, role, 'active' AS acc_status, TIMESTAMP '1995-01-01 00:00:00' AS registration_date FROM (
  SELECT CAST(c_custkey+1 AS BIGINT) AS user_id, c_name AS full_name, concat('c',CAST(c_custkey AS STRING),'@example.com') AS email,
    CASE WHEN c_custkey%50=0 THEN concat('12',lpad(CAST(c_custkey AS STRING),7,'0')) ELSE concat('03',lpad(CAST(c_custkey AS STRING),9,'0')) END AS phone,
    'rider' AS role FROM customer
  UNION ALL SELECT CAST(1000001+s_suppkey AS BIGINT), s_name, concat('s',CAST(s_suppkey AS STRING),'@example.com'), concat('031',lpad(CAST(s_suppkey AS STRING),8,'0')), 'driver' FROM supplier
  UNION ALL SELECT CAST(2000001+n_nationkey AS BIGINT), concat('Idle ',n_name), concat('n',CAST(n_nationkey AS STRING),'@example.com'), concat('032',lpad(CAST(n_nationkey AS STRING),8,'0')), 'rider' FROM nation
  UNION ALL SELECT CAST(3000001 AS BIGINT), 'Admin User', 'admin@example.com', '03300000000', 'admin') u"""

STEPS["wallet"] = """
SELECT CAST(1000001+s_suppkey AS BIGINT) AS user_id, coalesce(e.net,CAST('0.00' AS DECIMAL(10,2))) AS balance,
  CAST(NULL AS TIMESTAMP) AS last_payout_date,
  CASE s_suppkey%3 WHEN 0 THEN 'none' WHEN 1 THEN 'pending' ELSE 'completed' END AS payout_status
FROM supplier LEFT JOIN (SELECT driver_id, CAST(sum(net_amount) AS DECIMAL(10,2)) AS net FROM driver_earnings
  WHERE payout_status='pending' GROUP BY driver_id) e ON e.driver_id=s_suppkey+1
UNION ALL SELECT CAST(c_custkey+1 AS BIGINT), CAST((c_custkey*97)%3000 AS DECIMAL(10,2)), CAST(NULL AS TIMESTAMP), 'none' FROM customer"""

STEPS["ride_history"] = """
SELECT ride_id, status AS outcome, coalesce(fare,CAST('0.00' AS DECIMAL(10,2))) AS final_fare, created_at AS archived_at
FROM rides WHERE status IN ('completed','cancelled')"""


# Form inputs: text fields as sent in, with one kind of damage per remainder of the key.
STEPS["raw_bookings"] = """
SELECT CAST(10000000+c_custkey AS BIGINT) AS ride_id, CAST(c_custkey+1 AS BIGINT) AS rider_id,
  CASE WHEN c_custkey%50=1 THEN ' a ' ELSE concat('Street ',CAST(c_custkey AS STRING)) END AS pickup_address,
  CASE WHEN c_custkey%50=2 THEN NULL ELSE n_name END AS pickup_city,
  CASE WHEN c_custkey%50=3 THEN '' WHEN c_custkey%50=5 THEN concat('STREET ',CAST(c_custkey AS STRING)) ELSE concat('Road ',CAST(c_custkey AS STRING)) END AS dropoff_address,
  CASE WHEN c_custkey%50=4 THEN 'x' ELSE n_name END AS dropoff_city,
  CAST(NULL AS STRING) AS pickup_lat, CAST(NULL AS STRING) AS pickup_lon, '24.5' AS dropoff_lat, '67.25' AS dropoff_lon,
  CASE WHEN c_custkey%50=6 THEN 'boat' WHEN c_custkey%3=0 THEN 'bike' WHEN c_custkey%3=1 THEN 'economy' ELSE 'premium' END AS vehicle_type,
  CASE WHEN c_custkey%50=7 THEN '1999-01-01 00:00:00' WHEN c_custkey%50=8 THEN '2000-01-02 00:00:00' END AS scheduled_at,
  TIMESTAMP '2000-01-01 00:00:00' AS requested_at
FROM customer JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT CAST(20000000+n_nationkey*3+copy AS BIGINT), CAST(2000001+n_nationkey AS BIGINT), 'Airport', n_name, 'Harbour', n_name,
  '1.5', '2.5', CAST(NULL AS STRING), CAST(NULL AS STRING), 'economy', CAST(NULL AS STRING), TIMESTAMP '2000-01-01 00:00:00'
FROM (SELECT n_nationkey, n_name, 0 AS copy FROM nation UNION ALL SELECT n_nationkey, n_name, 1 FROM nation WHERE n_nationkey%2=0) idle"""

STEPS["payment_requests"] = """
SELECT CAST(ride_id*2+copy AS BIGINT) AS request_id, ride_id,
  CASE WHEN ride_id%50=2 THEN rider_id+1 ELSE rider_id END AS rider_id,
  CASE WHEN ride_id%50=1 THEN 'barter' WHEN ride_id%16=8 AND copy=2 THEN 'cash' WHEN ride_id%2=0 THEN 'wallet' WHEN ride_id%4=1 THEN 'cash' ELSE 'card' END AS pay_method,
  CASE WHEN ride_id%50=3 THEN 'NOSUCH' WHEN ride_id%3=0 THEN concat('promo',CAST(ride_id%10+1 AS STRING))
    WHEN ride_id%3=1 THEN concat('Promo',CAST(1+2*(ride_id%7%3) AS STRING),' ') WHEN ride_id%7=0 THEN '' END AS promo_code,
  CAST(created_at + INTERVAL '1' MINUTE * CAST((ride_id*31+copy*copy*ride_id)%1440 AS INT) AS TIMESTAMP) AS requested_at
FROM (SELECT rides.*, 1 AS copy FROM rides UNION ALL SELECT rides.*, 2 FROM rides WHERE ride_id%8=0) r"""


STEPS["raw_registrations"] = """
SELECT CAST(5000000+k AS BIGINT) AS user_id, CAST(5000000+k AS BIGINT) AS driver_id,
  TIMESTAMP '1999-12-01 00:00:00' + INTERVAL '1' MINUTE * CAST(k%40000 AS INT) AS submitted_at,
  CASE k%50 WHEN 1 THEN ' Al ' ELSE concat(' ',c_name) END AS full_name,
  CASE k%50 WHEN 2 THEN 'bad mail' WHEN 3 THEN concat('C',CAST(k AS STRING),'@Example.com') WHEN 11 THEN concat('NEW',CAST(k-1 AS STRING),'@example.com')
    WHEN 13 THEN concat('new',CAST(k-1 AS STRING),'@example.com') WHEN 20 THEN concat('new',CAST(k AS STRING),'@example.com',chr(10)) ELSE concat('new',CAST(k AS STRING),'@example.com') END AS email,
  CASE k%50 WHEN 5 THEN '12345' WHEN 6 THEN concat('03',lpad(CAST(k+1 AS STRING),9,'0')) WHEN 12 THEN concat('034',lpad(CAST(k-1 AS STRING),8,'0'))
    WHEN 18 THEN NULL WHEN 19 THEN concat('034-',lpad(CAST(k AS STRING),8,'0')) ELSE concat('034',lpad(CAST(k AS STRING),8,'0')) END AS phone,
  CASE WHEN k%50=17 THEN 'admin' WHEN k%3=0 THEN 'driver' ELSE 'rider' END AS role,
  CASE k%50 WHEN 14 THEN '123' WHEN 16 THEN '42201-0000001-1' ELSE concat('52201-',lpad(CAST(k AS STRING),7,'0'),'-1') END AS cnic,
  CASE k%50 WHEN 15 THEN ' ab ' ELSE concat('NEW-',lpad(CAST(k AS STRING),6,'0')) END AS license_num
FROM (SELECT c_custkey AS k, c_name FROM customer) f"""

STEPS["raw_trips"] = """
SELECT CAST(ride_id*2+copy AS BIGINT) AS trip_id, TIMESTAMP '1999-12-01 00:00:00' + INTERVAL '1' MINUTE * CAST(30+ride_id%7-copy*(ride_id%11) AS INT) AS submitted_at,
  ride_id, CASE ride_id%50 WHEN 1 THEN '0' WHEN 2 THEN '501' WHEN 3 THEN 'abc' WHEN 8 THEN NULL ELSE CAST(CAST((ride_id*7%3000+10) AS DECIMAL(8,0))*CAST('0.01' AS DECIMAL(3,2)) AS STRING) END AS distance,
  CASE ride_id%50 WHEN 4 THEN '' WHEN 6 THEN '601' WHEN 7 THEN '-5' WHEN 3 THEN '0' ELSE CAST((ride_id+copy*7)%90+1 AS STRING) END AS duration
FROM (SELECT rides.*, 0 AS copy FROM rides UNION ALL SELECT rides.*, 1 FROM rides WHERE ride_id%4=1) f
WHERE status IN ('accepted','driver_en_route','in_progress') OR (status='completed' AND ride_id%5=0)"""

STEPS["raw_vehicles"] = f"""
SELECT CAST(7000000+k AS BIGINT) AS vehicle_id, CAST(k%{NS}+1 AS BIGINT) AS driver_id,
  TIMESTAMP '1999-12-01 00:00:00' + INTERVAL '1' MINUTE * CAST(k%40000 AS INT) AS submitted_at,
  CASE k%50 WHEN 1 THEN 'X' ELSE p_brand END AS make, CASE k%50 WHEN 2 THEN ' ' ELSE p_name END AS model,
  CASE k%50 WHEN 3 THEN '1999' WHEN 4 THEN '2001' WHEN 10 THEN 'new' ELSE '2000' END AS year, CASE k%50 WHEN 5 THEN '' ELSE 'blue' END AS color,
  CASE k%50 WHEN 6 THEN 'AB1' WHEN 8 THEN concat('lea-',CAST(1001+k AS STRING)) WHEN 9 THEN concat('KHI-',CAST(999+k AS STRING),' ')
    WHEN 11 THEN concat('khi-',CAST(1010+k AS STRING)) ELSE concat(' khi-',CAST(1000+k AS STRING)) END AS license_plate,
  CASE WHEN k%50=7 THEN 'truck' WHEN k%2=0 THEN 'economy' ELSE 'bike' END AS vehicle_type
FROM (SELECT p_partkey AS k, p_brand, p_name FROM part) f"""

STEPS["raw_topups"] = """
SELECT CAST(c_custkey*2+copy AS BIGINT) AS request_id, CAST(c_custkey+1 AS BIGINT) AS user_id,
  CASE (c_custkey+copy)%50 WHEN 1 THEN '99.99' WHEN 2 THEN '50000.01' WHEN 3 THEN 'abc' WHEN 4 THEN NULL WHEN 5 THEN '50000' WHEN 6 THEN '100'
    ELSE CAST(100+(c_custkey*37)%500 AS STRING) END AS amount, TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(c_custkey%1440+copy AS INT) AS requested_at
FROM (SELECT c_custkey, 0 AS copy FROM customer UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey%3=0) f"""

STEPS["raw_fare_rules"] = """
SELECT CAST(9000000+k AS BIGINT) AS rule_id, TIMESTAMP '1999-12-01 00:00:00' + INTERVAL '1' MINUTE * CAST(k%40000 AS INT) AS submitted_at,
  CASE WHEN k%50=1 THEN ' x ' WHEN k%4=0 THEN lower(n_name) ELSE concat(n_name,' ') END AS city,
  CASE WHEN k%50=2 THEN 'boat' WHEN k%3=0 THEN 'bike' WHEN k%3=1 THEN 'economy' ELSE 'premium' END AS vehicle_type,
  CASE k%50 WHEN 3 THEN '0' ELSE CAST(50+k%7 AS STRING) END AS base_rate, CASE k%50 WHEN 4 THEN '-1' ELSE '17.5' END AS per_km_rate,
  CASE k%50 WHEN 5 THEN '' ELSE '2.25' END AS per_min_rate,
  CASE k%50 WHEN 6 THEN '0.5' WHEN 7 THEN '' WHEN 8 THEN 'abc' WHEN 9 THEN NULL ELSE '1.25' END AS surge_multi
FROM (SELECT s_suppkey AS k, n_name FROM supplier JOIN nation ON s_nationkey=n_nationkey) f"""

STEPS["raw_promos"] = """
SELECT CAST(8000000+k AS BIGINT) AS promo_id, TIMESTAMP '1999-12-01 00:00:00' + INTERVAL '1' MINUTE * CAST(k%40000 AS INT) AS submitted_at,
  CASE k%50 WHEN 1 THEN 'ab' WHEN 2 THEN 'BAD CODE' WHEN 9 THEN ' promo1 ' WHEN 10 THEN concat('NEW',CAST(k+1 AS STRING)) ELSE concat('new',CAST(k AS STRING)) END AS code,
  CASE k%50 WHEN 3 THEN '0' WHEN 4 THEN '100.5' WHEN 12 THEN '100' ELSE CAST(k%90+1 AS STRING) END AS discount_pct,
  CASE k%50 WHEN 5 THEN '0' WHEN 13 THEN '' ELSE CAST(k%200+1 AS STRING) END AS usage_limit,
  CASE k%50 WHEN 6 THEN NULL ELSE '2000-01-01 00:00:00' END AS valid_from,
  CASE k%50 WHEN 7 THEN '' WHEN 8 THEN '1999-01-01 00:00:00' WHEN 14 THEN '2000-01-01 00:00:00' ELSE '2001-01-01 00:00:00' END AS valid_until
FROM (SELECT p_partkey AS k FROM part) f"""

STEPS["raw_ratings"] = """
SELECT CAST(30000000+ride_id*4+kind AS BIGINT) AS rating_id, ride_id,
  CASE WHEN kind=2 THEN 1000000+driver_id WHEN ride_id%50=1 THEN rider_id+1 ELSE rider_id END AS rated_by,
  CASE WHEN kind=2 THEN rider_id WHEN ride_id%50=4 THEN NULL WHEN ride_id%50=5 THEN rider_id WHEN ride_id%50=6 THEN 1000001 ELSE 1000000+driver_id END AS rated_user_id,
  CASE WHEN kind=2 THEN 'driver' ELSE 'rider' END AS rater_role,
  CASE ride_id%50 WHEN 2 THEN '6' WHEN 3 THEN 'x' WHEN 7 THEN '' ELSE CAST(ride_id%5+1 AS STRING) END AS score,
  CASE WHEN ride_id%3=0 THEN ' ok ' END AS comment, created_at + INTERVAL '1' MINUTE * CAST(100-kind AS INT) AS rated_at
FROM (SELECT rides.*, 0 AS kind FROM rides UNION ALL SELECT rides.*, 1 FROM rides WHERE ride_id%7=0
  UNION ALL SELECT rides.*, 2 FROM rides WHERE driver_id IS NOT NULL AND ride_id%4=1) f"""

STEPS["accept_attempts"] = f"""
SELECT ride_id, CAST((ride_id*13+try*try*7+try)%{NS}+1 AS BIGINT) AS driver_id,
  created_at + INTERVAL '1' MINUTE * CAST((ride_id*7+try*5)%13 AS INT) AS attempted_at
FROM (SELECT rides.*, 0 AS try FROM rides UNION ALL SELECT rides.*, 1 FROM rides UNION ALL SELECT rides.*, 2 FROM rides) f
WHERE status='requested' OR (status='accepted' AND ride_id%3=0)"""

STEPS["rejections"] = f"""
SELECT ride_id, CAST((ride_id*13)%{NS}+1 AS BIGINT) AS driver_id FROM rides WHERE status='requested' AND ride_id%2=1"""

STEPS["rides_before"] = """
SELECT ride_id, rider_id, driver_id, vehicle_id, pickup_location_id, dropoff_location_id, rule_id,
  CASE WHEN status IN ('driver_en_route','in_progress','completed','cancelled') AND ride_id%10<>3 THEN 'accepted' ELSE status END AS status,
  fare, distance, duration, scheduled_at, completed_at, created_at FROM rides"""

STEPS["status_changes"] = """
SELECT CAST(ride_id*4+step AS BIGINT) AS change_id, ride_id,
  CASE step WHEN 0 THEN 'driver_en_route' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'driver_en_route' END AS new_status,
  created_at + INTERVAL '1' MINUTE * CAST(step*10+1 AS INT) AS changed_at
FROM (SELECT ride_id, status, created_at, 0 AS step FROM rides WHERE ride_id%9<>0 UNION ALL SELECT ride_id, status, created_at, 1 FROM rides WHERE status<>'driver_en_route'
  UNION ALL SELECT ride_id, status, created_at, 2 FROM rides WHERE ride_id%11=0 UNION ALL SELECT ride_id, status, created_at, 3 FROM rides WHERE ride_id%13=0) f
WHERE status IN ('driver_en_route','in_progress','completed')"""

STEPS["payments_before"] = """
SELECT payment_id, ride_id, rider_id, promo_id, amount, pay_method, CASE WHEN ride_id%2=0 THEN 'pending' ELSE pay_status END AS pay_status,
  discount_appld, transaction_date FROM payments WHERE ride_id%10<>3"""

STEPS["history_before"] = "SELECT ride_id, outcome, final_fare, archived_at FROM ride_history WHERE ride_id%3=0"

STEPS["earnings_before"] = """
SELECT earning_id, ride_id, driver_id, gross_amount, commission, net_amount, payout_status, earned_at FROM driver_earnings WHERE ride_id%10=0"""

STEPS["account_changes"] = """
SELECT CAST(c_custkey*2+copy AS BIGINT) AS change_id, CAST(c_custkey+1 AS BIGINT) AS user_id,
  CASE WHEN c_custkey%10=copy THEN 'deleted' WHEN c_custkey%3=copy THEN 'banned' WHEN c_custkey%3=1 THEN 'suspended' ELSE 'active' END AS new_status,
  TIMESTAMP '1999-12-01 00:00:00' + INTERVAL '1' MINUTE * CAST((c_custkey*7+copy*11)%60 AS INT) AS changed_at
FROM (SELECT c_custkey, 0 AS copy FROM customer UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey%2=0) f"""

STEPS["review_changes"] = """
SELECT vehicle_id*2 AS change_id, vehicle_id, CASE vehicle_id%4 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'lost' ELSE NULL END AS new_status,
  TIMESTAMP '1999-12-01 00:00:00' AS changed_at FROM vehicles"""

STEPS["toggles"] = "SELECT driver_id, completed_at AS toggled_at FROM rides WHERE status='completed' AND ride_id%3=0"

STEPS["topups"] = """
SELECT request_id AS id, user_id, requested_at AS ts, CAST(amount AS DECIMAL(12,2)) AS amount FROM raw_topups
WHERE request_id%3=0 AND amount IS NOT NULL AND amount<>'abc'"""

STEPS["payouts"] = """
SELECT driver_id AS id, user_id, TIMESTAMP '1999-12-01 00:00:00' AS ts, CAST(100+driver_id%50 AS DECIMAL(12,2)) AS amount FROM drivers"""

STEPS["complaints"] = """
SELECT ride_id AS complaint_id, ride_id, rider_id AS filed_by, CASE WHEN ride_id%50=10 THEN rider_id ELSE 1000000+driver_id END AS against_user_id,
  'Late' AS subject, CASE WHEN ride_id%50=40 THEN NULL ELSE 'Came late' END AS description, CASE WHEN ride_id%50=30 THEN 'lost' ELSE 'open' END AS status,
  created_at AS filed_at, CASE WHEN ride_id%50=20 THEN created_at - INTERVAL '1' DAY WHEN ride_id%20=0 THEN created_at + INTERVAL '2' DAY END AS resolved_at
FROM rides WHERE status='completed' AND ride_id%10=0"""

STEPS["admin_notifications"] = """
SELECT CAST(946684800 AS BIGINT)*4294967296+d.user_id AS notification_id, 'low_rating_flag' AS type, concat('Rated low: ',u.full_name) AS message,
  d.user_id AS related_user_id, false AS is_read, TIMESTAMP '2000-01-01 00:00:00' AS created_at
FROM drivers d JOIN users u ON u.user_id=d.user_id WHERE d.avg_rating>0 AND d.avg_rating<3.5
UNION ALL SELECT user_id, 'notice', concat('Hello ',full_name), CASE WHEN user_id%4<>0 THEN user_id END, user_id%2=0, registration_date FROM users WHERE user_id%3=1"""

# Tables with broken constraints.
STEPS["dirty_rides"] = """
SELECT ride_id, CASE ride_id%50 WHEN 5 THEN -rider_id WHEN 9 THEN NULL ELSE rider_id END AS rider_id,
  CASE ride_id%50 WHEN 8 THEN -1 ELSE driver_id END AS driver_id, vehicle_id, pickup_location_id,
  CASE ride_id%50 WHEN 2 THEN pickup_location_id ELSE dropoff_location_id END AS dropoff_location_id, rule_id,
  CASE ride_id%50 WHEN 3 THEN 'unknown' ELSE status END AS status, CASE ride_id%50 WHEN 1 THEN CAST(-fare AS DECIMAL(10,2)) ELSE fare END AS fare,
  CASE ride_id%50 WHEN 1 THEN CAST('0.00' AS DECIMAL(8,2)) ELSE distance END AS distance,
  CASE ride_id%50 WHEN 4 THEN 0 ELSE duration END AS duration, scheduled_at, completed_at, created_at
FROM rides UNION ALL SELECT ride_id, rider_id, driver_id, vehicle_id, pickup_location_id, dropoff_location_id, rule_id, status, fare, distance, duration,
  scheduled_at, completed_at, created_at FROM rides WHERE ride_id%50=6"""

STEPS["dirty_users"] = """
SELECT user_id, full_name, email, phone, role, acc_status, registration_date FROM users
UNION ALL SELECT user_id+9000000, full_name, concat(email,' '), concat(phone,'0'), role, acc_status, registration_date FROM users WHERE user_id%50=6
UNION ALL SELECT user_id+9500000, full_name, upper(email), phone, role, acc_status, registration_date FROM users WHERE user_id%50=7
UNION ALL SELECT user_id+9700000, full_name, concat('x',email), concat(phone,' '), role, acc_status, registration_date FROM users WHERE user_id%50=8"""

#: Per table: its key, and by the key's last digit what a column is damaged to.
DAMAGE = {
    "drivers": ("driver_id", {"cnic": {1: "NULL"}, "avg_rating": {2: "CAST('6.00' AS DECIMAL(3,2))"}, "verify_status": {3: "'lost'"}, "user_id": {4: "-1"},
                              "license_num": {5: "'lic-x'", 6: "'LIC-X '"}}),
    "vehicles": ("vehicle_id", {"year": {1: "1990"}, "make": {2: "NULL"}, "driver_id": {3: "-1"}, "vehicle_type": {4: "'boat'"},
                                "license_plate": {5: "'lea-x'", 6: "'LEA-X '"}}),
    "locations": ("location_id", {"latitude": {1: "CAST('91.0' AS DECIMAL(10,7))"}, "longitude": {2: "CAST('-181.0' AS DECIMAL(10,7))"}, "city": {3: "NULL"}}),
    "fare_rules": ("rule_id", {"base_rate": {1: "CAST('0.00' AS DECIMAL(8,2))"}, "surge_multi": {2: "CAST('0.50' AS DECIMAL(4,2))"}, "vehicle_type": {3: "'boat'"},
                               "city": {4: "'same'", 5: "'Same '"}}),
    "promo_codes": ("promo_id", {"discount_pct": {1: "CAST('0.00' AS DECIMAL(5,2))"}, "usage_count": {2: "usage_limit+1"}, "valid_until": {3: "valid_from"},
                                 "code": {4: "'code'", 5: "'CODE '", 6: "NULL"}}),
    "wallet": ("user_id", {"balance": {1: "CAST('-1.00' AS DECIMAL(10,2))"}, "payout_status": {2: "'lost'"}, "user_id": {3: "-user_id", 4: "NULL"}}),
    "payments": ("payment_id", {"amount": {1: "CAST('-1.00' AS DECIMAL(10,2))"}, "ride_id": {2: "-1"}, "rider_id": {3: "-1"}, "promo_id": {4: "-1"},
                                "pay_method": {5: "'barter'"}, "discount_appld": {6: "NULL"}}),
    "driver_earnings": ("earning_id", {"net_amount": {1: "CAST(gross_amount+1 AS DECIMAL(10,2))"}, "commission": {2: "CAST('-1.00' AS DECIMAL(10,2))"},
                                       "driver_id": {3: "-1"}, "ride_id": {4: "-1"}, "payout_status": {5: "'lost'"}}),
    "ratings": ("rating_id", {"score": {0: "6"}, "rated_user_id": {2: "rated_by", 4: "-1"}, "rater_role": {6: "'guest'"}, "ride_id": {8: "-1"}, "rated_by": {8: "-1"}}),
    "admin_notifications": ("notification_id", {"type": {1: "NULL", 4: "repeat('x',51)"}, "related_user_id": {2: "-1"}, "is_read": {3: "NULL"},
                                                "notification_id": {5: "notification_id+5", 6: "NULL"}, "message": {7: "NULL"}}),
    "ride_history": ("ride_id", {"final_fare": {1: "CAST('-1.00' AS DECIMAL(10,2))"}, "outcome": {2: "'lost'"}, "archived_at": {3: "NULL"}, "ride_id": {4: "-ride_id"}}),
}


def _damaged(table: str) -> str:
    key, damage = DAMAGE[table]

    def column(name: str) -> str:
        cases = " ".join(f"WHEN {digit} THEN {value}" for digit, value in damage.get(name, {}).items())
        return f"CASE {key}%10 {cases} ELSE {name} END AS {name}" if cases else name
    # The column list is read as text, since there may be no session yet.
    names = [part.split()[0] for part in re.split(r",(?![^(]*\))", schema.COLUMNS[table])]
    return f"SELECT {', '.join(map(column, names))} FROM {table}"


STEPS.update({f"dirty_{table}": _damaged(table) for table in DAMAGE})

STEPS["leaving_drivers"] = "SELECT driver_id FROM drivers WHERE driver_id%5=1"
STEPS["ended_codes"] = "SELECT promo_id FROM promo_codes WHERE promo_id%3=1"
STEPS["ended_rules"] = "SELECT rule_id FROM fare_rules WHERE rule_id%4=1"

STEPS["leavers"] = "SELECT user_id FROM users WHERE user_id%50=1"


# Event streams; every tenth event is sent twice.
STEPS["trip_events"] = """
SELECT trip_id, submitted_at, ride_id, distance, duration FROM raw_trips
UNION ALL SELECT trip_id, submitted_at, ride_id, distance, duration FROM raw_trips WHERE ride_id%10=0"""

STEPS["rating_events"] = """
SELECT rating_id, rated_user_id, score, rated_at FROM ratings
UNION ALL SELECT rating_id, rated_user_id, score, rated_at FROM ratings WHERE rating_id%10=0"""

STEPS["closure_events"] = """
SELECT ride_id*4 AS event_id, ride_id, 'paid' AS kind, transaction_date AS happened_at FROM payments WHERE pay_status='paid'
UNION ALL SELECT ride_id*4+1, ride_id, 'paid', transaction_date FROM payments WHERE pay_status='paid' AND ride_id%10=0
UNION ALL SELECT ride_id*4+2, ride_id, 'cancelled', created_at FROM rides WHERE status='cancelled'
UNION ALL SELECT ride_id*4+3, ride_id, 'paid', created_at - INTERVAL '1' DAY FROM rides WHERE status='cancelled' AND ride_id%4=0"""

STEPS["trip_changes"] = """
SELECT ride_id, driver_id, status, created_at AS changed_at FROM rides
UNION ALL SELECT ride_id, driver_id, status, created_at FROM rides WHERE ride_id%10=0"""


#: Forms that jobs take, each delivered twice with its own id.
DELIVERED = ["raw_bookings", "payment_requests", "raw_registrations", "raw_trips", "raw_vehicles", "raw_topups", "raw_promos",
             "raw_ratings", "accept_attempts", "status_changes", "account_changes"]
STEPS.update({f"twice_{name}": f"SELECT * FROM {name} UNION ALL SELECT * FROM {name}" for name in DELIVERED})


def _depends(sql: str, known) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [name for name in known if name in words]


def cte_text() -> str:
    """All statements as one WITH list, for checking results on another engine."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in STEPS.items())


class StarTables(Mapping[str, DataFrame]):
    """The derived tables of one input folder, each written once when first asked for.

    Tables are Parquet files in the session's shared folder, so reports scan them with pushed filters and
    pruned columns and survive the loss of an executor.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        # A session of its own keeps the view names and the time zone away from the caller's.
        self._maker = spark.newSession()
        self._maker.conf.set("spark.sql.session.timeZone", "UTC")
        for name in STAR:
            self._maker.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        self.root = f"{shared_dir(spark)}/star-{uuid.uuid4().hex}"
        self._ready: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            sql = STEPS[name]
            for needed in _depends(sql, STEPS):
                if needed != name:
                    self[needed]
            df = self._maker.sql(sql)
            df = schema.conform(df, name) if name in schema.COLUMNS else _plain(df)
            path = f"{self.root}/{name}"
            df.write.mode("overwrite").parquet(path)
            self._maker.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
            self._ready[name] = self._spark.read.schema(df.schema).parquet(path)
        return self._ready[name]

    def __iter__(self):
        return iter(STEPS)

    def __len__(self) -> int:
        return len(STEPS)


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as everywhere else."""
    return df.select(*[
        df[f.name].cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else df[f.name]
        for f in df.schema.fields
    ])


_CACHE: dict[tuple[str, str], StarTables] = {}


def star_tables(spark: SparkSession, sf_dir: str) -> StarTables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = StarTables(spark, sf_dir)
    return _CACHE[key]
