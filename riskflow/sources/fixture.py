"""The supplied ``events`` table seen as transactions.

One SQL text per shape, valid in Spark SQL and in DuckDB, so a query and its
check start from the same rows. ``{events}`` is the only placeholder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.session import prepare

TRANSACTIONS_SQL = """
SELECT
  'TXN_' || lpad(CAST(event_id AS STRING),10,'0') AS transaction_id,
  CAST(ts AS TIMESTAMP) AS event_timestamp,
  event_id AS transaction_sequence_id,
  'v2.1' AS event_version,
  'CUST_' || CAST(user_id AS STRING) AS customer_id,
  CAST((user_id*37)%1500 AS INT) AS customer_tenure_days,
  'ACC_' || CAST(acc AS STRING) AS account_id,
  CASE acc%3 WHEN 0 THEN 'CREDIT' WHEN 1 THEN 'DEBIT' ELSE 'SAVINGS' END AS account_type,
  substr('USUKDEFRNG',CAST(1+2*(user_id%5) AS INT),2) AS customer_country,
  CASE WHEN user_id%10<6 THEN 'LOW' WHEN user_id%10<9 THEN 'MEDIUM' ELSE 'HIGH' END AS customer_risk_segment,
  'CARD_' || CAST(card AS STRING) AS card_id,
  CASE card%2 WHEN 0 THEN 'CREDIT' ELSE 'DEBIT' END AS card_type,
  CAST((card*53)%900 AS INT) AS card_age_days,
  CAST(CASE user_id%6 WHEN 0 THEN 0 WHEN 1 THEN 1000 WHEN 2 THEN 2000 WHEN 3 THEN 5000 WHEN 4 THEN 10000 ELSE 25000 END AS DOUBLE) AS credit_limit,
  substr('USUKDEFRNG',CAST(1+2*((user_id+(CASE WHEN card%8=0 THEN 1 ELSE 0 END))%5) AS INT),2) AS card_country,
  CASE WHEN card%20=0 THEN 'SUSPENDED' WHEN card%20=1 THEN 'INACTIVE' ELSE 'ACTIVE' END AS card_status,
  'MERCH_' || CAST(mer AS STRING) AS merchant_id,
  CASE mer%5 WHEN 0 THEN 'RETAIL' WHEN 1 THEN 'ELECTRONICS' WHEN 2 THEN 'FOOD' WHEN 3 THEN 'TRAVEL' ELSE 'GAMBLING' END AS merchant_category,
  substr('USUKDEFRNG',CAST(1+2*(mer%5) AS INT),2) AS merchant_country,
  'REG_' || CAST(mer%5 AS STRING) AS merchant_region,
  CASE mer%3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'MEDIUM' ELSE 'LARGE' END AS merchant_size,
  CAST(30+(mer*71)%1970 AS INT) AS merchant_age_days,
  CASE WHEN mer%10<6 THEN 'LOW' WHEN mer%10<9 THEN 'MEDIUM' ELSE 'HIGH' END AS merchant_risk_segment,
  'DEV_' || CAST(dev AS STRING) AS device_id,
  CASE dev%3 WHEN 0 THEN 'MOBILE_ANDROID' WHEN 1 THEN 'MOBILE_IOS' ELSE 'DESKTOP_WINDOWS' END AS device_type,
  CASE dev%3 WHEN 0 THEN 'Android_14' WHEN 1 THEN 'iOS_17' ELSE 'Windows_11' END AS device_os,
  CAST((dev*29+event_id%7)%500 AS INT) AS device_age_days,
  substr('USUKDEFRNG',CAST(1+2*((user_id+(CASE WHEN dev%6=1 THEN 2 ELSE 0 END))%5) AS INT),2) AS device_country,
  CASE dev%3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS device_trust_level,
  'IP_' || CAST(ip AS STRING) AS ip_id,
  substr('USUKDEFRNG',CAST(1+2*(ip%5) AS INT),2) AS ip_country,
  CASE event_id%4 WHEN 0 THEN 'residential' WHEN 1 THEN 'corporate' WHEN 2 THEN 'Datacenter' ELSE 'mobile' END AS connection_type,
  CASE WHEN ip%20<16 THEN 'CLEAN' WHEN ip%20<19 THEN 'SUSPICIOUS' ELSE 'BLOCKED' END AS network_risk_segment,
  CASE WHEN event_id%29=0 THEN 'TOR_exit' WHEN event_id%13=0 THEN 'proxy' WHEN event_id%11=0 THEN 'unknown' ELSE 'none' END AS proxy_type,
  amt AS amount,
  CASE WHEN event_id%20<12 THEN 'USD' WHEN event_id%20<17 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'withdrawal' ELSE 'transfer' END AS transaction_type,
  CASE event_id%3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'MOBILE' ELSE 'POS' END AS payment_channel,
  CASE event_id%2 WHEN 0 THEN 'CARD_PRESENT' ELSE 'CARD_NOT_PRESENT' END AS payment_method,
  CASE event_id%4 WHEN 0 THEN 'PIN' WHEN 1 THEN '3DS' WHEN 2 THEN 'BIOMETRIC' ELSE 'NONE' END AS authentication_method,
  CASE WHEN event_id%10=0 THEN 1 ELSE 0 END AS installment_flag,
  CASE WHEN event_id%5=0 THEN 1 ELSE 0 END AS international_flag,
  substr('USUKDEFRNG',CAST(1+2*((user_id+(CASE WHEN event_id%9=0 THEN 1 ELSE 0 END))%5) AS INT),2) AS transaction_country,
  substr('USUKDEFRNG',CAST(1+2*((user_id+(CASE WHEN event_id%17=0 THEN 3 ELSE 0 END))%5) AS INT),2) AS billing_country,
  'TERM_' || CAST(event_id%8 AS STRING) AS terminal_id,
  'BR_' || CAST(event_id%5 AS STRING) AS branch_id,
  CASE event_id%2 WHEN 0 THEN 'ROUTE_A' ELSE 'ROUTE_B' END AS processing_route,
  CASE event_id%3 WHEN 0 THEN 'DEFERRED' ELSE 'INSTANT' END AS settlement_type,
  'BATCH_0' || CAST(event_id%3 AS STRING) AS batch_window,
  CASE WHEN event_id%50=0 THEN 1 ELSE 0 END AS is_outlier,
  CASE WHEN event_id%50<>0 AND event_type='error' AND value>1e2 THEN 1 ELSE 0 END AS true_fraud_label,
  CASE WHEN event_type='error' AND value>8e1 THEN 1 ELSE 0 END AS observed_label,
  CAST(ts AS TIMESTAMP) + INTERVAL 1 DAY AS label_timestamp,
  CASE WHEN event_id%50<>0 AND event_type='error' AND value>1e2 THEN (CASE event_id%3 WHEN 0 THEN 'CARD_NOT_PRESENT' WHEN 1 THEN 'ACCOUNT_TAKEOVER' ELSE 'IDENTITY_THEFT' END) ELSE 'NONE' END AS fraud_scenario
FROM (
  SELECT event_id, ts, user_id, event_type, value, value*value/4e1 AS amt,
         user_id*3 + event_id%3 AS card, user_id*2 + (CASE WHEN event_id%7=0 THEN 1 ELSE 0 END) AS dev,
         (user_id*13 + event_id%5)%211 AS ip, event_id%97 AS mer, user_id*2 + event_id%2 AS acc
  FROM {events})
"""

# A deterministic stand-in score with heavy ties, for queries about scores.
SCORED_SQL = """
SELECT
  'TXN_' || lpad(CAST(event_id AS STRING),10,'0') AS transaction_id,
  CAST(ts AS TIMESTAMP) AS event_timestamp,
  value*value/4e1 AS amount,
  CASE WHEN event_id%50<>0 AND event_type='error' AND value>1e2 THEN 1 ELSE 0 END AS y,
  least(1e0, floor((value/5e2*0.7e0 + (event_id*7919%1000)/1e3*0.3e0)*1e3)/1e3) AS p
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRANSACTIONS_SQL, events=table(spark, sf_dir, "events"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED_SQL, events=table(spark, sf_dir, "events"))
