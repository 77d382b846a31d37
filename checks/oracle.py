"""The same results stated in plain SQL, for comparison by another engine.

``CTES`` defines the audit tables over the sample star schema and the derived
frames; ``with_ctes`` prefixes a body with those it mentions.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["clients"] = """
SELECT n_nationkey AS client_id, n_name AS client_name,
       CASE n_regionkey WHEN 0 THEN 'Healthcare' WHEN 1 THEN 'Manufacturing' WHEN 2 THEN 'Food Service'
            WHEN 3 THEN 'Education' ELSE 'Retail' END AS industry
FROM nation"""

CTES["custs"] = """
SELECT c_custkey, c_nationkey AS client_id, c_mktsegment,
       c_nationkey * 10 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
            WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS property_id
FROM customer"""

CTES["properties"] = """
SELECT DISTINCT property_id, client_id, c_mktsegment AS property_name,
       'Site ' || property_id AS address, 'City ' || client_id AS city
FROM custs"""

CTES["vendors"] = "SELECT s_suppkey AS vendor_id, s_name AS vendor_name FROM supplier"

CTES["accounts"] = """
SELECT c_custkey AS account_id, CASE WHEN c_custkey % 50 <> 49 THEN property_id END AS property_id,
       c_custkey % (SELECT count(*) FROM supplier) AS vendor_id, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS account_number
FROM custs"""

CTES["line_items"] = """
SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS bill_id,
       CASE l_linenumber WHEN 1 THEN 'Delivery Charge' WHEN 2 THEN 'Supply Charge' WHEN 3 THEN 'Demand Charge'
            WHEN 4 THEN 'Taxes and Surcharges' WHEN 5 THEN 'Fixed Monthly Charge' WHEN 6 THEN 'Rider'
            WHEN 7 THEN 'Credit' END AS category,
       CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END
            * CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))
            AS DECIMAL(18,2)) AS total_price,
       l_quantity
FROM lineitem"""

CTES["line_sums"] = """
SELECT bill_id, CAST(sum(total_price) AS DECIMAL(18,2)) AS line_sum, sum(l_quantity) AS quantity
FROM line_items GROUP BY bill_id"""

CTES["raw_bills"] = """
SELECT o_orderkey AS bill_id, o_custkey AS account_id,
       CASE WHEN o_custkey % 97 = 0 THEN 'Unknown' WHEN o_custkey % 2 = 0 THEN 'Electric' ELSE 'Gas' END AS utility_type,
       CASE WHEN o_orderkey % 500 NOT IN (0, 7) THEN CAST(o_orderdate AS DATE) END AS billing_date,
       CAST(CASE WHEN line_sum IS NULL OR line_sum <= 0
                 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))
                 WHEN o_orderkey % 20 = 7 THEN CAST(line_sum * CAST(1.10 AS DECIMAL(3,2)) AS DECIMAL(18,2))
                 WHEN o_orderkey % 40 = 3 THEN CAST(line_sum * CAST(3.00 AS DECIMAL(3,2)) AS DECIMAL(18,2))
                 ELSE line_sum END AS DECIMAL(18,2)) AS total_amount,
       coalesce(quantity, 0.0) AS usage_volume,
       o_orderkey % 20 = 7 OR o_orderkey % 40 = 3 AS is_anomaly_detected,
       coalesce(line_sum, 0) AS line_sum
FROM orders LEFT JOIN line_sums ON line_sums.bill_id = o_orderkey"""

CTES["bills"] = """
SELECT raw_bills.*,
       CASE utility_type WHEN 'Electric' THEN 'kWh' WHEN 'Gas' THEN 'Therms' ELSE 'Unknown' END AS usage_unit,
       billing_date - INTERVAL 30 DAY AS service_period_start, billing_date - INTERVAL 1 DAY AS service_period_end,
       'Unreviewed' AS anomaly_status,
       CASE WHEN bill_id % 20 = 7 THEN abs(total_amount - line_sum) ELSE 0 END AS stated_discrepancy
FROM raw_bills"""

CTES["directory"] = """
SELECT a.account_id, a.account_number, v.vendor_name, p.property_id, p.property_name, p.address, p.city,
       c.client_name, c.industry
FROM accounts a JOIN vendors v ON v.vendor_id = a.vendor_id
JOIN properties p ON p.property_id = a.property_id JOIN clients c ON c.client_id = p.client_id"""

CTES["charges"] = """
SELECT bill_id,
       sum(CASE WHEN category = 'Delivery Charge' THEN total_price ELSE 0 END) AS delivery_charge,
       sum(CASE WHEN category = 'Supply Charge' THEN total_price ELSE 0 END) AS supply_charge,
       sum(CASE WHEN category = 'Demand Charge' THEN total_price ELSE 0 END) AS demand_charge,
       sum(CASE WHEN category = 'Taxes and Surcharges' THEN total_price ELSE 0 END) AS taxes
FROM line_items GROUP BY bill_id"""

CTES["base"] = """
SELECT b.*, d.* EXCLUDE (account_id),
       CAST(b.total_amount AS DOUBLE) AS total, month(billing_date) AS month, year(billing_date) AS year,
       coalesce(delivery_charge, 0) AS delivery_charge, coalesce(supply_charge, 0) AS supply_charge,
       coalesce(demand_charge, 0) AS demand_charge, coalesce(taxes, 0) AS taxes,
       CASE WHEN usage_volume > 0 THEN CAST(coalesce(delivery_charge, 0) AS DOUBLE) / usage_volume ELSE 0 END AS rate
FROM bills b JOIN directory d ON d.account_id = b.account_id
LEFT JOIN charges ON charges.bill_id = b.bill_id
WHERE b.total_amount > 0"""

CTES["by_month"] = """
SELECT account_id, month, CAST(sum(total_amount) * 100 AS HUGEINT) AS month_cents, count(*) AS month_bills,
       avg(total) AS monthly_mean, stddev_samp(total) AS monthly_std
FROM base WHERE month IS NOT NULL GROUP BY account_id, month"""

CTES["by_account"] = """
SELECT account_id, avg(total) AS overall_mean, stddev_samp(total) AS overall_std, count(*) AS account_bill_count,
       avg(CASE WHEN usage_volume > 0 THEN rate END) AS mean_rate_used, avg(rate) AS mean_rate_all
FROM base GROUP BY account_id"""

CTES["stats"] = """
SELECT base.*, month_cents, month_bills, monthly_mean, overall_mean, account_bill_count, mean_rate_used, mean_rate_all,
       CASE WHEN monthly_std IS NULL OR monthly_std = 0 THEN 1.0 ELSE monthly_std END AS monthly_std,
       CASE WHEN overall_std IS NULL OR overall_std = 0 THEN 1.0 ELSE overall_std END AS overall_std
FROM base JOIN by_account ON by_account.account_id = base.account_id
LEFT JOIN by_month ON by_month.account_id = base.account_id AND by_month.month = base.month"""

CTES["features"] = """
SELECT *,
       (total - monthly_mean) / monthly_std AS zscore_monthly,
       (total - overall_mean) / overall_std AS zscore_overall,
       (total - monthly_mean) / monthly_mean * 100 AS raw_pct_monthly,
       coalesce((total - monthly_mean) / monthly_mean * 100, 0) AS pct_above_monthly,
       coalesce((total - overall_mean) / overall_mean * 100, 0) AS pct_above_overall,
       CASE WHEN mean_rate_used > 0 THEN rate / mean_rate_used ELSE 1.0 END AS delivery_rate_ratio,
       CASE WHEN mean_rate_all > 0 THEN rate / mean_rate_all ELSE 1.0 END AS delivery_rate_ratio_all,
       CAST(delivery_charge AS DOUBLE) / total * 100 AS delivery_pct,
       CAST(supply_charge AS DOUBLE) / total * 100 AS supply_pct,
       CAST(demand_charge AS DOUBLE) / total * 100 AS demand_pct,
       CAST(taxes AS DOUBLE) / total * 100 AS taxes_pct
FROM stats"""

CTES["scored"] = """
SELECT *, abs(zscore_overall) >= 1.5 AND account_bill_count >= 12 AS ml_flagged,
       least(1.0, abs(zscore_overall) / 3) AS ml_anomaly_probability
FROM features"""

CTES["bill_months"] = """
SELECT DISTINCT year(billing_date) AS year, month(billing_date) AS month FROM bills WHERE billing_date IS NOT NULL"""

CTES["weather_days"] = """
WITH months AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS first FROM orders),
days AS (SELECT CAST(unnest(generate_series(first, first + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM months),
parts AS (SELECT d, year(d) AS y, month(d) AS m, day(d) AS dd FROM days),
temps AS (SELECT d, dd, list_extract([26, 28, 36, 47, 58, 67, 74, 72, 64, 53, 42, 31], m)
          + (dd * 7 + y * 5 + m * 3) % 13 - 6 + (y * m) % 11 - 5 AS mid FROM parts)
SELECT d AS obs_date, mid + 8 AS tmax, CASE WHEN dd <> 29 THEN mid - 8 END AS tmin FROM temps"""

CTES["weather_months"] = """
SELECT year(obs_date) AS year, month(obs_date) AS month,
       sum(greatest(0, 65 - (tmax + tmin) / 2.0)) AS hdd, sum(greatest(0, (tmax + tmin) / 2.0 - 65)) AS cdd,
       count(*) AS days
FROM weather_days WHERE tmax IS NOT NULL AND tmin IS NOT NULL GROUP BY 1, 2"""

CTES["weather_base"] = """
SELECT month, round_even(avg(hdd), 1) AS avg_hdd, round_even(avg(cdd), 1) AS avg_cdd
FROM weather_months SEMI JOIN bill_months USING (year, month) GROUP BY month"""

CTES["weather_bills"] = """
WITH joined AS (
  SELECT s.*, w.hdd IS NOT NULL AND n.avg_hdd IS NOT NULL AS weather_available,
         CASE WHEN s.utility_type = 'Gas' THEN 'HDD' ELSE 'CDD' END AS metric,
         coalesce(CASE WHEN s.utility_type = 'Gas' THEN w.hdd ELSE w.cdd END, 0) AS actual_dd,
         coalesce(CASE WHEN s.utility_type = 'Gas' THEN n.avg_hdd ELSE n.avg_cdd END, 0) AS usual_dd,
         CASE WHEN s.utility_type = 'Unknown' THEN 0.5
              WHEN industry = 'Healthcare' THEN CASE s.utility_type WHEN 'Gas' THEN 0.4 ELSE 0.3 END
              WHEN industry = 'Manufacturing' THEN 0.2
              WHEN industry = 'Food Service' THEN CASE s.utility_type WHEN 'Gas' THEN 0.3 ELSE 0.5 END
              WHEN industry = 'Education' THEN CASE s.utility_type WHEN 'Gas' THEN 0.9 ELSE 0.6 END
              WHEN industry = 'Retail' THEN 0.7 ELSE 0.5 END AS weight
  FROM scored s LEFT JOIN weather_months w ON w.year = s.year AND w.month = s.month
  LEFT JOIN weather_base n ON n.month = s.month),
deviated AS (
  SELECT *, CASE WHEN usual_dd < 5 THEN 0.0 ELSE (actual_dd - usual_dd) / usual_dd * 100 END AS deviation FROM joined)
SELECT *, CASE WHEN weather_available THEN
         actual_dd > 0 AND usual_dd > 0 AND deviation > 10 AND deviation * weight >= pct_above_monthly * 0.6
       END AS explains
FROM deviated"""

CTES["judged"] = """
WITH picked AS (
  SELECT *, CASE WHEN is_anomaly_detected THEN stated_discrepancy ELSE 0 END > 0.01 AS is_math
  FROM weather_bills)
SELECT *,
       CASE WHEN is_math THEN 'MATH'
            WHEN weather_available AND NOT explains AND abs(pct_above_monthly) > 20 THEN 'COMBINED'
            ELSE 'ML' END AS detection_layer,
       CASE WHEN is_math THEN 'MATH_ERROR'
            WHEN weather_available AND explains THEN 'WEATHER_DRIVEN'
            WHEN weather_available AND pct_above_monthly > 0 AND actual_dd < usual_dd * 0.8 THEN 'WEATHER_UNEXPLAINED_SPIKE'
            WHEN weather_available AND pct_above_monthly <= 0 AND actual_dd > usual_dd * 1.2 THEN 'WEATHER_UNEXPLAINED_DROP'
            WHEN pct_above_monthly > 0 THEN 'USAGE_SPIKE' ELSE 'USAGE_DROP' END AS finding_type,
       CASE WHEN is_math THEN CAST(stated_discrepancy AS DOUBLE) ELSE greatest(0, total - monthly_mean) END AS recovery
FROM picked WHERE is_math OR (ml_flagged AND billing_date IS NOT NULL)"""



def half_even(cents: str, parts: str) -> str:
    """cents / parts as money, halves to the even cent, in integer arithmetic."""
    down, rest = f"({cents} // {parts})", f"(2 * ({cents} % {parts}))"
    up = f"CASE WHEN {rest} > {parts} OR ({rest} = {parts} AND {down} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST(CAST({down} + {up} AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))"


CTES["findings"] = f"""
SELECT bill_id AS analysis_id, bill_id, detection_layer, finding_type,
       CASE WHEN recovery >= 5000 THEN 'URGENT' WHEN recovery >= 1000 THEN 'HIGH'
            WHEN recovery >= 200 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       {half_even('month_cents', 'month_bills')} AS expected_value, total_amount AS actual_value,
       CASE WHEN billing_date IS NOT NULL THEN round_even(pct_above_monthly, 2) END AS deviation_pct, round_even(zscore_monthly, 3) AS zscore_monthly,
       round_even(zscore_overall, 3) AS zscore_overall,
       CASE WHEN billing_date IS NOT NULL THEN actual_dd END AS weather_actual,
       CASE WHEN billing_date IS NOT NULL THEN usual_dd END AS weather_historical,
       CASE WHEN is_math THEN 1.0 ELSE round_even(ml_anomaly_probability, 4) END AS anomaly_probability,
       CASE WHEN is_math THEN CAST(stated_discrepancy AS DECIMAL(18,2)) WHEN recovery = 0 THEN 0
         ELSE {half_even('(CAST(total_amount * 100 AS HUGEINT) * month_bills - month_cents)', 'month_bills')} END AS potential_recovery,
       bill_id % 5 IN (0, 1) AS reviewed,
       CASE WHEN is_math THEN 'The listed charges of this ' || lower(utility_type) || ' bill miss its total by $'
              || format('{{:,}}', CAST(floor(stated_discrepancy) AS BIGINT)) || '.'
              || lpad(CAST(CAST((stated_discrepancy - floor(stated_discrepancy)) * 100 AS BIGINT) AS VARCHAR), 2, '0')
              || '. Ask the vendor to correct the total.'
       ELSE 'At $' || format('{{:,}}', CAST(round_even(total, 0) AS BIGINT)) || ', this ' || lower(utility_type)
              || ' bill is ' || format('{{:,}}', CAST(round_even(abs(pct_above_monthly), 0) AS BIGINT)) || '% '
              || CASE WHEN pct_above_monthly > 0 THEN 'above' ELSE 'below' END
              || ' the account''s mean for ' || monthname(billing_date) || ' of $'
              || format('{{:,}}', CAST(round_even(monthly_mean, 0) AS BIGINT)) || ' ('
              || greatest(1, account_bill_count // 12) || CASE WHEN account_bill_count // 12 <= 1 THEN ' year' ELSE ' years' END
              || ' of bills).'
              || CASE WHEN pct_above_monthly > 0 THEN '' ELSE ' Check the meter and the service for a fault.' END
              || CASE WHEN NOT weather_available THEN ''
                 WHEN explains THEN ' The month''s weather was ' || format('{{:,}}', CAST(round_even(abs(round_even(deviation, 1)), 0) AS BIGINT))
                   || '% harsher than usual (' || format('{{:,}}', CAST(round_even(actual_dd, 0) AS BIGINT)) || ' ' || metric
                   || ' against a usual ' || format('{{:,}}', CAST(round_even(usual_dd, 0) AS BIGINT))
                   || '), which accounts for part of the change.'
                 WHEN finding_type = 'WEATHER_UNEXPLAINED_SPIKE' THEN ' The month was mild ('
                   || format('{{:,}}', CAST(round_even(actual_dd, 0) AS BIGINT)) || ' ' || metric || ' against a usual '
                   || format('{{:,}}', CAST(round_even(usual_dd, 0) AS BIGINT)) || '), so weather cannot be the cause.'
                 WHEN finding_type = 'WEATHER_UNEXPLAINED_DROP' THEN ' The month was harsh ('
                   || format('{{:,}}', CAST(round_even(actual_dd, 0) AS BIGINT)) || ' ' || metric || ' against a usual '
                   || format('{{:,}}', CAST(round_even(usual_dd, 0) AS BIGINT)) || '), so a low bill is odd.'
                 ELSE ' The month''s weather was ordinary and does not account for it.' END
       END AS plain_english_reason
FROM judged"""

CTES["finding_star"] = """
SELECT f.*, b.account_id, b.utility_type, b.billing_date, b.total_amount, d.* EXCLUDE (account_id),
       CASE severity WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS severity_rank
FROM findings f JOIN bills b ON b.bill_id = f.bill_id JOIN directory d ON d.account_id = b.account_id"""

CTES["held_out"] = """
SELECT is_anomaly_detected AS truth, ml_flagged AS guess, abs(zscore_overall) AS score
FROM scored WHERE account_bill_count >= 12"""

CTES["matrix"] = """
SELECT count(*) FILTER (NOT truth AND NOT guess) AS tn, count(*) FILTER (NOT truth AND guess) AS fp,
       count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (truth AND guess) AS tp FROM held_out"""

CTES["records"] = """
WITH sums AS (
  SELECT bill_id,
         sum(CASE WHEN category = 'Fixed Monthly Charge' THEN total_price END) AS fixed,
         sum(CASE WHEN category = 'Delivery Charge' THEN total_price END) AS delivery,
         sum(CASE WHEN category = 'Supply Charge' THEN total_price END) AS supply,
         sum(CASE WHEN category = 'Demand Charge' THEN total_price END) AS demand,
         sum(CASE WHEN category = 'Taxes and Surcharges' THEN total_price END) AS taxes,
         abs(sum(CASE WHEN category = 'Credit' THEN total_price END)) AS credit
  FROM line_items GROUP BY bill_id),
delivered AS (
  SELECT b.bill_id AS record_id, 'bill-' || b.bill_id || '.pdf' AS source_file, b.bill_id % 50 NOT IN (1, 11, 21, 31) AS readable,
         CASE WHEN b.bill_id % 50 = 31 THEN 'extractor_error' ELSE 'malformed' END AS fault,
         CASE WHEN b.bill_id % 25 <> 5 THEN 'Vendor ' || (account_id % 10) END AS provider_name,
         CASE WHEN b.bill_id % 25 = 8 THEN '123' ELSE lpad(CAST(account_id AS VARCHAR), 8, '0') END AS account_number,
         CASE WHEN b.bill_id % 30 = 9 THEN 'Water' ELSE utility_type END AS sent_utility,
         CASE WHEN b.bill_id % 10 = 2 THEN 'CCF' ELSE usage_unit END AS sent_unit,
         billing_date, usage_volume,
         CASE WHEN b.bill_id % 25 = 6 THEN 0 ELSE total_amount END AS total_amount_due,
         coalesce(fixed, 0) AS fixed, coalesce(delivery, 0) AS delivery, coalesce(supply, 0) AS supply,
         coalesce(demand, 0) AS demand, coalesce(taxes, 0) AS taxes, coalesce(credit, 0) AS credit
  FROM bills b LEFT JOIN sums ON sums.bill_id = b.bill_id),
united AS (
  SELECT *, CASE sent_unit WHEN 'CCF' THEN 'Therms' ELSE sent_unit END AS unit,
         delivery + supply + demand + taxes - credit AS form_total FROM delivered)
SELECT *, CASE WHEN unit = 'kWh' THEN 'Electric' WHEN unit = 'Therms' THEN 'Gas'
               WHEN sent_utility IN ('Electric', 'Gas') THEN sent_utility ELSE 'Unknown' END AS utility,
       form_total + fixed AS charge_total,
       abs(form_total + fixed - total_amount_due) AS discrepancy,
       abs(form_total - total_amount_due) AS form_discrepancy,
       concat_ws(', ', CASE WHEN NOT readable THEN fault END,
         CASE WHEN readable AND provider_name IS NULL THEN 'no provider' END,
         CASE WHEN readable AND length(account_number) < 5 THEN 'bad account number' END,
         CASE WHEN readable AND total_amount_due <= 0 THEN 'no positive total' END) AS reasons
FROM united"""

CTES["bill_pages"] = """
SELECT doc_id // 4 AS doc_id, doc_id % 4 AS page_no,
       CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'Total Amount Due $'
            || CAST(CAST(doc_id % 900 + 100 AS DECIMAL(10,2)) + 0.25 AS VARCHAR)
            || ' Account Number ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') ELSE text END AS text
FROM documents"""

CTES["judged_pages"] = r"""
SELECT *, regexp_matches(text, '\$\s*\d+\.\d{2}')
          OR (regexp_matches(text, '\b\d+\.\d{2}\b') AND regexp_matches(text, '\b\d{5,}\b')) AS is_billing
FROM bill_pages"""

# The numbers planted in paper bill d, as the sample adapter plants them.
CTES["papers"] = """
SELECT *, CAST(basic + delivery + supply + demand + taxes - credits AS DECIMAL(18,2)) AS charged,
  CAST(basic + delivery + supply + demand + taxes - credits + CASE WHEN d % 12 = 11 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS total,
  CASE WHEN unit = 'kWh' THEN 'Electric' ELSE 'Gas' END AS utility,
  concat_ws(', ', CASE WHEN d % 12 IN (5, 7) THEN 'no provider' END, CASE WHEN d % 12 IN (5, 9) THEN 'bad account number' END,
    CASE WHEN d % 12 = 5 THEN 'no positive total' END) AS reasons
FROM (SELECT d, pages, billing_pages, '2024-0' || (d % 9 + 1) || '-' AS month,
  CASE WHEN d % 12 NOT IN (5, 7) THEN 'Vendor ' || (d % 7) END AS provider,
  CASE WHEN d % 12 = 9 THEN '123' ELSE lpad(CAST(d AS VARCHAR), 8, '0') END AS account_number,
  CASE WHEN d % 10 < 5 THEN 'kWh' WHEN d % 10 < 8 THEN 'Therms' ELSE 'CCF' END AS unit,
  100 + d % 1900 AS usage, 'SC-' || (d % 5 + 1) AS rate_code,
  CAST(15 + d % 7 AS DECIMAL(18,2)) AS basic, CAST((10000 + (d * 37) % 90000) / 100.0 AS DECIMAL(18,2)) AS delivery,
  CAST((20000 + (d * 53) % 90000 + CASE WHEN d % 8 = 2 THEN 150000 ELSE 0 END) / 100.0 AS DECIMAL(18,2)) AS supply,
  CAST(CASE WHEN d % 4 = 0 THEN 0 ELSE 12.5 END AS DECIMAL(18,2)) AS demand, CAST((500 + d % 100) / 100.0 AS DECIMAL(18,2)) AS taxes,
  CAST(CASE WHEN d % 6 = 1 THEN 7 ELSE 0 END AS DECIMAL(18,2)) AS credits
  FROM (SELECT doc_id // 4 AS d, count(*) AS pages, count(*) FILTER (doc_id % 4 = 0 AND (doc_id // 4) % 12 <> 5
          OR regexp_matches(text, '\\$\\s*\\d+\\.\\d{2}')
          OR (regexp_matches(text, '\\b\\d+\\.\\d{2}\\b') AND regexp_matches(text, '\\b\\d{5,}\\b'))) AS billing_pages
        FROM documents GROUP BY 1))"""

_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}|{_SPACE}\\z', '', 'g')"


KEPT_LINE = r"""
x <> '' AND NOT regexp_matches(x, '\d+\.\d{5,}\s*x')
AND NOT regexp_matches(x, '^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d+')
AND NOT (regexp_matches(x, '^[\d\s]+\z') AND length(x) < 20)
AND NOT contains(lower(x), 'www.') AND NOT contains(lower(x), 'http')
AND NOT regexp_matches(x, '^1-\d{3}-\d{3}-\d{4}')
AND (regexp_matches(x, '\$\s*\d+\.?\d*|\b\d+\.\d{2}\b')
     OR len(list_filter(['total', 'amount due', 'account number', 'billing period', 'service period',
          'date bill issued', 'balance forward', 'current charges', 'rate', 'meter', 'usage', 'kwh', 'therms',
          'basic service', 'delivery', 'supply', 'demand', 'tax', 'surcharge', 'adjustment', 'credit',
          'please pay by', 'national grid', 'conedison', 'con edison', 'keyspan', 'rg&e', 'pg&e', 'provider',
          'utility'], lambda w: contains(lower(x), w))) > 0)"""


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    visit(body)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body
