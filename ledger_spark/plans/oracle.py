"""DuckDB SQL for the derived tables, written the plain way (checks, not plans).

The Spark jobs decompose windows into day blocks, prefix sums and calendar
look-ups; these statements use direct windows and brute-force range joins so
that the two sides share no logic.  Tables ``lineitem orders customer part
supplier events`` are views registered by the checker.
"""

from __future__ import annotations

DAYS_SUPPLY_LIST = "[7, 14, 30, 60, 90, 180, 365]"

LINE_KEY = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
            "strftime(l_shipdate, '%Y%m%d'))")

BILLING = f"""
billing AS (
  SELECT {LINE_KEY} AS billing_id,
         'PT-' || CAST(o.o_custkey AS VARCHAR) AS patient_id,
         c.c_name AS patient_name,
         CAST(NULL AS DATE) AS date_of_birth,
         'RX-' || CAST(li.l_orderkey AS VARCHAR) AS prescription_id,
         lpad(CAST(li.l_partkey AS VARCHAR), 11, '0') AS ndc,
         p.p_name AS drug_name,
         CAST(li.l_shipdate AS DATE) AS billing_date,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE s.s_name END AS insurance_name,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE lpad(CAST(s.s_nationkey AS VARCHAR), 6, '0') END AS bin_number,
         CAST(li.l_quantity AS DOUBLE) AS quantity_billed,
         CAST(10 * li.l_linenumber AS INTEGER) AS days_supply,
         CAST(NULL AS INTEGER) AS refills_remaining
  FROM lineitem li
  LEFT JOIN orders o ON li.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN part p ON li.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey
  WHERE li.l_linestatus = 'F'
)"""

ORDERING = f"""
ordering AS (
  SELECT {LINE_KEY} AS order_id,
         lpad(CAST(li.l_partkey AS VARCHAR), 11, '0') AS ndc,
         p.p_name AS drug_name,
         CAST(li.l_shipdate AS DATE) AS ordered_date,
         CAST(li.l_quantity AS DOUBLE) AS quantity_ordered
  FROM lineitem li LEFT JOIN part p ON li.l_partkey = p.p_partkey
  WHERE li.l_linestatus = 'O'
)"""

FILLS = f"""
fills_base AS (
  SELECT {LINE_KEY} AS fill_id,
         CAST(li.l_shipdate AS DATE) AS fill_date,
         'PT-' || CAST(o.o_custkey AS VARCHAR) AS patient_id,
         p.p_type AS medication_id,
         'NDC-' || p.p_type AS ndc,
         CAST(li.l_quantity AS DOUBLE) AS quantity_billed,
         CAST({DAYS_SUPPLY_LIST}[li.l_linenumber] AS INTEGER) AS days_supply,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE s.s_name END AS insurance_name,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE lpad(CAST(s.s_nationkey AS VARCHAR), 6, '0') END AS bin_number
  FROM lineitem li
  LEFT JOIN orders o ON li.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON li.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey
),
fills_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id, medication_id
                               ORDER BY fill_date, fill_id) - 1 AS n
  FROM fills_base WHERE patient_id IS NOT NULL AND medication_id IS NOT NULL
),
fills AS (
  SELECT fill_id, fill_id AS billing_id, fill_date, patient_id,
         patient_id || '/' || medication_id || '/' || CAST(n // 3 AS VARCHAR) AS prescription_id,
         medication_id, ndc, medication_id AS drug_name, quantity_billed, days_supply,
         CAST(n % 3 AS INTEGER) AS refill_number, CAST(2 - n % 3 AS INTEGER) AS refills_remaining,
         insurance_name, bin_number
  FROM fills_ranked
),
prescriptions AS (
  SELECT prescription_id, patient_id, medication_id, ndc, min(fill_date) AS prescription_date,
         2 AS refills_authorized
  FROM fills GROUP BY prescription_id, patient_id, medication_id, ndc
)"""


BILLING_EXPORT = f"""
billing_export AS (
  SELECT {LINE_KEY} AS row_id,
         CASE WHEN li.l_orderkey % 101 = 0 THEN '  ' ELSE {LINE_KEY} END AS billing_id,
         CASE WHEN li.l_orderkey % 103 = 1 THEN NULL ELSE 'PT-' || CAST(o.o_custkey AS VARCHAR) END AS patient_id,
         CASE WHEN li.l_linenumber = 3 THEN '  ' || c.c_name || ' ' ELSE c.c_name END AS patient_name,
         CAST(NULL AS VARCHAR) AS date_of_birth,
         'RX-' || CAST(li.l_orderkey AS VARCHAR) AS prescription_id,
         CASE WHEN li.l_linenumber = 2 THEN ' ' || lpad(CAST(li.l_partkey AS VARCHAR), 11, '0') || ' '
              ELSE lpad(CAST(li.l_partkey AS VARCHAR), 11, '0') END AS ndc,
         p.p_name AS drug_name,
         CASE WHEN li.l_partkey % 97 = 0 THEN 'not-a-date'
              ELSE CASE li.l_orderkey % 6
                     WHEN 0 THEN strftime(li.l_shipdate, '%Y-%m-%d')
                     WHEN 1 THEN strftime(li.l_shipdate, '%-m/%-d/%Y')
                     WHEN 2 THEN strftime(li.l_shipdate, '%Y%m%d')
                     WHEN 3 THEN strftime(li.l_shipdate, '%-d %b %Y')
                     WHEN 4 THEN strftime(li.l_shipdate, '%Y/%m/%d')
                     ELSE strftime(li.l_shipdate, '%b %-d, %Y') END END AS billing_date,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE s.s_name END AS insurance_name,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE lpad(CAST(s.s_nationkey AS VARCHAR), 6, '0') END AS bin_number,
         CASE WHEN li.l_suppkey % 53 = 0 THEN 'n.a.'
              WHEN li.l_partkey % 89 = 0 THEN '-' || regexp_replace(CAST(CAST(li.l_quantity AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '')
              ELSE regexp_replace(CAST(CAST(li.l_quantity AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '') END AS quantity_billed,
         CASE WHEN li.l_orderkey % 107 = 2 THEN CAST(li.l_linenumber * 10 AS VARCHAR) || '.5'
              ELSE CAST(li.l_linenumber * 10 AS VARCHAR) END AS days_supply,
         CAST(NULL AS VARCHAR) AS refills_remaining
  FROM lineitem li
  LEFT JOIN orders o ON li.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN part p ON li.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey
  WHERE li.l_linestatus = 'F'
)"""


ORDERING_EXPORT = f"""
ordering_export AS (
  SELECT {LINE_KEY} AS row_id,
         CASE WHEN li.l_orderkey % 101 = 0 THEN ' ' ELSE {LINE_KEY} END AS order_id,
         lpad(CAST(li.l_partkey AS VARCHAR), 11, '0') AS ndc,
         p.p_name AS drug_name,
         CASE WHEN li.l_suppkey % 97 = 0 THEN '31/31/2000'
              ELSE CASE li.l_partkey % 6
                     WHEN 0 THEN strftime(li.l_shipdate, '%Y-%m-%d')
                     WHEN 1 THEN strftime(li.l_shipdate, '%-m/%-d/%Y')
                     WHEN 2 THEN strftime(li.l_shipdate, '%Y%m%d')
                     WHEN 3 THEN strftime(li.l_shipdate, '%-d %b %Y')
                     WHEN 4 THEN strftime(li.l_shipdate, '%Y/%m/%d')
                     ELSE strftime(li.l_shipdate, '%b %-d, %Y') END END AS ordered_date,
         CASE WHEN li.l_partkey % 89 = 1
              THEN '-' || regexp_replace(CAST(CAST(li.l_quantity AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '')
              ELSE regexp_replace(CAST(CAST(li.l_quantity AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '') END
           AS quantity_ordered
  FROM lineitem li LEFT JOIN part p ON li.l_partkey = p.p_partkey
  WHERE li.l_linestatus = 'O'
)"""


def candidates_sql(study_end: str, lead: int, after: int) -> str:
    """All fills with dates, flags and history features (brute force)."""
    return f"""
cand1 AS (
  SELECT f.*, r.prescription_date AS cur_rx_date,
         f.fill_date + f.days_supply AS expected_supply_end_date,
         f.fill_date + f.days_supply - {lead} AS observation_date,
         f.fill_date + f.days_supply + {after} AS target_window_end,
         row_number() OVER w - 1 AS k,
         lag(f.fill_date) OVER w AS prev_date,
         lag(f.days_supply) OVER w AS prev_ds
  FROM fills f JOIN prescriptions r ON f.prescription_id = r.prescription_id
  WINDOW w AS (PARTITION BY f.patient_id, f.medication_id ORDER BY f.fill_date, f.fill_id)
),
cand2 AS (
  SELECT *, datediff('day', prev_date, fill_date) AS ivl,
         datediff('day', prev_date, fill_date) - prev_ds AS gap
  FROM cand1
),
cand3 AS (
  SELECT *,
         avg(ivl) OVER wr AS avg_ivl, stddev_pop(ivl) OVER wr AS std_ivl, count(ivl) OVER wr AS n_ivl,
         avg(gap) OVER wr AS avg_gap,
         avg(CASE WHEN gap < -1 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) OVER wr AS early_rate,
         avg(CASE WHEN abs(gap) <= 1 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) OVER wr AS ontime_rate
  FROM cand2
  WINDOW wr AS (PARTITION BY patient_id, medication_id ORDER BY fill_date, fill_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
renew AS (
  SELECT c.fill_id,
         bool_or(r.prescription_date <= c.observation_date) AS already,
         min(CASE WHEN r.prescription_date > c.observation_date THEN r.prescription_date END) AS renewal_date
  FROM cand3 c JOIN prescriptions r
    ON r.patient_id = c.patient_id AND r.ndc = c.ndc
   AND r.prescription_id <> c.prescription_id AND r.prescription_date > c.cur_rx_date
  GROUP BY c.fill_id
),
candidates AS (
  SELECT c.*, coalesce(rn.already, false) AS renewal_already_received, rn.renewal_date,
         c.refills_remaining = 0 AS zero_refill,
         c.observation_date < c.fill_date AS lead_time_ineligible,
         c.target_window_end > DATE '{study_end}' AS censored
  FROM cand3 c LEFT JOIN renew rn ON c.fill_id = rn.fill_id
),
elig AS (
  SELECT * FROM candidates
  WHERE zero_refill AND NOT lead_time_ineligible AND NOT censored AND NOT renewal_already_received
),
medh AS (
  SELECT e.fill_id, count(h.fill_id) AS cnt, avg(h.days_supply) AS avg_ds,
         avg(h.quantity_billed) AS avg_q
  FROM elig e LEFT JOIN fills h
    ON h.medication_id = e.medication_id AND h.fill_date < e.observation_date AND h.fill_id <> e.fill_id
  GROUP BY e.fill_id
),
observations AS (
  SELECT e.fill_id AS observation_id, e.observation_date, e.expected_supply_end_date,
         e.patient_id, e.medication_id, e.ndc, e.prescription_id,
         CAST(e.refills_remaining AS INTEGER) AS current_refills_remaining,
         CAST(e.quantity_billed AS DOUBLE) AS current_quantity_billed,
         CAST(e.days_supply AS DOUBLE) AS current_days_supply,
         CAST(e.refill_number AS DOUBLE) AS current_refill_number,
         CAST(e.k AS DOUBLE) AS previous_fill_count,
         CAST(e.ivl AS DOUBLE) AS days_since_previous_fill,
         CAST(e.avg_ivl AS DOUBLE) AS average_previous_refill_interval_days,
         CASE WHEN e.n_ivl >= 2 THEN CAST(e.std_ivl AS DOUBLE) END AS std_previous_refill_interval_days,
         CAST(e.gap AS DOUBLE) AS latest_refill_timing_gap_days,
         CAST(e.avg_gap AS DOUBLE) AS average_previous_timing_gap_days,
         CAST(e.early_rate AS DOUBLE) AS previous_early_fill_rate,
         CAST(e.ontime_rate AS DOUBLE) AS previous_on_time_fill_rate,
         CAST(datediff('day', e.cur_rx_date, e.observation_date) AS DOUBLE) AS prescription_age_days,
         CAST(m.cnt AS DOUBLE) AS medication_prior_fill_count,
         CAST(m.avg_ds AS DOUBLE) AS medication_prior_average_days_supply,
         CAST(m.avg_q AS DOUBLE) AS medication_prior_average_quantity,
         CAST(CASE WHEN e.renewal_date IS NOT NULL AND e.renewal_date <= e.target_window_end
                   THEN 1 ELSE 0 END AS INTEGER) AS prescription_renewal_within_window
  FROM elig e JOIN medh m ON e.fill_id = m.fill_id
)"""


CANDIDATE_FEATURES = """
, daily AS (SELECT medication_id, fill_date, count(*) AS c, sum(days_supply) AS s,
                   sum(quantity_billed) AS q FROM fills GROUP BY 1, 2)
, medh_all AS (
  SELECT k.fill_id, coalesce(sum(d.c), 0) AS c, coalesce(sum(d.s), 0) AS s, coalesce(sum(d.q), 0) AS q
  FROM candidates k LEFT JOIN daily d
    ON d.medication_id = k.medication_id AND d.fill_date < k.observation_date
  GROUP BY k.fill_id)
, cand_feats AS (
  SELECT k.*, m.c - CASE WHEN k.fill_date < k.observation_date THEN 1 ELSE 0 END AS med_n,
         m.s - CASE WHEN k.fill_date < k.observation_date THEN k.days_supply ELSE 0 END AS med_s,
         m.q - CASE WHEN k.fill_date < k.observation_date THEN k.quantity_billed ELSE 0 END AS med_q
  FROM candidates k JOIN medh_all m ON k.fill_id = m.fill_id)
, requests AS (
  SELECT prescription_id AS rx_number, fill_date, observation_date,
         CAST(refills_remaining AS DOUBLE) AS current_refills_remaining,
         CAST(quantity_billed AS DOUBLE) AS current_quantity_billed,
         CAST(days_supply AS DOUBLE) AS current_days_supply,
         CAST(refill_number AS DOUBLE) AS current_refill_number,
         CAST(k AS DOUBLE) AS previous_fill_count,
         CAST(ivl AS DOUBLE) AS days_since_previous_fill,
         CAST(avg_ivl AS DOUBLE) AS average_previous_refill_interval_days,
         CASE WHEN n_ivl >= 2 THEN CAST(std_ivl AS DOUBLE) END AS std_previous_refill_interval_days,
         CAST(gap AS DOUBLE) AS latest_refill_timing_gap_days,
         CAST(avg_gap AS DOUBLE) AS average_previous_timing_gap_days,
         CAST(early_rate AS DOUBLE) AS previous_early_fill_rate,
         CAST(ontime_rate AS DOUBLE) AS previous_on_time_fill_rate,
         CAST(datediff('day', cur_rx_date, observation_date) AS DOUBLE) AS prescription_age_days,
         CAST(med_n AS DOUBLE) AS medication_prior_fill_count,
         CASE WHEN med_n > 0 THEN CAST(med_s AS DOUBLE) / med_n END AS medication_prior_average_days_supply,
         CASE WHEN med_n > 0 THEN CAST(med_q AS DOUBLE) / med_n END AS medication_prior_average_quantity
  FROM cand_feats)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)
