"""DuckDB SQL for the registered queries, written apart from the Spark plans.

``RAW`` to ``MARKS`` rebuild the marks from the test tables: positions, one row for each loan and filing, accrual, dollars,
the chosen filing.
"""

from __future__ import annotations

RAW = r"""
WITH kinds(p_type, label, kind, lien, facility, tranche, debt) AS (VALUES
  ('ECONOMY', 'First Lien Term Loan', 'FIRST_LIEN', 'FIRST', 'TERM_LOAN', 'TERM_LOAN', true),
  ('LARGE', 'Unitranche Loan', 'UNITRANCHE', 'FIRST', NULL, '', true),
  ('MEDIUM', 'Second Lien Term Loan', 'SECOND_LIEN', 'SECOND', 'TERM_LOAN', 'TERM_LOAN', true),
  ('PROMO', 'Preferred Equity', 'PREFERRED_EQUITY', 'EQUITY', NULL, '', false),
  ('SMALL', 'Subordinated Note', 'SUBORDINATED', 'SUBORDINATED', 'NOTES', 'NOTES', true),
  ('STANDARD', 'Common Equity', 'COMMON_EQUITY', 'EQUITY', NULL, '', false)
), raw AS (
  SELECT CAST(s.s_nationkey AS BIGINT) AS cik, 'F' || s.s_nationkey AS ticker, n.n_name AS bdc_name, n.n_regionkey AS region,
    last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS period_end,
    s.s_nationkey || '-' || year(l_shipdate) || 'Q' || quarter(l_shipdate) || '-' || l_linestatus AS accession,
    l_linestatus, l_orderkey * 10 + l_linenumber AS seq, p_brand AS issuer_name, replace(upper(p_brand), '#', ' ') AS canonical_name,
    kind, lien, facility, tranche, debt, p_brand || ', ' || label AS identifier, c.c_mktsegment AS industry,
    CASE WHEN cn.n_regionkey <> 4 THEN cn.n_name END AS country,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - 5 * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(24,4)) AS fv,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(24,4)) AS cost,
    CASE WHEN debt THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(24,4)) END AS principal,
    l_tax * 100 AS rate, CASE WHEN l_quantity > 40 THEN 2.0 ELSE 0.0 END :: DOUBLE AS pik,
    CAST(CAST(o_orderdate AS DATE) + to_years(CAST(1 + p_size % 10 AS INT)) AS DATE) AS maturity,
    CASE WHEN l_quantity <= 45 THEN CAST(o_orderdate AS DATE) END AS acquired,
    CASE WHEN l_quantity > 45 THEN year(o_orderdate) END AS year_acquired,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS na
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN part USING_PART JOIN kinds USING (p_type) JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n.n_nationkey
), pos AS (
  SELECT *, substr(sha1('loan|' || cik || '|' || canonical_name || '|' || kind || '|' || tranche || '|USD'), 1, 20) AS loan_id,
    substr(sha1('issuer|' || canonical_name), 1, 20) AS issuer_id,
    substr(sha1('credit|' || canonical_name || '|' || lien), 1, 20) AS credit_id
  FROM raw
)""".replace("USING_PART", "ON l_partkey = p_partkey")

MERGED = RAW + r""", merged AS (
  SELECT loan_id, accession, period_end, first(cik) AS cik, first(ticker) AS ticker, first(bdc_name) AS bdc_name, first(region) AS region,
    first(l_linestatus) AS l_linestatus, first(issuer_name) AS issuer_name, first(canonical_name) AS canonical_name, first(kind) AS kind, first(lien) AS lien,
    first(facility) AS facility, first(debt) AS debt, first(identifier) AS identifier, first(issuer_id) AS issuer_id, first(credit_id) AS credit_id,
    first(industry ORDER BY seq) AS industry, first(country ORDER BY seq) AS country, first(acquired ORDER BY seq) AS acquired,
    first(year_acquired ORDER BY seq) AS year_acquired, sum(fv) AS fv, sum(cost) AS cost, sum(principal) AS principal, max(maturity) AS maturity,
    CASE WHEN sum(fv) > 0 THEN sum(rate * CAST(fv AS DOUBLE)) / CAST(sum(fv) AS DOUBLE) ELSE avg(rate) END AS rate,
    CASE WHEN sum(fv) > 0 THEN sum(pik * CAST(fv AS DOUBLE)) / CAST(sum(fv) AS DOUBLE) ELSE avg(pik) END AS pik,
    CASE WHEN bool_or(na) THEN true ELSE first(na ORDER BY seq) END AS na, count(*) AS n
  FROM pos GROUP BY loan_id, accession, period_end
)"""

FX = MERGED + r""", accrued AS (
  SELECT * REPLACE (coalesce(na, CASE WHEN bool_or(coalesce(na, false)) OVER (PARTITION BY cik, accession, period_end) THEN false END) AS na) FROM merged
), rates(region, ccy, r) AS (VALUES (0, 'GBP', 0.79::DOUBLE), (1, 'EUR', 0.92::DOUBLE), (2, 'CAD', 1.36::DOUBLE), (3, 'ZWL', NULL), (4, NULL, 1.0::DOUBLE)
), dollars AS (
  SELECT a.*, ccy, CASE WHEN principal IS NOT NULL THEN r END AS fx_rate, CAST(principal AS DOUBLE) / r AS usd,
    CASE WHEN principal IS NOT NULL AND ccy IN ('GBP', 'EUR', 'CAD') THEN period_end - 2 END AS fx_date,
    principal IS NOT NULL AND ccy = 'ZWL' AS lost
  FROM accrued a JOIN rates USING (region)
)"""

MARKS = FX + r""", chosen AS (
  SELECT *, row_number() OVER (PARTITION BY loan_id, period_end ORDER BY l_linestatus DESC, accession) AS pick FROM dollars
), based AS (
  SELECT *, CAST(coalesce(nullif(CAST(usd AS DECIMAL(24,4)), 0), CASE WHEN principal > 0 AND (ccy IS NULL OR ccy = 'USD') THEN principal END, cost) AS DECIMAL(24,4)) AS basis
  FROM chosen WHERE pick = 1
), marked AS (
  SELECT *, CASE WHEN basis <> 0 THEN 100 * CAST(fv AS DOUBLE) / CAST(basis AS DOUBLE) END AS mark, fv - cost AS unrealized,
    CASE WHEN l_linestatus = 'F' THEN 'dera' ELSE 'xbrl' END AS source, CASE WHEN month(period_end) = 12 THEN '10-K' ELSE '10-Q' END AS form,
    period_end + CASE WHEN l_linestatus = 'F' THEN 45 ELSE 60 END AS filed
  FROM based
), v AS (
  SELECT *, concat_ws(',', CASE WHEN n > 1 THEN 'merged_' || n || '_facilities' END, CASE WHEN lost THEN 'no_fx_rate_zwl' END,
    CASE WHEN debt AND coalesce(principal, 0) = 0 THEN 'no_principal' END, CASE WHEN mark NOT BETWEEN 1 AND 200 THEN 'implausible_mark' END,
    CASE WHEN principal <> 0 AND ccy <> 'USD' THEN 'principal_in_' || lower(ccy) END) AS flags
  FROM marked
), now AS (SELECT * FROM v WHERE period_end = (SELECT max(period_end) FROM v))
"""


def money(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def pct(a: str, b: str) -> str:
    return f"round(100.0 * CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"


def when(condition: str, x: str = "fv") -> str:
    return f"sum(CASE WHEN {condition} THEN {x} END)"


def day(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d') AS {name}"


BAD_SHARE = f"CASE WHEN count(na) > 0 THEN {pct('coalesce(' + when('na') + ', 0)', 'sum(fv)')} END"
QUARTER = "year(period_end) || 'Q' || quarter(period_end)"
PROFILE = f"count(*) AS positions, {money('sum(fv)')} AS fair_value, {money('sum(basis)')} AS basis, {pct('sum(fv)', 'sum(basis)')} AS weighted_mark, {money('coalesce(' + when('na') + ', 0)')} AS nonaccrual_fv"
BY_QUARTER = f"{QUARTER} AS quarter, ticker, bdc_name, {day('min(period_end)', 'period_end')}, {pct('sum(fv)', 'sum(basis)')} AS weighted_mark, {money('sum(fv)')} AS fair_value, {money('sum(basis)')} AS basis, count(*) AS positions"
LABEL = "ticker || ':' || printf('%.1f', floor(mark * 10 + 0.500001) / 10)"
LABELS = "SELECT p_partkey, p_brand, p_size, p_retailprice, kinds.* FROM part JOIN kinds USING (p_type)"
TOP = """, held AS (SELECT cik, issuer_id, sum(fv) AS f FROM now GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY f DESC, issuer_id) AS rn, sum(f) OVER (PARTITION BY cik) AS whole FROM held),
top AS (SELECT cik, %s AS top10_pct FROM ranked WHERE rn <= 10 GROUP BY cik)""" % pct("sum(f)", "max(whole)")

SQL = {
    "v_marks": f"{MARKS} SELECT loan_id, {day('period_end', 'period_end')}, cik, ticker, bdc_name, issuer_name, canonical_name, kind AS investment_type, lien, facility, 'USD' AS currency, CAST(debt AS INT) AS is_debt, round(mark, 6) AS mark, flags FROM v",
    "dedupe_filings": f"{MARKS} SELECT loan_id, {day('period_end', 'period_end')}, accession, source, {money('fv')} AS fair_value FROM v",
    "merge_facilities": f"{MERGED} SELECT loan_id, accession, {money('fv')} AS fair_value, {money('cost')} AS cost, {money('principal')} AS principal, round(rate, 6) AS interest_rate, round(pik, 6) AS pik_rate, {day('maturity', 'maturity_date')}, CAST(na AS INT) AS is_non_accrual, industry, CASE WHEN n > 1 THEN 'merged_' || n || '_facilities' ELSE '' END AS flags FROM merged",
    "infer_accrual": f"{FX} SELECT cik, accession, count(CASE WHEN na THEN 1 END) AS \"on\", count(CASE WHEN NOT na THEN 1 END) AS off, count(CASE WHEN na IS NULL THEN 1 END) AS unknown FROM accrued GROUP BY ALL",
    "scale_anomaly": f"{RAW} SELECT cik, accession, 1000.0::DOUBLE AS factor FROM pos WHERE cik = 3 AND debt GROUP BY cik, accession, period_end HAVING count(*) >= 10",
    "fx_asof": f"{FX} SELECT cik, accession, CAST(sum(CAST(usd AS DECIMAL(24,4))) AS DOUBLE) AS principal_usd, round(max(fx_rate), 6) AS fx_rate, {day('max(fx_date)', 'fx_date')}, count(CASE WHEN lost THEN 1 END) AS lost FROM dollars GROUP BY cik, accession",
    "latest_per_quarter": f"{MARKS} SELECT cik, {QUARTER} AS quarter, count(*) AS positions, {day('max(period_end)', 'period_end')} FROM v GROUP BY ALL",
    "missing_quarters": f"{MARKS}, wanted AS (SELECT cik, last_day(CAST(d AS DATE)) AS period_end FROM (SELECT DISTINCT cik FROM v), generate_series(DATE '1995-03-01', DATE '2001-12-01', INTERVAL 3 MONTH) g(d)) SELECT cik, {day('period_end', 'period_end')} FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.cik = w.cik AND v.period_end = w.period_end)",
    "union_sources": f"{RAW} SELECT CASE WHEN l_linestatus = 'F' THEN 'dera' ELSE 'xbrl' END AS source, count(*) AS n, {money('sum(fv)')} AS fair_value FROM pos GROUP BY 1",
    "top_holdings_share": f"{MARKS} {TOP} SELECT * FROM top",
    "bdc_summary": f"""{MARKS} {TOP}, prior AS (SELECT cik, sum(fv) AS pfv FROM v WHERE period_end = (SELECT max(period_end) FROM v WHERE period_end < (SELECT max(period_end) FROM v)) GROUP BY cik),
        s AS (SELECT cik, ticker, bdc_name, count(*) AS positions, count(CASE WHEN debt THEN 1 END) AS debt_positions, {money('sum(cost)')} AS cost, {money(when('debt', 'principal'))} AS principal,
          {pct(when('debt'), when('debt', 'basis'))} AS portfolio_mark, {pct('sum(fv)', 'sum(cost)')} AS fv_over_cost, {BAD_SHARE} AS nonaccrual_pct_fv, count(CASE WHEN na THEN 1 END) AS nonaccrual_positions, count(na) AS nonaccrual_coverage,
          {pct('coalesce(' + when('pik > 0') + ', 0)', 'sum(fv)')} AS pik_pct_fv, {pct('coalesce(' + when('debt AND mark < 90') + ', 0)', when('debt'))} AS stressed_pct_fv, round(avg(rate), 6) AS avg_coupon, count(DISTINCT issuer_id) AS issuers, sum(fv) AS f
          FROM now GROUP BY cik, ticker, bdc_name)
        SELECT s.* EXCLUDE (f), top10_pct, {money('f')} AS fair_value, {money('pfv')} AS prior_fair_value, {pct('f - pfv', 'pfv')} AS fv_change_pct, (SELECT strftime(max(period_end), '%Y-%m-%d') FROM v) AS period_end FROM s LEFT JOIN prior USING (cik) LEFT JOIN top USING (cik)""",
    "nonaccrual_trend": f"{MARKS} SELECT {day('period_end', 'period_end')}, {money('coalesce(' + when('na') + ', 0)')} AS nonaccrual_fv, {money('sum(fv)')} AS total_fv, {BAD_SHARE} AS nonaccrual_pct, count(CASE WHEN na THEN 1 END) AS nonaccrual_positions, count(*) AS positions, count(na) AS coverage FROM v GROUP BY period_end",
    "nonaccrual_positions": f"{MARKS}, streak AS (SELECT loan_id, count(*) AS q, min(period_end) AS s FROM v WHERE na GROUP BY loan_id) SELECT loan_id, ticker, issuer_name, kind AS investment_type, industry, {money('fv')} AS fair_value, round(mark, 6) AS mark, q AS quarters_nonaccrual, {day('s', 'since')} FROM now JOIN streak USING (loan_id) WHERE na",
    **{
        f"nonaccrual_by_{name}": f"{MARKS} SELECT {c} AS bucket, {money(when('na'))} AS nonaccrual_fv, {money('sum(fv)')} AS total_fv, {pct(when('na'), 'sum(fv)')} AS nonaccrual_pct FROM now WHERE {c} IS NOT NULL GROUP BY 1 HAVING {when('na')} > 0"
        for name, c in (("industry", "industry"), ("bdc", "ticker"))
    },
    "mark_histogram": f"{MARKS} SELECT floor(mark / 2.5) * 2.5 AS bin, count(*) AS positions, {money('sum(fv)')} AS fair_value FROM now WHERE debt AND mark BETWEEN 0 AND 150 GROUP BY 1",
    "sector_marks": f"{MARKS} SELECT industry, {day('period_end', 'period_end')}, {pct('sum(fv)', 'sum(basis)')} AS mark, {money('sum(fv)')} AS fair_value, count(*) AS positions FROM v WHERE period_end IN (SELECT DISTINCT period_end FROM v ORDER BY 1 DESC LIMIT 8) AND debt AND basis > 0 AND industry IS NOT NULL GROUP BY industry, v.period_end HAVING count(*) >= 5",
    "maturity_wall": f"{MARKS} SELECT CAST(year(maturity) AS INT) AS year, {money('sum(fv)')} AS fair_value, {money('sum(principal)')} AS principal, count(*) AS positions, {money(when('mark < 90'))} AS stressed_fv, {money(when('na'))} AS nonaccrual_fv FROM now WHERE debt AND year(maturity) BETWEEN 2000 AND 2100 GROUP BY 1",
    "biggest_markdowns": f"{MARKS} SELECT loan_id, ticker, issuer_name, kind AS investment_type, {money('fv')} AS fair_value, {money('cost')} AS cost, {money('unrealized')} AS unrealized, {pct('unrealized', 'cost')} AS unrealized_pct FROM now WHERE cost > 0 AND unrealized < 0 ORDER BY 7, 1 LIMIT 50",
    "deteriorating": f"{MARKS} SELECT c.loan_id, c.ticker, c.issuer_name, {money('c.fv')} AS fair_value, round(c.mark, 6) AS mark, round(p.mark, 6) AS prior_mark, round(c.mark - p.mark, 6) AS mark_change FROM v c JOIN v p ON p.loan_id = c.loan_id WHERE c.period_end = DATE '2001-09-30' AND p.period_end = DATE '2001-06-30' AND c.debt AND c.fv >= 10000 AND c.mark - p.mark IS NOT NULL ORDER BY 7, 1 LIMIT 50",
    "disagreements": f"{MARKS} SELECT credit_id, min(issuer_name) AS issuer_name, count(DISTINCT cik) AS holders, round(min(mark), 6) AS low, round(max(mark), 6) AS high, round(max(mark) - min(mark), 6) AS spread, {pct('sum(fv)', 'sum(principal)')} AS weighted_mark, {money('sum(fv)')} AS fair_value, string_agg({LABEL}, ', ' ORDER BY ticker, loan_id) AS marks FROM now WHERE debt AND mark IS NOT NULL AND principal > 0 GROUP BY 1 HAVING count(DISTINCT cik) >= 2 ORDER BY 6 DESC, 1 LIMIT 100",
    "shared_credits": f"{MARKS} SELECT credit_id, min(issuer_name) AS issuer_name, count(DISTINCT cik) AS holders, {pct('sum(fv)', 'sum(principal)')} AS weighted_mark, {money('sum(fv)')} AS fair_value, string_agg(DISTINCT ticker, ', ' ORDER BY ticker) AS tickers FROM now WHERE debt GROUP BY 1 HAVING count(DISTINCT cik) >= 2",
    "quarterly_bdc_marks": f"{MARKS} SELECT {BY_QUARTER} FROM v WHERE debt AND basis > 0 GROUP BY 1, 2, 3",
    "quarterly_nonaccrual_marks": f"{MARKS} SELECT {BY_QUARTER} FROM v WHERE na AND basis > 0 GROUP BY 1, 2, 3",
    "quarterly_nonaccrual_share": f"{MARKS} SELECT {QUARTER} AS quarter, ticker, bdc_name, {day('min(period_end)', 'period_end')}, {money('sum(fv)')} AS fair_value, {money('coalesce(' + when('na') + ', 0)')} AS nonaccrual_fv, {BAD_SHARE} AS nonaccrual_pct, count(CASE WHEN na THEN 1 END) AS nonaccrual_positions, count(*) AS positions, count(na) AS coverage FROM v GROUP BY 1, 2, 3",
    "universe_mark_trend": f"{MARKS} SELECT {QUARTER} AS quarter, {pct('sum(fv)', 'sum(basis)')} AS weighted_mark, {money('sum(fv)')} AS fair_value FROM v WHERE debt AND basis > 0 GROUP BY 1",
    "vintage_profile": f"{MARKS}, born AS (SELECT loan_id, CAST(min(coalesce(year(acquired), year_acquired)) AS INT) AS vintage_year, max(period_end) AS period_end FROM v GROUP BY loan_id) SELECT vintage_year, {PROFILE} FROM v JOIN born USING (loan_id, period_end) WHERE basis > 0 GROUP BY 1",
    "maturity_profile": f"{MARKS} SELECT CAST(year(maturity) AS INT) AS maturity_year, {PROFILE} FROM now WHERE debt AND basis > 0 GROUP BY 1",
    "country_exposure": f"{MARKS} SELECT country, {money('sum(fv)')} AS fair_value, count(*) AS positions, {pct(when('debt'), when('debt', 'principal'))} AS weighted_mark FROM now GROUP BY 1",
    "bdc_positions": f"{MARKS} SELECT loan_id, issuer_id, credit_id, issuer_name, identifier, industry, country, kind AS investment_type, lien, facility, {money('fv')} AS fair_value, {money('cost')} AS cost, {money('principal')} AS principal, round(mark, 6) AS mark, round(rate, 6) AS interest_rate, round(pik, 6) AS pik_rate, {day('maturity', 'maturity_date')}, {day('acquired', 'acquisition_date')}, CAST(na AS INT) AS is_non_accrual, accession, flags FROM v WHERE period_end = DATE '2001-09-30' AND ticker = 'F1'",
    "loan_history": f"{MARKS} SELECT loan_id, {day('period_end', 'period_end')}, ticker, issuer_name, {money('fv')} AS fair_value, {money('cost')} AS cost, {money('principal')} AS principal, round(mark, 6) AS mark, {money('unrealized')} AS unrealized, round(rate, 6) AS interest_rate, CAST(na AS INT) AS is_non_accrual, {day('maturity', 'maturity_date')}, accession, form, {day('filed', 'filed_date')}, source FROM v WHERE ticker = 'F1' AND canonical_name = 'BRAND 1' AND kind = 'FIRST_LIEN'",
    "issuer_detail": f"{MARKS} SELECT issuer_id, {day('period_end', 'period_end')}, ticker, loan_id, kind AS investment_type, {money('fv')} AS fair_value, round(mark, 6) AS mark FROM v WHERE canonical_name = 'BRAND 1'",
    "search_issuers": f"{MARKS} SELECT issuer_id, min(issuer_name) AS display_name, count(DISTINCT cik) AS holders, {money(when('period_end = (SELECT max(period_end) FROM v)'))} AS fair_value FROM v WHERE canonical_name LIKE '%BRAND 1%' GROUP BY 1 ORDER BY 4 DESC NULLS LAST, 1 LIMIT 50",
    "overview": f"{MARKS}, ever AS (SELECT count(*) AS total_marks, count(DISTINCT loan_id) AS total_loans, string_agg(DISTINCT strftime(period_end, '%Y-%m-%d'), ',' ORDER BY strftime(period_end, '%Y-%m-%d')) AS periods, strftime(max(period_end), '%Y-%m-%d') AS period_end FROM v) SELECT n.*, ever.* FROM (SELECT count(*) AS positions, count(DISTINCT cik) AS bdcs, count(DISTINCT issuer_id) AS issuers, {money('sum(fv)')} AS fair_value, {money(when('debt', 'principal'))} AS principal, {pct(when('debt'), when('debt', 'principal'))} AS mark, {pct('coalesce(' + when('na') + ', 0)', 'sum(fv)')} AS nonaccrual_pct FROM now) n, ever",
    "dataset_stats": f"{MARKS} SELECT count(*) AS marks, count(DISTINCT period_end) AS periods, count(DISTINCT accession) AS filings, {day('min(period_end)', 'first_period')}, {day('max(period_end)', 'last_period')}, count(DISTINCT loan_id) AS loans, count(DISTINCT CASE WHEN debt THEN loan_id END) AS debt_loans, count(DISTINCT issuer_id) AS issuers, count(DISTINCT cik) AS bdcs, (SELECT {money('sum(fv)')} FROM now) AS latest_fair_value FROM v",
    "export_meta": f"{MARKS} SELECT bool_and(source = 'demo') AS synthetic, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, (SELECT string_agg(DISTINCT ticker, ',' ORDER BY ticker) FROM now) AS tickers, {day('max(period_end)', 'period_end')} FROM v",
    "quality_summary": f"{MARKS}, f AS (SELECT unnest(string_split(flags, ',')) AS flag, debt, mark FROM v WHERE flags <> '') SELECT flag, count(*) AS positions, count(CASE WHEN debt THEN 1 END) AS debt_positions, count(mark) AS with_mark FROM f GROUP BY 1",
    "marks_export": f"{MARKS}, known AS (SELECT loan_id, min(acquired) AS a, min(industry) AS i, min(country) AS c, min(maturity) AS m FROM v GROUP BY 1) SELECT loan_id, {day('period_end', 'period_end')}, ticker, bdc_name, issuer_name, identifier, coalesce(industry, i) AS industry, coalesce(country, c) AS country, kind AS investment_type, lien, facility, {day('coalesce(acquired, a)', 'acquisition_date')}, {day('coalesce(maturity, m)', 'maturity_date')}, {money('fv')} AS fair_value, {money('cost')} AS cost, {money('principal')} AS principal, ccy AS principal_ccy, round(usd, 2) AS principal_usd, round(mark, 6) AS mark, {money('unrealized')} AS unrealized, round(rate / 100, 8) AS interest_rate, round(pik / 100, 8) AS pik_rate, CASE WHEN na THEN 'Yes' WHEN NOT na THEN 'No' ELSE 'Not disclosed' END AS non_accrual, accession, form, {day('filed', 'filed_date')}, source, flags FROM v JOIN known USING (loan_id)",
    "bdc_sheet": f"{MARKS} SELECT coalesce(ticker, 'Total') AS ticker, count(*) AS positions, {money('sum(fv)')} AS fair_value, {money('sum(cost)')} AS cost, {money('sum(principal)')} AS principal, {pct(when('debt'), when('debt', 'principal'))} AS mark, CASE WHEN count(na) > 0 THEN {money('coalesce(' + when('na') + ', 0)')} END AS nonaccrual_fv FROM now GROUP BY ROLLUP (ticker)",
    "quarter_grid": f"{MARKS} SELECT ticker, bdc_name, " + ", ".join(f"round(100.0 * CAST(sum(fv) FILTER ({QUARTER} = '{q}') AS DOUBLE) / CAST(sum(basis) FILTER ({QUARTER} = '{q}') AS DOUBLE), 6) AS \"{q}\"" for q in (f"{y}Q{n}" for y in range(1995, 2002) for n in range(1, 5))) + " FROM v WHERE debt AND basis > 0 GROUP BY 1, 2",
    "quarter_grid_all": f"{MARKS}, q AS (SELECT {QUARTER} AS quarter, ticker, bdc_name, {pct('sum(fv)', 'sum(basis)')} AS weighted_mark FROM v WHERE debt AND basis > 0 GROUP BY 1, 2, 3) SELECT ticker, bdc_name, count(*) AS quarters, string_agg(quarter || '=' || printf('%.6f', weighted_mark), ' ' ORDER BY quarter) AS marks FROM q GROUP BY 1, 2",
    "positions_filter": f"{MARKS} SELECT loan_id, ticker, issuer_name, industry, kind AS investment_type, facility FROM now WHERE contains(lower(concat_ws('|', issuer_name, industry, kind, facility)), 'lien')",
    "periods": f"{MARKS} SELECT DISTINCT {day('period_end', 'period_end')} FROM v",
    "identity_keys": f"{RAW}, l AS ({LABELS}) SELECT p_partkey, substr(sha1('issuer|' || replace(upper(p_brand), '#', ' ')), 1, 20) AS issuer_id, substr(sha1('credit|' || replace(upper(p_brand), '#', ' ') || '|' || lien), 1, 20) AS credit_id, substr(sha1('loan|7|' || replace(upper(p_brand), '#', ' ') || '|' || kind || '|' || tranche || '|USD'), 1, 20) AS loan_id FROM l",
    "instrument_classify": f"{RAW}, l AS ({LABELS}) SELECT p_partkey, kind AS investment_type, lien, CAST(debt AS INT) AS is_debt FROM l",
    "facility_kind": f"{RAW}, l AS ({LABELS}) SELECT p_partkey, facility FROM l",
    "identifier_split": f"{RAW}, l AS ({LABELS}) SELECT p_partkey, p_brand AS issuer_name, label AS rest FROM l",
    "issuer_canonical": "SELECT c_custkey, trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) || ' AND SONS HOLDINGS L L C' AS canonical_name FROM customer",
    "tranche_signature": "SELECT p_partkey, 'TERM_LOAN/' || substr('ABCDEFGH', CAST(p_size % 8 + 1 AS INT), 1) || '/FIRST_OUT' AS tranche FROM part",
    "label_strip_noise": "SELECT p_partkey, trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')) || ' TERM LOAN' AS label FROM part",
    "label_reference_rate": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'TERM SOFR' WHEN 1 THEN 'SOFR' WHEN 2 THEN 'LIBOR' WHEN 3 THEN 'PRIME' END AS reference_rate FROM part",
    "rate_normalise": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN CAST('0.' || lpad(CAST(p_partkey * 37 % 100000000 AS VARCHAR), 8, '0') AS DOUBLE) * 100 WHEN p_partkey % 3 = 2 THEN CAST('0.' || lpad(CAST(p_partkey * 41 % 100000 AS VARCHAR), 5, '0') AS DOUBLE) * -100 ELSE CAST(CASE WHEN abs(p_size - 25) <= 1.5 THEN (p_size - 25) * 100 ELSE p_size - 25 END AS DOUBLE) END AS rate FROM part",
    "country_canonical": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'North America' WHEN 4 THEN 'Germany' END AS country FROM nation",
    "maturity_in_label": "SELECT p_partkey, strftime(make_date(2029, CAST(p_size % 12 + 1 AS BIGINT), 15), '%Y-%m-%d') AS maturity_date FROM part",
    "amounts": "SELECT p_partkey, -CAST(CAST(round(p_retailprice, 2) AS DECIMAL(24,4)) AS DOUBLE) AS amount FROM part",
    "restatements": f"{RAW}, p AS (SELECT loan_id, accession, period_end, fv, CASE WHEN seq % 3 <> 0 THEN principal END AS principal, CASE WHEN seq % 3 <> 0 THEN cost END AS cost FROM pos), w AS (SELECT *, bool_or(principal IS NOT NULL OR cost IS NOT NULL) OVER g AS told, count(*) OVER g AS was FROM p WINDOW g AS (PARTITION BY loan_id, accession, period_end)) SELECT loan_id, accession, {money('sum(fv)')} AS fair_value, {money('sum(cost)')} AS cost, {money('sum(principal)')} AS principal, CASE WHEN max(was) > 1 THEN 'merged_' || count(*) || '_facilities' ELSE '' END AS flags FROM w WHERE NOT told OR principal IS NOT NULL OR cost IS NOT NULL GROUP BY loan_id, accession, period_end",
    "scale_applied": f"{RAW}, g AS (SELECT *, count(CASE WHEN debt THEN 1 END) OVER (PARTITION BY cik, accession, period_end) >= 10 AS many FROM pos) SELECT cik, accession, {money('sum(principal * CASE WHEN cik = 3 AND NOT many THEN 1000 ELSE 1 END)')} AS principal, {money('sum(cost * CASE WHEN cik = 3 AND NOT many THEN 1000 ELSE 1 END)')} AS cost, count(CASE WHEN cik = 3 AND many THEN 1 END) AS mended FROM g GROUP BY cik, accession",
    "fx_stale": f"{MERGED} SELECT cik, accession, CAST(sum(CAST(CAST(principal AS DOUBLE) / CASE region WHEN 0 THEN 0.79 WHEN 1 THEN 0.92 WHEN 4 THEN 1.0 END AS DECIMAL(24,4))) AS DOUBLE) AS principal_usd, strftime(max(CASE WHEN principal IS NOT NULL AND region = 0 THEN period_end WHEN principal IS NOT NULL AND region = 1 THEN period_end - 5 END), '%Y-%m-%d') AS fx_date, count(CASE WHEN principal IS NOT NULL AND region IN (2, 3) THEN 1 END) AS lost FROM merged GROUP BY cik, accession",
    "window_filter": f"{RAW} SELECT {day('period_end', 'period_end')}, count(*) AS n FROM pos WHERE period_end BETWEEN DATE '1998-01-01' AND DATE '2000-08-15' GROUP BY period_end",
    "quarter_gaps": f"{MARKS}, wanted AS (SELECT cik, year(d) || 'Q' || quarter(d) AS quarter FROM (SELECT DISTINCT cik FROM v), generate_series(DATE '1996-01-01', DATE '2000-10-01', INTERVAL 3 MONTH) g(d)) SELECT cik, quarter FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.cik = w.cik AND {QUARTER} = w.quarter AND quarter(v.period_end) <> v.cik % 4 + 1)",
    "upsert_marks": f"{FX}, f AS (SELECT * FROM dollars WHERE l_linestatus = 'F'), o AS (SELECT * FROM dollars WHERE l_linestatus <> 'F') SELECT coalesce(o.loan_id, f.loan_id) AS loan_id, strftime(coalesce(o.period_end, f.period_end), '%Y-%m-%d') AS period_end, CASE WHEN o.loan_id IS NULL THEN 'dera' ELSE 'xbrl' END AS source, coalesce(o.accession, f.accession) AS accession, coalesce(o.country, f.country) AS country, CAST(coalesce(o.na, f.na) AS INT) AS is_non_accrual, CAST(coalesce(o.fv, f.fv) AS DOUBLE) AS fair_value FROM f FULL JOIN o ON f.loan_id = o.loan_id AND f.period_end = o.period_end",
    "upsert_loans": f"{FX} SELECT loan_id, min(cik) AS cik, min(identifier) AS identifier, min(kind) AS investment_type, {day('min(period_end)', 'first_period')}, {day('max(period_end)', 'last_period')} FROM dollars GROUP BY loan_id",
    "upsert_issuers": f"{RAW} SELECT issuer_id, min(canonical_name) AS canonical_name, min(issuer_name) AS display_name FROM pos GROUP BY issuer_id",
    "upsert_filers": f"{RAW} SELECT DISTINCT cik, ticker, bdc_name AS name FROM pos",
    "upsert_filings": f"{RAW} SELECT DISTINCT accession, cik, CASE WHEN month(period_end) = 12 THEN '10-K' ELSE '10-Q' END AS form, {day('period_end', 'period_end')}, strftime(period_end + CASE WHEN l_linestatus = 'F' THEN 45 ELSE 60 END, '%Y-%m-%d') AS filed_date, CASE WHEN l_linestatus = 'F' THEN 'dera' ELSE 'xbrl' END AS source FROM pos",
    "bulk_positions": "SELECT p_partkey % 5 AS cik, 'Maker ' || p_partkey || ' LLC' AS issuer_name, 'SECOND_LIEN' AS investment_type, CASE WHEN p_size % 2 = 0 THEN 'Germany' ELSE 'Canada' END AS country, '2001-09-30' AS period_end, CAST(CAST(p_retailprice AS DECIMAL(24,2)) AS DOUBLE) AS fair_value, round(CAST('0.' || lpad(CAST(p_partkey * 37 % 100000000 AS VARCHAR), 8, '0') AS DOUBLE) * 100, 9) AS interest_rate, substr(sha1('loan|' || p_partkey % 5 || '|MAKER ' || p_partkey || '|SECOND_LIEN|TERM_LOAN|USD'), 1, 20) AS loan_id FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 IN (1, 2, 3)",
    "facts_pivot": "SELECT 'Maker ' || p_partkey || ', First Lien Term Loan' AS identifier, p_type AS industry, CAST(CAST(p_retailprice AS DECIMAL(24,4)) AS DOUBLE) AS fair_value, CAST(CAST(p_retailprice * 2 AS DECIMAL(24,4)) AS DOUBLE) AS principal, 'EUR' AS principal_ccy, round(p_size / 1024.0::DOUBLE * CASE WHEN p_size / 1024.0 <= 1.5 THEN 100 ELSE 1 END, 9) AS interest_rate, CASE WHEN p_partkey % 4 = 0 THEN 1 END AS is_non_accrual FROM part",
    "concept_census": "SELECT * FROM (SELECT 'concept' AS what, unnest(['us-gaap:InvestmentOwnedAtFairValue', 'us-gaap:InvestmentOwnedBalancePrincipalAmount', 'us-gaap:InvestmentInterestRate']) AS name, unnest([2, 1, 1]) * (SELECT count(*) FROM part) AS facts UNION ALL SELECT 'axis', unnest(['us-gaap_InvestmentIdentifierAxis', 'us-gaap_IndustrySectorAxis']), 4 * (SELECT count(*) FROM part)) WHERE facts > 0",
    "newest_filings": f"{MARKS}, f AS (SELECT DISTINCT cik, accession, filed FROM v WHERE filed >= DATE '1999-01-01') SELECT cik, accession, {day('filed', 'filed_date')} FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) AS i FROM f) WHERE i <= 3",
    "schedule_rows": "SELECT 's' || p_partkey % 50 AS accession, 'Maker ' || p_partkey || ' LLC' AS issuer, 'Timber' AS industry, 'Term Loan' AS instrument, strftime(make_date(1999, p_size % 12 + 1, 15), '%Y-%m-%d') AS acquisition_date, '2029-06-30' AS maturity_date, round(p_retailprice) AS fair_value, round(p_retailprice) AS cost FROM part WHERE p_partkey % 50 IN (SELECT p_partkey % 50 FROM part GROUP BY 1 HAVING count(*) >= 3)",
    "schedule_enrich": "SELECT p_partkey AS seq, 'Timber' AS industry, CASE WHEN p_partkey % 7 <> 0 THEN strftime(make_date(1999, p_size % 12 + 1, 15), '%Y-%m-%d') END AS acquisition_date, CASE WHEN p_partkey % 7 <> 0 THEN '2029-06-30' END AS maturity_date, CASE WHEN p_partkey % 7 = 0 THEN 1999 END AS year_acquired, CASE WHEN p_partkey % 7 = 0 THEN 2029 END AS year_matures, 'enriched_from_schedule' AS flags FROM part",
    "schedule_report": "SELECT 's' || p_partkey % 50 AS accession, CASE WHEN p_partkey % 7 = 0 THEN 'no_row_within_reach' ELSE 'matched' END AS outcome, count(*) AS positions FROM part GROUP BY 1, 2",
    "schedule_coverage": "SELECT 's' || p_partkey % 50 AS accession, count(*) AS rows, 1.0::DOUBLE AS industry, 0.0::DOUBLE AS country, 1.0::DOUBLE AS maturity_date, 1.0::DOUBLE AS acquisition_date, 1.0::DOUBLE AS fair_value, 1.0::DOUBLE AS cost, 0.0::DOUBLE AS principal FROM part GROUP BY 1 HAVING count(*) >= 3",
    "currency_and_accrual": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'CAD' WHEN 5 THEN 'NOK' ELSE 'USD' END AS currency, CASE WHEN p_partkey % 7 IN (0, 3) THEN 1 END AS is_non_accrual, CASE p_partkey % 7 WHEN 0 THEN 'OTHER_DEBT' WHEN 1 THEN 'OTHER_DEBT' WHEN 2 THEN 'WARRANT' WHEN 3 THEN 'PREFERRED_EQUITY' WHEN 4 THEN 'STRUCTURED' WHEN 5 THEN 'THIRD_LIEN' ELSE 'MEZZANINE' END AS investment_type, CASE p_partkey % 7 WHEN 2 THEN 'EQUITY' WHEN 3 THEN 'EQUITY' WHEN 5 THEN 'THIRD' WHEN 6 THEN 'SUBORDINATED' ELSE 'NA' END AS lien FROM part",
}
