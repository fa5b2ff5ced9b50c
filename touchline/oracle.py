"""Independent SQL for every registered query, runnable by DuckDB on the raw
shared tables.  Written directly from the statement semantics (window
functions, plain joins), not from the Spark operators, so that the two agree
only when both are right."""

from __future__ import annotations

# Event log derived from `events` (FIXTURES.md §1), flat form.
PIXEL = r"""
b AS (
  SELECT event_id, event_type, value,
         cast(floor(cast(floor(epoch(ts)) AS bigint) / 3600) * 3600 AS bigint) AS t,
         'u' || cast(user_id AS varchar) AS u,
         's' || cast(user_id % 5 AS varchar) AS shop,
         'ip' || cast(user_id // 7 AS varchar) AS ip,
         cast(json_extract_string(props, '$.k') AS bigint) AS k
  FROM events),
pixel AS (
  SELECT event_id, t AS "timestamp", u AS userId, shop AS shopifyShopURL, ip,
         CASE WHEN event_type = 'purchase'
              THEN 'o' || cast(cast(floor(event_id / 8) AS bigint) AS varchar) END AS shopifyOrderId,
         CASE WHEN event_type = 'purchase' THEN value END AS shopifyOrderTotalPrice,
         date '2022-10-01' + cast(event_id % 270 AS integer) AS shopifyOrderProcessedAt,
         CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND k >= 90)
              THEN 'thank_you' ELSE 'product' END AS shopifyPageType,
         CASE WHEN k < 30 THEN NULL WHEN k < 35 THEN ''
              WHEN k < 50 THEN 'https://www.google.com/search'
              WHEN k < 60 THEN 'https://l.facebook.com/'
              WHEN k < 65 THEN 'https://instagram.com/'
              ELSE 'https://shop.example/p' || cast(k % 7 AS varchar) END AS pageReferrer,
         CASE WHEN k % 10 = 3 THEN 'attentive' END AS utmSource,
         CASE WHEN k % 4 = 0 THEN 'email' END AS utmMedium,
         CASE WHEN k % 6 = 0 THEN 'c' || cast(k % 3 AS varchar) END AS utmCampaign
  FROM b)"""

ORDERS_TOUCHES = r"""
o AS (
  SELECT event_id AS o_eid, "timestamp" AS o_ts, userId AS o_user, shopifyShopURL AS o_shop,
         ip AS o_ip, shopifyOrderId, shopifyOrderProcessedAt, shopifyOrderTotalPrice
  FROM pixel WHERE shopifyOrderId IS NOT NULL),
t AS (
  SELECT event_id AS t_eid, "timestamp" AS t_ts, userId AS t_user, shopifyShopURL AS t_shop,
         ip AS t_ip,
         coalesce(utmSource,
           CASE WHEN pageReferrer IS NULL OR pageReferrer = '' THEN 'direct'
                WHEN pageReferrer LIKE '%google%' THEN 'google'
                WHEN pageReferrer LIKE '%facebook%' THEN 'facebook'
                WHEN pageReferrer LIKE '%instagram%' THEN 'instagram'
                ELSE 'referral' END) AS attribution_source,
         pageReferrer, utmMedium, utmCampaign
  FROM pixel)"""


def _last_click(days: int) -> str:
    return f"""
cj AS (
  SELECT o.*, t.*,
         CASE WHEN o_user = t_user THEN 'userId_match'
              WHEN o_ip = t_ip AND o_ts = t_ts THEN 'ip_match' ELSE 'no_match' END AS match_type,
         CASE WHEN t_ts <= o_ts AND t_ts >= o_ts - {days}*24*60*60 THEN 1 ELSE 0 END
           AS is_within_lookback
  FROM o JOIN t ON o_ip = t_ip AND o_ts = t_ts AND o_shop = t_shop
  WHERE t_ts <= o_ts),
lca AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY shopifyOrderId
                                 ORDER BY t_ts DESC, t_eid, o_eid) AS rn
    FROM cj WHERE is_within_lookback = 1) x
  WHERE rn = 1)"""


def _report(days: int) -> str:
    return f"""
report AS (
  SELECT o_shop AS STORE,
         cast(date_trunc('month', cast(shopifyOrderProcessedAt AS date)) AS date) AS MONTH,
         attribution_source AS ATTRIBUTION_SOURCE, pageReferrer AS PAGEREFERRER,
         coalesce(utmMedium, 'none') AS MEDIUM, coalesce(utmCampaign, 'none') AS CAMPAIGN,
         count(DISTINCT shopifyOrderId) AS ATTRIBUTED_ORDERS,
         cast(round(sum(cast(shopifyOrderTotalPrice AS decimal(28,10))), 2) AS double)
           AS ATTRIBUTED_REVENUE
  FROM lca GROUP BY 1, 2, 3, 4, 5, 6)"""


def _last_click_user(days: int) -> str:
    return f"""
cj AS (
  SELECT o.*, t.*,
         CASE WHEN o_user = t_user THEN 'userId_match'
              WHEN o_ip = t_ip AND o_ts = t_ts THEN 'ip_match' ELSE 'no_match' END AS match_type
  FROM o JOIN t ON o_user = t_user AND t_ts <= o_ts AND t_ts >= o_ts - {days}*24*60*60),
lca AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY shopifyOrderId
                                 ORDER BY t_ts DESC, t_eid, o_eid) AS rn
    FROM cj) x
  WHERE rn = 1)"""


CJM = r"""
cj2 AS (
  SELECT shopifyOrderId, o_shop, attribution_source,
         row_number() OVER (PARTITION BY shopifyOrderId ORDER BY t_ts, t_eid, o_eid) AS step
  FROM o JOIN t ON o_ip = t_ip AND o_ts = t_ts
  WHERE t_ts <= o_ts),
cjm AS (
  SELECT shopifyOrderId AS SHOPIFYORDERID, o_shop AS SHOPIFYSHOPURL,
         step AS TOUCHPOINT_STEP, attribution_source AS ATTRIBUTION_SOURCE
  FROM cj2)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def attribution_model(days: int) -> str:
    return with_ctes(PIXEL, ORDERS_TOUCHES, _last_click(days), _report(days),
                     body="SELECT * FROM report")


SQL: dict[str, str] = {}

SQL["orders_per_month_store"] = with_ctes(PIXEL, body="""
SELECT shopifyShopURL AS STORE,
       strftime(date_trunc('month', cast(shopifyOrderProcessedAt AS timestamp)), '%Y-%m-%d') AS MONTH,
       count(DISTINCT shopifyOrderId) AS ORDER_COUNT
FROM pixel WHERE shopifyPageType = 'thank_you'
GROUP BY 1, 2""")

SQL["attribution_report"] = attribution_model(90)
SQL["attribution_report_180"] = attribution_model(180)

SQL["last_touch"] = with_ctes(PIXEL, ORDERS_TOUCHES, _last_click(90), body="""
SELECT shopifyOrderId, o_shop AS shopifyShopURL,
       strftime(shopifyOrderProcessedAt, '%Y-%m-%d') AS shopifyOrderProcessedAt,
       cast(cast(shopifyOrderTotalPrice AS decimal(28,10)) AS double) AS shopifyOrderTotalPrice,
       attribution_source, pageReferrer, utmMedium, utmCampaign, match_type,
       t_ts AS touchpoint_timestamp
FROM lca""")

SQL["touch_journey"] = with_ctes(PIXEL, ORDERS_TOUCHES, CJM, body="SELECT * FROM cjm")


def _model90(body: str) -> str:
    return with_ctes(PIXEL, ORDERS_TOUCHES, _last_click(90), _report(90), body=body)


def _cjm(body: str) -> str:
    return with_ctes(PIXEL, ORDERS_TOUCHES, CJM, body=body)


SQL["source_share"] = _model90("""
SELECT ATTRIBUTION_SOURCE, ATTRIBUTED_ORDERS,
       cast(ATTRIBUTED_ORDERS AS double) / cast(sum(ATTRIBUTED_ORDERS) OVER () AS double) * 100.0
         AS PERCENTAGE
FROM (SELECT ATTRIBUTION_SOURCE, cast(sum(ATTRIBUTED_ORDERS) AS bigint) AS ATTRIBUTED_ORDERS
      FROM report WHERE ATTRIBUTION_SOURCE IS NOT NULL GROUP BY 1) s""")

SQL["monthly_by_source"] = _model90("""
SELECT MONTH, ATTRIBUTION_SOURCE,
       cast(sum(ATTRIBUTED_ORDERS) AS bigint) AS ATTRIBUTED_ORDERS,
       cast(sum(cast(trunc(ATTRIBUTED_REVENUE) AS bigint)) AS bigint) AS ATTRIBUTED_REVENUE
FROM report WHERE MONTH IS NOT NULL AND ATTRIBUTION_SOURCE IS NOT NULL
GROUP BY 1, 2""")

SQL["referrer_contribution"] = _model90("""
SELECT PAGEREFERRER,
       cast(sum(ATTRIBUTED_ORDERS) AS bigint) AS total_orders,
       cast(sum(cast(trunc(ATTRIBUTED_REVENUE) AS bigint)) AS bigint) AS total_revenue
FROM report WHERE PAGEREFERRER IS NOT NULL
GROUP BY 1""")

SQL["source_edges"] = _model90("""
SELECT ATTRIBUTION_SOURCE AS SOURCE,
       cast(dense_rank() OVER (ORDER BY ATTRIBUTION_SOURCE) - 1 AS bigint) AS SOURCE_INDEX,
       'Purchase' AS TARGET,
       cast(count(*) OVER () AS bigint) AS TARGET_INDEX,
       VALUE
FROM (SELECT ATTRIBUTION_SOURCE, cast(sum(ATTRIBUTED_ORDERS) AS bigint) AS VALUE
      FROM report WHERE ATTRIBUTION_SOURCE IS NOT NULL GROUP BY 1) s""")

SQL["touch_step_orders"] = _cjm("""
SELECT TOUCHPOINT_STEP, ATTRIBUTION_SOURCE, count(DISTINCT SHOPIFYORDERID) AS ORDER_COUNT
FROM cjm WHERE TOUCHPOINT_STEP IS NOT NULL AND ATTRIBUTION_SOURCE IS NOT NULL
GROUP BY 1, 2""")

SQL["touch_funnel"] = _cjm("""
SELECT ATTRIBUTION_SOURCE, TOUCHPOINT_STEP, ORDER_COUNT,
       cast(ORDER_COUNT AS double)
         / cast(first_value(ORDER_COUNT) OVER (PARTITION BY ATTRIBUTION_SOURCE
                                                ORDER BY TOUCHPOINT_STEP) AS double) * 100.0
         AS PERCENT_INITIAL
FROM (SELECT ATTRIBUTION_SOURCE, TOUCHPOINT_STEP, count(DISTINCT SHOPIFYORDERID) AS ORDER_COUNT
      FROM cjm WHERE SHOPIFYORDERID IS NOT NULL AND TOUCHPOINT_STEP < 10
      GROUP BY 1, 2) s""")


# --- campaigns / market / tenants (FIXTURES.md §2-4) ----------------------------

def _icp_orders(least: int) -> str:
    return ("count(DISTINCT CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 "
            f"AND l_quantity >= {least} THEN l_orderkey END)")


OUTBOUND = f"""
outbound AS (
  SELECT p_brand || '/' || p_type AS CAMPAIGN_GROUP,
         cast(min(l_shipdate) AS date) AS CAMPAIGN_START_DATE,
         cast(max(l_shipdate) AS date) AS CAMPAIGN_LAST_DATE,
         cast(sum(l_linenumber) AS bigint) AS NB_EMAILS,
         count(*) AS NB_CONTACTS_TOUCHED,
         count(DISTINCT l_orderkey) AS NB_COMPANIES_TOUCHED,
         count(*) FILTER (l_quantity >= 25) AS TOTAL_NB_CLICKS,
         count(*) FILTER (l_returnflag = 'A') AS TOTAL_NB_POSITIVE_REPLIES_PER_CAMPAIGN,
         count(*) FILTER (l_returnflag = 'N') AS TOTAL_NB_NEGATIVE_REPLIES_PER_CAMPAIGN,
         count(DISTINCT l_orderkey) FILTER (l_quantity >= 40) AS NB_COMPANIES_CLICKED,
         count(DISTINCT l_orderkey) FILTER (l_quantity >= 50) AS NB_CUSTOMERS_FROM_OB_ALL_TIME,
         cast(sum(cast(floor(l_extendedprice) AS bigint)) AS bigint)
           AS PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME,
         cast(floor(sum(cast(floor(l_quantity) AS bigint)) / 500.0) * 500 AS bigint)
           AS NEW_ARR_FROM_OB_ALL_TIME,
         {_icp_orders(45)} AS NB_COMPANIES_TOUCHED_ICP,
         {_icp_orders(46)} AS NB_COMPANIES_CLICKED_ICP,
         {_icp_orders(48)} AS NB_COMPANIES_REPLIED_ICP,
         {_icp_orders(49)} AS NB_COMPANIES_REPLIED_POSITIVE_ICP,
         {_icp_orders(46)} AS "NB_COMPANIES_CLICKED_ICP.1",
         {_icp_orders(48)} AS "NB_COMPANIES_REPLIED_ICP.1",
         {_icp_orders(49)} AS "NB_COMPANIES_REPLIED_POSITIVE_ICP.1"
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1),
ob AS (SELECT DISTINCT * FROM outbound),
obf AS (
  SELECT *, datediff('day', CAMPAIGN_START_DATE, CAMPAIGN_LAST_DATE) AS CAMPAIGN_LENGTH FROM ob),
obt AS (
  SELECT * EXCLUDE ("NB_COMPANIES_CLICKED_ICP.1", "NB_COMPANIES_REPLIED_ICP.1",
                    "NB_COMPANIES_REPLIED_POSITIVE_ICP.1")
  FROM obf)"""

MARKET = r"""
market AS (
  SELECT CASE WHEN c_custkey % 4 = 0 THEN 'Shopify' ELSE c_mktsegment END AS PLATFORM,
         n_name AS COUNTRY,
         CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN g < 1000000 THEN 'a) < $1M'
              WHEN g < 3000000 THEN 'b) $1M - $3M' ELSE 'c) > $3M' END AS GMV_CATEGORY,
         g AS TOTAL_GMV, g / n AS AVG_GMV, cast(n AS double) AS NB_DOMAINS,
         cast(floor(c_acctbal) AS bigint) AS "POLAR ARR ($)"
  FROM (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, count(*) AS n,
               cast(sum(cast(floor(o_totalprice) AS bigint)) AS double) AS g
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4) x
  JOIN nation ON c_nationkey = n_nationkey),
mk AS (SELECT DISTINCT * FROM market),
mkf AS (SELECT * FROM mk WHERE GMV_CATEGORY IS NOT NULL),
scope AS (
  SELECT * FROM mk
  WHERE PLATFORM = 'Shopify' AND GMV_CATEGORY IS DISTINCT FROM 'a) < $1M'
    AND "POLAR ARR ($)" > 0)"""

TENANTS = r"""
tenants AS (SELECT c_nationkey AS TENANT_ID, c_custkey AS DATASOURCE_ID FROM customer)"""


def pdiv(n: str, d: str) -> str:
    """pandas float division in SQL: 0/0 NULL, x/0 +-inf."""
    return (f"(CASE WHEN ({d}) = 0 THEN (CASE WHEN ({n}) = 0 THEN NULL WHEN ({n}) > 0 "
            f"THEN 'inf'::double ELSE '-inf'::double END) "
            f"ELSE cast({n} AS double) / cast({d} AS double) END)")


def _describe(rel: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS COLUMN_NAME, cast(\"{c}\" AS double) AS VALUE FROM {rel}" for c in cols)
    return f"""
SELECT COLUMN_NAME, cast(count(VALUE) AS double) AS count, round(avg(VALUE), 6) AS mean,
       round(stddev_samp(VALUE), 6) AS std, min(VALUE) AS min,
       quantile_cont(VALUE, 0.25) AS p25, quantile_cont(VALUE, 0.5) AS p50,
       quantile_cont(VALUE, 0.75) AS p75, max(VALUE) AS max
FROM ({long}) l
WHERE VALUE IS NOT NULL AND NOT isnan(VALUE)
GROUP BY 1"""


def _unique(rel: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS COLUMN_NAME, cast(count(DISTINCT \"{c}\") AS varchar) AS UNIQUE_VALUES "
        f"FROM {rel}" for c in cols)


def _ob(body: str) -> str:
    return with_ctes(OUTBOUND, body=body)


def _mk(body: str) -> str:
    return with_ctes(MARKET, body=body)   # a body that starts with a comma adds relations


def _obmk(body: str) -> str:
    return with_ctes(OUTBOUND, MARKET, body=body)


_PARETO = """
pareto AS (
  SELECT CAMPAIGN_GROUP, NEW_ARR_FROM_OB_ALL_TIME, CUMULATIVE_NEW_ARR,
         CASE WHEN CUMULATIVE_NEW_ARR <= 0.8::double * total THEN 'Top 80%' ELSE 'Other' END
           AS COLOR_LABEL
  FROM (SELECT *,
               cast(sum(NEW_ARR_FROM_OB_ALL_TIME) OVER (
                      ORDER BY NEW_ARR_FROM_OB_ALL_TIME DESC NULLS LAST, CAMPAIGN_GROUP
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint)
                 AS CUMULATIVE_NEW_ARR,
               cast(sum(NEW_ARR_FROM_OB_ALL_TIME) OVER () AS double) AS total
        FROM ob) x)"""

SQL["pareto"] = with_ctes(OUTBOUND, _PARETO, body="SELECT * FROM pareto")

SQL["pareto_summary"] = with_ctes(OUTBOUND, _PARETO, body="""
SELECT NUM_CAMPAIGNS_TOP, NUM_CAMPAIGNS,
       cast(NUM_CAMPAIGNS_TOP AS double) / cast(NUM_CAMPAIGNS AS double) * 100.0
         AS PERCENT_CAMPAIGNS_TOP,
       printf('%.0f', cast(NUM_CAMPAIGNS_TOP AS double) / cast(NUM_CAMPAIGNS AS double) * 100.0)
         || '% of Campaigns Account for 80% of Total New ARR' AS TITLE
FROM (SELECT count(*) FILTER (WHERE COLOR_LABEL = 'Top 80%') AS NUM_CAMPAIGNS_TOP,
             count(*) AS NUM_CAMPAIGNS FROM pareto) s""")

SQL["tam_rollup"] = _mk(f"""
SELECT GMV_CATEGORY, COUNTRY, grouping(GMV_CATEGORY, COUNTRY) AS LEVEL,
       cast(sum("POLAR ARR ($)") AS bigint) AS "POLAR ARR ($)",
       {pdiv('cast(sum(cast("POLAR ARR ($)" AS hugeint) * "POLAR ARR ($)") AS double)',
             'sum("POLAR ARR ($)")')} AS COLOR_VALUE
FROM scope GROUP BY ROLLUP (GMV_CATEGORY, COUNTRY)""")

SQL["tam_share"] = _mk(f"""
SELECT 'NATION_0' AS COUNTRY, POTENTIAL_ARR, COUNTRY_ARR,
       {pdiv('COUNTRY_ARR', 'POTENTIAL_ARR')} * 100 AS COUNTRY_SHARE,
       '$' || format('{{:,}}', POTENTIAL_ARR) AS POTENTIAL_ARR_TEXT,
       printf('%.0f', {pdiv('COUNTRY_ARR', 'POTENTIAL_ARR')} * 100) || '%' AS COUNTRY_SHARE_TEXT
FROM (SELECT cast(coalesce(sum("POLAR ARR ($)"), 0) AS bigint) AS POTENTIAL_ARR,
             cast(coalesce(sum(CASE WHEN COUNTRY = 'NATION_0' THEN "POLAR ARR ($)" END), 0)
                  AS bigint) AS COUNTRY_ARR
      FROM scope) s""")

SQL["outbound_funnel"] = _ob("""
SELECT 1 AS STAGE_ORDER, 'Contacts Touched' AS STAGE, cast(sum(NB_CONTACTS_TOUCHED) AS bigint) AS COUNT FROM ob
UNION ALL SELECT 2, 'Companies Touched', cast(sum(NB_COMPANIES_TOUCHED) AS bigint) FROM ob
UNION ALL SELECT 3, 'ICP Companies Touched', cast(sum(NB_COMPANIES_TOUCHED_ICP) AS bigint) FROM ob
UNION ALL SELECT 4, 'ICP Companies Clicked', cast(sum(NB_COMPANIES_CLICKED_ICP) AS bigint) FROM ob
UNION ALL SELECT 5, 'ICP Companies Replied', cast(sum(NB_COMPANIES_REPLIED_ICP) AS bigint) FROM ob
UNION ALL SELECT 6, 'ICP Positive Replies', cast(sum(NB_COMPANIES_REPLIED_POSITIVE_ICP) AS bigint) FROM ob""")

SQL["tam_contribution"] = _obmk(f"""
SELECT OUTBOUND_ARR, POTENTIAL_ARR, {pdiv('OUTBOUND_ARR', 'POTENTIAL_ARR')} * 100
         AS CONTRIBUTION_PERCENT,
       'Total New ARR from Outbound Campaigns: $' || format('{{:,}}', OUTBOUND_ARR)
         AS OUTBOUND_ARR_TEXT,
       'Total Addressable Market (TAM): $' || format('{{:,}}', POTENTIAL_ARR) AS TAM_TEXT,
       'Outbound Campaigns contribute '
         || printf('%.2f', {pdiv('OUTBOUND_ARR', 'POTENTIAL_ARR')} * 100)
         || '% to the Total Addressable Market (TAM)' AS CONTRIBUTION_TEXT
FROM (SELECT cast(coalesce(sum(NEW_ARR_FROM_OB_ALL_TIME), 0) AS bigint) AS OUTBOUND_ARR FROM ob) a,
     (SELECT cast(coalesce(sum("POLAR ARR ($)"), 0) AS bigint) AS POTENTIAL_ARR FROM scope) b""")

_RATES = f"""
rates AS (
  SELECT CAMPAIGN_GROUP,
         {pdiv('NB_COMPANIES_CLICKED_ICP', 'NB_COMPANIES_TOUCHED_ICP')} AS ICP_click_through_rate,
         {pdiv('NB_COMPANIES_REPLIED_ICP', 'NB_COMPANIES_TOUCHED_ICP')} AS ICP_reply_rate,
         {pdiv('NB_COMPANIES_REPLIED_POSITIVE_ICP', 'NB_COMPANIES_TOUCHED_ICP')}
           AS ICP_positive_reply_rate
  FROM ob)"""

SQL["icp_rates"] = with_ctes(OUTBOUND, _RATES, body="SELECT * FROM rates")

SQL["icp_avg_rates"] = with_ctes(OUTBOUND, _RATES, body="""
SELECT round(avg(ICP_click_through_rate), 9) AS avg_ICP_click_through_rate,
       round(avg(ICP_reply_rate), 9) AS avg_ICP_reply_rate,
       round(avg(ICP_positive_reply_rate), 9) AS avg_ICP_positive_reply_rate
FROM rates""")

SQL["icp_share"] = _ob(f"""
SELECT ICP_TOUCHED, TOUCHED, {pdiv('ICP_TOUCHED', 'TOUCHED')} AS ICP_SHARE
FROM (SELECT cast(coalesce(sum(NB_COMPANIES_TOUCHED_ICP), 0) AS bigint) AS ICP_TOUCHED,
             cast(coalesce(sum(NB_COMPANIES_TOUCHED), 0) AS bigint) AS TOUCHED FROM ob) s""")

SQL["outbound_limitations"] = with_ctes(OUTBOUND, _RATES, body=r"""
SELECT ICP_CONTACTED, cast(len(msgs) AS bigint) AS NUM_LIMITATIONS,
       CASE WHEN len(msgs) > 0
            THEN chr(10) || 'Outbound is facing the following limitations:' || chr(10)
                 || array_to_string(msgs, chr(10))
            ELSE 'Outbound is performing well with respect to ICP conversion rates.' END
         AS MESSAGE
FROM (SELECT ICP_CONTACTED,
             list_filter([
               CASE WHEN a < 0.2 THEN '    ' || chr(10) || '- Low click-through rate for ICP contacts. ('
                                     || printf('%.2f', a) || '%)' END,
               CASE WHEN b < 0.1 THEN '    ' || chr(10) || '- Low reply rate from ICP contacts. ('
                                     || printf('%.2f', b) || '%)' END,
               CASE WHEN c < 0.05 THEN '    ' || chr(10) || '- Low positive reply rate from ICP contacts. ('
                                      || printf('%.2f', c) || '%)' END,
               CASE WHEN ICP_CONTACTED < 1000
                    THEN 'Limited ICP data – not enough ICP companies are being contacted.' END
             ], lambda x: x IS NOT NULL) AS msgs
      FROM (SELECT avg(ICP_click_through_rate) AS a, avg(ICP_reply_rate) AS b,
                   avg(ICP_positive_reply_rate) AS c,
                   (SELECT cast(coalesce(sum(NB_COMPANIES_TOUCHED_ICP), 0) AS bigint) FROM ob)
                     AS ICP_CONTACTED
            FROM rates) r) m""")

_OB_NUM = ["CAMPAIGN_LENGTH", "NB_EMAILS", "NB_CONTACTS_TOUCHED", "NB_COMPANIES_TOUCHED",
           "TOTAL_NB_CLICKS", "TOTAL_NB_POSITIVE_REPLIES_PER_CAMPAIGN",
           "TOTAL_NB_NEGATIVE_REPLIES_PER_CAMPAIGN", "NB_COMPANIES_CLICKED",
           "NB_CUSTOMERS_FROM_OB_ALL_TIME", "PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME",
           "NEW_ARR_FROM_OB_ALL_TIME", "NB_COMPANIES_TOUCHED_ICP", "NB_COMPANIES_CLICKED_ICP",
           "NB_COMPANIES_REPLIED_ICP", "NB_COMPANIES_REPLIED_POSITIVE_ICP"]
_OB_DOTTED = ["NB_COMPANIES_CLICKED_ICP.1", "NB_COMPANIES_REPLIED_ICP.1",
              "NB_COMPANIES_REPLIED_POSITIVE_ICP.1"]
_OB_ALL = ["CAMPAIGN_GROUP", "CAMPAIGN_START_DATE", "CAMPAIGN_LAST_DATE"] + _OB_NUM
_MK_NUM = ["TOTAL_GMV", "AVG_GMV", "NB_DOMAINS", "POLAR ARR ($)"]
_MK_ALL = ["PLATFORM", "COUNTRY", "GMV_CATEGORY"] + _MK_NUM

SQL["outbound_table"] = _ob("SELECT * FROM obt")
SQL["describe_outbound"] = _ob(_describe("obt", _OB_NUM))
SQL["unique_counts_outbound"] = _ob(_unique("obt", _OB_ALL))

SQL["metric_by_campaign"] = _ob("""
SELECT CAMPAIGN_GROUP, cast(coalesce(sum(NB_CONTACTS_TOUCHED), 0) AS bigint) AS NB_CONTACTS_TOUCHED
FROM obf WHERE CAMPAIGN_GROUP IS NOT NULL GROUP BY 1""")

SQL["campaign_spans"] = _ob("""
SELECT CAMPAIGN_GROUP, NB_CONTACTS_TOUCHED AS VALUE,
       'Start: ' || cast(CAMPAIGN_START_DATE AS varchar) || '<br>End: '
         || cast(CAMPAIGN_LAST_DATE AS varchar) || '<br>NB_CONTACTS_TOUCHED: '
         || cast(NB_CONTACTS_TOUCHED AS varchar) AS LABEL
FROM obf
WHERE CAMPAIGN_START_DATE IS NOT NULL AND CAMPAIGN_LAST_DATE IS NOT NULL
  AND NB_CONTACTS_TOUCHED IS NOT NULL AND CAMPAIGN_GROUP IS NOT NULL""")

SQL["length_scatter"] = _ob("""
SELECT CAMPAIGN_LENGTH AS X, NB_CONTACTS_TOUCHED AS Y, CAMPAIGN_GROUP AS COLOR FROM obf""")

SQL["metric_by_start_month"] = _ob("""
SELECT month(CAMPAIGN_START_DATE) AS START_MONTH,
       cast(coalesce(sum(NB_CONTACTS_TOUCHED), 0) AS bigint) AS NB_CONTACTS_TOUCHED
FROM obf WHERE CAMPAIGN_START_DATE IS NOT NULL GROUP BY 1""")

SQL["describe"] = _mk(_describe("mkf", _MK_NUM))
SQL["unique_counts"] = _mk(_unique("mkf", _MK_ALL))

SQL["market_table"] = _mk("SELECT * FROM mkf")

SQL["gmv_by_category"] = _mk("""
SELECT GMV_CATEGORY, coalesce(sum(TOTAL_GMV), 0) AS TOTAL_GMV
FROM mkf WHERE GMV_CATEGORY IS NOT NULL GROUP BY 1""")


def _at(p: str) -> str:
    """Chart quartile by rank arithmetic: place n p - 0.5 from 0, ends clamped,
    between the values at the places around it."""
    place = f"greatest(0, least(n * {p} - 0.5, n - 1))"
    low = f"max(v) FILTER (r = floor({place}))"
    high = f"max(v) FILTER (r = ceil({place}))"
    return f"{low} + ({high} - {low}) * max({place} - floor({place}))"


def _box(expr: str, d: int | None = None) -> str:
    def r(x: str) -> str:
        return f"round({x}, {d})" if d is not None else x
    return _mk(f"""
, v AS (
  SELECT GMV_CATEGORY, v, row_number() OVER (PARTITION BY GMV_CATEGORY ORDER BY v) - 1 AS r,
         count(*) OVER (PARTITION BY GMV_CATEGORY) AS n
  FROM (SELECT GMV_CATEGORY, {expr} AS v FROM mkf) b WHERE v IS NOT NULL AND NOT isnan(v)),
q AS (SELECT GMV_CATEGORY, {_at('0.25')} AS q1, {_at('0.5')} AS median, {_at('0.75')} AS q3
      FROM v GROUP BY 1),
w AS (
  SELECT v.GMV_CATEGORY, v, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM v JOIN q ON v.GMV_CATEGORY IS NOT DISTINCT FROM q.GMV_CATEGORY)
SELECT GMV_CATEGORY, count(*) AS count, {r('min(v)')} AS min,
       {r('least(any_value(q1), min(v) FILTER (v >= lo))')} AS lower_whisker,
       {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3,
       {r('greatest(any_value(q3), max(v) FILTER (v <= hi))')} AS upper_whisker,
       {r('max(v)')} AS max, count(*) FILTER (v < lo OR v > hi) AS outliers
FROM w GROUP BY 1""")


SQL["box_stats"] = _box("cast(AVG_GMV AS double)")
SQL["box_stats_log"] = _box("CASE WHEN AVG_GMV > 0 THEN ln(1 + AVG_GMV) END", 9)

SQL["domains_scatter"] = _mk("""
SELECT NB_DOMAINS AS X, TOTAL_GMV AS Y, GMV_CATEGORY AS COLOR FROM mkf""")


def _top(rel: str, key: str) -> str:
    return _mk(f"""
SELECT {key}, coalesce(sum(TOTAL_GMV), 0) AS TOTAL_GMV
FROM {rel} WHERE {key} IS NOT NULL GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""")


SQL["top_platforms"] = _top("mkf", "PLATFORM")
SQL["top_countries"] = _top("mkf", "COUNTRY")
SQL["top_countries_shopify"] = _top("(SELECT * FROM mkf WHERE PLATFORM = 'Shopify')", "COUNTRY")
SQL["distinct_countries"] = _mk("SELECT DISTINCT COUNTRY FROM mk WHERE COUNTRY IS NOT NULL")

SQL["tenants_preview"] = with_ctes(TENANTS, body="SELECT * FROM tenants LIMIT 5")
SQL["unique_counts_tenants"] = with_ctes(TENANTS, body=_unique("tenants", ["TENANT_ID", "DATASOURCE_ID"]))
SQL["tenant_stores"] = with_ctes(TENANTS, body="""
SELECT TENANT_ID, count(DISTINCT DATASOURCE_ID) AS DATASOURCE_ID
FROM tenants WHERE TENANT_ID IS NOT NULL GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""")


SQL["attribution_lookback_user_3d"] = with_ctes(PIXEL, ORDERS_TOUCHES, _last_click_user(3),
                                                _report(3), body="SELECT * FROM report")

SQL["lookback_pairs"] = """
SELECT o.event_id AS ORDER_EVENT_ID, t.event_id AS TOUCH_EVENT_ID, o.user_id AS USER_ID
FROM events o JOIN events t
  ON o.user_id = t.user_id AND t.ts <= o.ts AND t.ts >= o.ts - INTERVAL 3 DAY
WHERE o.event_type = 'purchase'"""


SQL["journey_lookback"] = with_ctes(PIXEL, ORDERS_TOUCHES, body="""
SELECT shopifyOrderId AS ORDER_ID, o_eid AS ORDER_EVENT_ID, t_eid AS TOUCH_EVENT_ID,
       attribution_source AS ATTRIBUTION_SOURCE,
       CASE WHEN o_user = t_user THEN 'userId_match'
            WHEN o_ip = t_ip AND o_ts = t_ts THEN 'ip_match' ELSE 'no_match' END AS MATCH_TYPE,
       CASE WHEN t_ts <= o_ts AND t_ts >= o_ts - 3*24*60*60 THEN 1 ELSE 0 END AS IS_WITHIN_LOOKBACK
FROM o JOIN t ON o_user = t_user WHERE t_ts <= o_ts""")


def _marketing_touch(days: int) -> str:
    lca = f"""
mt AS (SELECT t.* FROM t JOIN pixel ON t_eid = event_id WHERE utmSource IS NOT NULL),
lca AS (
  SELECT * FROM (
    SELECT o.*, mt.*, row_number() OVER (PARTITION BY shopifyOrderId
                                         ORDER BY t_ts DESC, t_eid, o_eid) AS rn
    FROM o JOIN mt ON o_user = t_user AND t_ts < o_ts AND t_ts >= o_ts - {days}*24*60*60) x
  WHERE rn = 1)"""
    return with_ctes(PIXEL, ORDERS_TOUCHES, lca, _report(days), body="SELECT * FROM report")


for _days in (3, 10, 25):
    SQL[f"attribution_marketing_touch_{_days}d"] = _marketing_touch(_days)

_STORE_TENANTS = """
store_tenants AS (
  SELECT 's' || cast(c_custkey % 5 AS varchar) AS shopify_url, min(c_nationkey) AS tenant_id
  FROM customer GROUP BY 1)"""

SQL["attribution_brand"] = with_ctes(
    PIXEL, ORDERS_TOUCHES, _last_click(90), _report(90), _STORE_TENANTS, body="""
SELECT report.*, tenant_id AS BRAND FROM report JOIN store_tenants ON STORE = shopify_url""")

SQL["referrer_top10"] = SQL["referrer_contribution"] + """
ORDER BY total_orders DESC, total_revenue DESC, PAGEREFERRER LIMIT 10"""

SQL["orders_by_month_chart"] = SQL["orders_per_month_store"]

SQL["orders_per_month_ordered"] = f"""
SELECT *, row_number() OVER (ORDER BY STORE, MONTH) AS POSITION
FROM ({SQL["orders_per_month_store"]}) m"""

SQL["attribution_report_ordered"] = _model90("""
SELECT *, row_number() OVER (
  ORDER BY STORE, MONTH, ATTRIBUTED_ORDERS DESC, ATTRIBUTION_SOURCE,
           PAGEREFERRER NULLS FIRST, MEDIUM, CAMPAIGN) AS POSITION
FROM report""")

SQL["campaign_spans_dotted"] = _ob("""
SELECT CAMPAIGN_GROUP, "NB_COMPANIES_REPLIED_ICP.1" AS VALUE,
       'Start: ' || cast(CAMPAIGN_START_DATE AS varchar) || '<br>End: '
         || cast(CAMPAIGN_LAST_DATE AS varchar) || '<br>NB_COMPANIES_REPLIED_ICP.1: '
         || cast("NB_COMPANIES_REPLIED_ICP.1" AS varchar) AS LABEL
FROM obf""")

SQL["metric_by_campaign_dotted"] = _ob("""
SELECT CAMPAIGN_GROUP, cast(sum("NB_COMPANIES_CLICKED_ICP.1") AS bigint) AS CLICKED_ICP
FROM obf GROUP BY 1""")

SQL["metric_by_campaign_ordered"] = _ob("""
SELECT CAMPAIGN_GROUP, NB_CONTACTS_TOUCHED,
       row_number() OVER (ORDER BY NB_CONTACTS_TOUCHED DESC, CAMPAIGN_GROUP) AS POSITION
FROM obf""")

SQL["describe_outbound_full"] = _ob(_describe("obf", _OB_NUM + _OB_DOTTED))

SQL["outbound_one_group"] = _ob("SELECT * FROM obt WHERE CAMPAIGN_GROUP = 'Brand#11/SMALL'")

SQL["gmv_two_categories"] = _mk("""
SELECT GMV_CATEGORY, coalesce(sum(TOTAL_GMV), 0) AS TOTAL_GMV
FROM mk WHERE GMV_CATEGORY IN ('a) < $1M', 'c) > $3M') GROUP BY 1""")


def _cleaned(dirty: bool) -> str:
    """What cleaning makes of the text export: typed values, each row once."""
    bad = "n = {}" if dirty else "false"
    return with_ctes(OUTBOUND, "x AS (SELECT *, NB_EMAILS % 5 AS n FROM outbound)", body=f"""
SELECT DISTINCT CAMPAIGN_GROUP,
       CASE WHEN {bad.format(2)} THEN NULL ELSE CAMPAIGN_START_DATE END AS CAMPAIGN_START_DATE,
       CASE WHEN {bad.format(3)} THEN NULL ELSE PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME END
         AS PIPELINE_OPP_AMOUNT_FROM_OB_ALL_TIME,
       TOTAL_NB_CLICKS,
       CASE WHEN n = 4 THEN NULL ELSE NB_EMAILS / 2.0::double END AS NB_EMAILS
FROM x""")


SQL["clean_lenient"] = _cleaned(True)
SQL["clean_from_staged"] = SQL["clean_lenient"]
SQL["clean_strict"] = _cleaned(False)


# Round trips through files give the same rows as the plain queries.
SQL["orders_per_month_from_files"] = SQL["orders_per_month_store"]
SQL["orders_per_month_from_arrays"] = SQL["orders_per_month_store"]
SQL["attribution_model_maintained"] = SQL["attribution_report"]
SQL["source_share_from_marts"] = SQL["source_share"]


def _page(parts: dict[str, tuple[str, str | None]]) -> str:
    """Rows and totals of a page's parts, from the SQL of each."""
    rows = []
    for name, (query, col) in parts.items():
        total = f'cast(sum("{col}") AS bigint)' if col else "cast(NULL AS bigint)"
        rows.append(f"SELECT '{name}' AS MEMBER, count(*) AS ROW_COUNT, {total} AS TOTAL FROM ({SQL[query]})")
    return "\nUNION ALL\n".join(rows)


def _add_pages() -> None:
    from touchline.plans.registry import PAGE_PARTS
    for page, parts in PAGE_PARTS.items():
        SQL[page] = _page(parts)


_add_pages()
