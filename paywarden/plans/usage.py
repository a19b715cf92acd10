"""Usage, prices and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import usage as U
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import dbl
from paywarden.sources.tables import USAGE_AS_OF

DISCOUNTS = "APPS=0.1;view = 0.2 ;bad;CLICK=x;model_serving=0.3;VIEW=0.05"


def prices(c: Context) -> DataFrame:
    return U.usd_prices(c.t.list_prices())


def workspaces(c: Context) -> DataFrame:
    return c.spark.createDataFrame([("w0", "Casework"), ("w1", "Analytics")], "workspace_id string, workspace_name string")


COST = "CAST(sum(CAST(coalesce(cost, 0) AS DECIMAL(28,6))) AS DECIMAL(28,6))"


@query("price_join_half_open", """
    SELECT usage_id, billing_origin_product, CAST(unit_price AS DOUBLE) AS unit_price_usd, CAST(cost AS DOUBLE) AS cost_usd,
           unit_price IS NULL AS is_unpriced FROM priced_half_open""")
def price_join_half_open(c: Context) -> DataFrame:
    priced = U.price_half_open(c.t.usage(), prices(c))
    return priced.select("usage_id", "billing_origin_product", "unit_price_usd", U.cost().alias("cost_usd"),
                         F.col("unit_price_usd").isNull().alias("is_unpriced"))


@query("price_join_closed", """
    SELECT usage_id, billing_origin_product, CAST(unit_price AS DOUBLE) AS unit_price_usd, CAST(cost AS DOUBLE) AS cost_usd
    FROM priced_closed""")
def price_join_closed(c: Context) -> DataFrame:
    return U.price_closed(c.t.usage(), prices(c), USAGE_AS_OF).select(
        "usage_id", "billing_origin_product", "unit_price_usd", U.cost().alias("cost_usd"))


@query("price_join_by_nodes", """
    SELECT 'half open' AS rule, usage_id, CAST(unit_price AS DOUBLE) AS unit_price_usd FROM priced_half_open
    UNION ALL SELECT 'closed', usage_id, CAST(unit_price AS DOUBLE) FROM priced_closed""")
def price_join_by_nodes(c: Context) -> DataFrame:
    """Both price joins by dyadic nodes, the way taken for long price lists."""
    half = U.price_half_open(c.t.usage(), prices(c), long_list=0).select(F.lit("half open").alias("rule"), "usage_id", "unit_price_usd")
    return half.unionByName(U.price_closed(c.t.usage(), prices(c), USAGE_AS_OF, long_list=0).select(F.lit("closed").alias("rule"), "usage_id", "unit_price_usd"))


@query("broadcast_hint", f"""
    WITH per AS (SELECT sku_name, count(*) AS n, CAST({COST} AS DOUBLE) AS cost_usd FROM priced_closed GROUP BY 1)
    SELECT 'broadcast' AS side, * FROM per UNION ALL SELECT 'salted', * FROM per""")
def broadcast_hint(c: Context) -> DataFrame:
    """The price join with the price side broadcast, and the way taken when it is too large for that."""
    out = None
    for side, limit in (("broadcast", 1000), ("salted", 0)):
        priced = U.price_closed(c.t.usage(), prices(c), USAGE_AS_OF, max_rows=limit, salts=8, floor=100)
        one = priced.groupBy("sku_name").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(U.cost(), F.lit(0).cast("decimal(18,2)"))).alias("cost_usd"))
        one = one.select(F.lit(side).alias("side"), "*")
        out = one if out is None else out.unionByName(one)
    return out


DISCOUNT_ROWS = """d(product, discount) AS (VALUES ('APPS', 0.1), ('VIEW', 0.2), ('CLICK', NULL), ('MODEL_SERVING', 0.3),
    ('VIEW', 0.05))"""


@query("discount_or_join", f"""
    WITH {DISCOUNT_ROWS}
    SELECT u.usage_id, u.sku_name, u.billing_origin_product, d.product AS discount_product,
           CAST(d.discount AS DOUBLE) AS discount
    FROM usage_facts u LEFT JOIN d ON d.product = u.sku_name OR d.product = u.billing_origin_product""")
def discount_or_join(c: Context) -> DataFrame:
    table = U.discount_table(c.spark, DISCOUNTS)
    return U.with_discounts(c.t.usage(), table).select(
        "usage_id", "sku_name", "billing_origin_product", "discount_product", "discount")


@query("scope_zero_fill", f"""
    SELECT s.product, CAST(coalesce(r.cost, 0) AS DOUBLE) AS list_price_cost_usd, coalesce(r.n, 0) AS usage_records,
           coalesce(r.unpriced, 0) AS unpriced_records
    FROM (VALUES ('MODEL_SERVING'), ('AI_GATEWAY'), ('APPS'), ('GENIE'), ('ABSENT')) s(product)
    LEFT JOIN (SELECT billing_origin_product AS product, round({COST}, 2) AS cost, count(*) AS n,
               count(*) FILTER (WHERE unit_price IS NULL) AS unpriced FROM priced_half_open GROUP BY 1) r
      ON s.product = r.product""")
def scope_zero_fill(c: Context) -> DataFrame:
    rollup = U.product_rollup(U.price_half_open(c.t.usage(), prices(c)))
    return U.zero_filled(rollup, [*U.SCOPE, "ABSENT"])


LABELLED = """labelled AS (SELECT u.*, CASE WHEN w.name IS NULL THEN 'id: ' || u.workspace_id
        ELSE w.name || ' (id: ' || u.workspace_id || ')' END AS workspace
    FROM usage_facts u LEFT JOIN (VALUES ('w0', 'Casework'), ('w1', 'Analytics')) w(id, name) ON u.workspace_id = w.id)"""


@query("workspace_label_join", f"""
    WITH {LABELLED} SELECT usage_id, workspace FROM labelled""")
def workspace_label_join(c: Context) -> DataFrame:
    return U.with_workspace_label(c.t.usage(), workspaces(c)).select("usage_id", "workspace")


@query("serving_usage_join", """
    SELECT u.request_id, u.requester, se.endpoint_name, se.task FROM serving_usage u
    JOIN served_entities se ON u.served_entity_id = se.served_entity_id""")
def serving_usage_join(c: Context) -> DataFrame:
    return U.with_entities(c.t.serving_usage(), c.t.served_entities()).select(
        "request_id", "requester", "endpoint_name", "task")


@query("product_spend_rollup", f"""
    SELECT billing_origin_product AS product, count(*) AS usage_records,
           count(*) FILTER (WHERE unit_price IS NULL) AS unpriced_records,
           CAST(round({COST}, 2) AS DOUBLE) AS list_price_cost_usd FROM priced_half_open GROUP BY 1""")
def product_spend_rollup(c: Context) -> DataFrame:
    return U.product_rollup(U.price_half_open(c.t.usage(), prices(c)))


@query("cost_by_product", f"""
    SELECT billing_origin_product, CAST(round(sum(usage_quantity), 3) AS DOUBLE) AS dbus,
           CAST(round({COST}, 2) AS DOUBLE) AS usd FROM priced_closed GROUP BY 1""")
def cost_by_product(c: Context) -> DataFrame:
    return U.cost_by_product(c.t.usage(), prices(c), USAGE_AS_OF).orderBy(F.desc("usd"))


ENDPOINTS = """SELECT se.endpoint_name, se.entity_type, se.task, count(*) AS requests,
    CAST(sum(u.input_token_count) AS BIGINT) AS input_tokens, CAST(sum(u.output_token_count) AS BIGINT) AS output_tokens,
    count(DISTINCT u.requester) AS requesters, strftime(min(u.request_time), '%Y-%m-%d %H:%M:%S.%f') AS first_request,
    strftime(max(u.request_time), '%Y-%m-%d %H:%M:%S.%f') AS last_request
    FROM serving_usage u JOIN served_entities se ON u.served_entity_id = se.served_entity_id GROUP BY 1, 2, 3"""


@query("serving_usage_by_endpoint", ENDPOINTS)
def serving_usage_by_endpoint(c: Context) -> DataFrame:
    return U.usage_by_endpoint(c.t.serving_usage(), c.t.served_entities()).orderBy(F.desc("requests"))


@query("budget_attribution", """
    SELECT billing_origin_product, coalesce(budget_policy_id, '') AS budget_policy_id, count(*) AS records,
           CAST(round(sum(usage_quantity), 4) AS DOUBLE) AS dbus, CAST(max(usage_date) AS VARCHAR) AS last_day
    FROM usage_facts GROUP BY 1, 2""")
def budget_attribution(c: Context) -> DataFrame:
    return c.t.usage().groupBy(
        "billing_origin_product", F.coalesce("budget_policy_id", F.lit("")).alias("budget_policy_id")).agg(
        F.count(F.lit(1)).alias("records"), F.round(F.sum("usage_quantity"), 4).alias("dbus"),
        F.max("usage_date").alias("last_day"))


@query("budget_daily_usage", """
    SELECT budget_policy_id, billing_origin_product, sku_name, CAST(usage_date AS VARCHAR) AS usage_date,
           CAST(sum(usage_quantity) AS DOUBLE) AS total_dbus, count(*) AS record_count,
           '{"team":"' || min(team) || '"}' AS sample_tags
    FROM usage_facts WHERE budget_policy_id IS NOT NULL GROUP BY ALL""")
def budget_daily_usage(c: Context) -> DataFrame:
    return c.t.usage().filter(F.col("budget_policy_id").isNotNull()).groupBy(
        "budget_policy_id", "billing_origin_product", "sku_name", "usage_date").agg(
        F.sum("usage_quantity").alias("total_dbus"), F.count(F.lit(1)).alias("record_count"),
        F.min(F.to_json("custom_tags")).alias("sample_tags"))


@query("payload_log_span", """
    SELECT count(*) AS rows_logged, strftime(min(request_time), '%Y-%m-%d %H:%M:%S.%f') AS first_row,
           strftime(max(request_time), '%Y-%m-%d %H:%M:%S.%f') AS last_row FROM serving_usage""")
def payload_log_span(c: Context) -> DataFrame:
    return c.t.serving_usage().agg(F.count(F.lit(1)).alias("rows_logged"), F.min("request_time").alias("first_row"),
                                   F.max("request_time").alias("last_row"))


@query("payload_recent", """
    SELECT request_id, requester, strftime(request_time, '%Y-%m-%d %H:%M:%S.%f') AS request_time,
           left(request, 120) AS request_snippet FROM serving_usage s ORDER BY s.request_time DESC, request_id LIMIT 10""")
def payload_recent(c: Context) -> DataFrame:
    return c.t.serving_usage().orderBy(F.desc("request_time"), "request_id").limit(10).select(
        "request_id", "requester", "request_time", F.left("request", F.lit(120)).alias("request_snippet"))


@query("endpoint_absence", """
    SELECT se.endpoint_name, u.workspace_id, count(*) AS requests
    FROM serving_usage u JOIN served_entities se ON u.served_entity_id = se.served_entity_id
    WHERE u.requester = 'user9' AND lower(se.endpoint_name) LIKE '%coding%' GROUP BY 1, 2""")
def endpoint_absence(c: Context) -> DataFrame:
    """One requester on endpoints of a kind; a requester bound to another entity comes back empty."""
    joined = U.with_entities(c.t.serving_usage(), c.t.served_entities())
    return joined.filter((F.col("requester") == "user9") & F.lower("endpoint_name").like("%coding%")).groupBy(
        "endpoint_name", "workspace_id").agg(F.count(F.lit(1)).alias("requests"))


@query("coverage_count", """
    SELECT count(*) AS total_rows, count(embedding) AS embedded_rows FROM partly_embedded""")
def coverage_count(c: Context) -> DataFrame:
    return c.t.partly_embedded().agg(F.count(F.lit(1)).alias("total_rows"), F.count("embedding").alias("embedded_rows"))


SPEND = f"""spend AS (SELECT s.product, coalesce(r.cost, 0) AS cost, coalesce(r.n, 0) AS usage_records,
           coalesce(r.unpriced, 0) AS unpriced_records
    FROM (VALUES ('MODEL_SERVING'), ('AI_GATEWAY'), ('APPS'), ('GENIE')) s(product)
    LEFT JOIN (SELECT billing_origin_product AS product, round({COST}, 2) AS cost, count(*) AS n,
               count(*) FILTER (WHERE unit_price IS NULL) AS unpriced FROM priced_half_open
               WHERE workspace_id = 'w1' AND usage_date BETWEEN DATE '2024-01-30' - 29 AND DATE '2024-01-30' GROUP BY 1) r
      ON s.product = r.product)"""


@query("governance_spend", f"""
    WITH {SPEND} SELECT product, '2024-01-01' AS reporting_start, '2024-01-30' AS reporting_end,
           CAST(cost AS DOUBLE) AS list_price_cost_usd, CAST(sum(cost) OVER () AS DOUBLE) AS total_list_price_cost_usd,
           usage_records, unpriced_records FROM spend""")
def governance_spend(c: Context) -> DataFrame:
    return U.governance_spend(c.t.usage(), prices(c), USAGE_AS_OF, "w1")


@query("grand_total_over", f"""
    SELECT billing_origin_product AS product, count(*) AS usage_records,
           count(*) FILTER (WHERE unit_price IS NULL) AS unpriced_records,
           CAST(round({COST}, 2) AS DOUBLE) AS list_price_cost_usd,
           CAST(sum(round({COST}, 2)) OVER () AS DOUBLE) AS total_list_price_cost_usd FROM priced_half_open GROUP BY 1""")
def grand_total_over(c: Context) -> DataFrame:
    return U.with_total(U.product_rollup(U.price_half_open(c.t.usage(), prices(c))))


@query("spend_totals", f"""
    WITH {SPEND} SELECT CAST(sum(cost) AS DOUBLE) AS total_usd, CAST(max(cost) AS DOUBLE) AS max_product_usd,
           CAST(sum(unpriced_records) AS BIGINT) AS unpriced_records FROM spend""")
def spend_totals(c: Context) -> DataFrame:
    return U.spend_totals(U.governance_spend(c.t.usage(), prices(c), USAGE_AS_OF, "w1"))


@query("global_min_max_over", """
    SELECT usage_id, CAST(min(usage_date) OVER () AS VARCHAR) || ' to ' || CAST(max(usage_date) OVER () AS VARCHAR)
           AS time_window_string FROM usage_facts""")
def global_min_max_over(c: Context) -> DataFrame:
    usage = c.t.usage()
    span = usage.agg(F.struct(F.min("usage_date").alias("a"), F.max("usage_date").alias("b"))).scalar()
    return usage.withColumn("w", span).select("usage_id", F.concat(
        F.col("w.a").cast("string"), F.lit(" to "), F.col("w.b").cast("string")).alias("time_window_string"))


CONTRACT = """contract AS (SELECT event_id, event_type || '=0.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')
    || '; bad ;C=x; *=0.05' AS txt FROM events),
    kv AS (SELECT event_id, unnest(string_split(regexp_replace(upper(txt), '\\s+', '', 'g'), ';')) AS combination FROM contract),
    parsed AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY combination) AS order_id,
        split_part(combination, '=', 1) AS product, TRY_CAST(split_part(combination, '=', 2) AS DECIMAL(10,3)) AS discount,
        combination FROM kv)"""


def contracts(c: Context) -> DataFrame:
    """One discount text per event, with a malformed pair, a non-numeric value and a global entry."""
    e = F.col("event_id")
    text = F.concat(F.col("event_type"), F.lit("=0."), F.lpad((e % 1000).cast("string"), 3, "0"),
                    F.lit("; bad ;C=x; *=0.05"))
    return c.t.read("events").select("event_id", F.inline(U.parsed_pairs(text)))


@query("row_number_kv", f"""
    WITH {CONTRACT} SELECT event_id, order_id, combination FROM parsed WHERE contains(combination, '=')""")
def row_number_kv(c: Context) -> DataFrame:
    return contracts(c).select("event_id", "order_id", "combination")


@query("parse_discounts", f"""
    WITH {CONTRACT} SELECT event_id, product, CAST(discount AS DOUBLE) AS discount FROM parsed
    WHERE contains(combination, '=')""")
def parse_discounts(c: Context) -> DataFrame:
    return contracts(c).select("event_id", "product", "discount")


PRICED = f"""{DISCOUNT_ROWS}, {LABELLED},
    priced AS (SELECT u.*, CAST(u.usage_quantity * p.unit_price * (1 - coalesce(d.discount, 0)) AS DECIMAL(28,10)) AS usage_usd
      FROM labelled u LEFT JOIN d ON d.product = u.sku_name OR d.product = u.billing_origin_product
      LEFT JOIN price_list p ON u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit
       AND u.usage_end_time BETWEEN p.price_start_time AND coalesce(p.price_end_time, TIMESTAMP '2024-01-31'))"""


@query("priced_usage", f"""
    WITH {PRICED} SELECT usage_id, {dbl('usage_quantity', 'usage_usd')} FROM priced""")
def priced_usage(c: Context) -> DataFrame:
    return U.priced_usage(c.t.usage(), prices(c), DISCOUNTS, USAGE_AS_OF).select("usage_id", "usage_quantity", "usage_usd")


@query("usage_overview", f"""
    WITH {PRICED}, chosen AS (SELECT * FROM priced WHERE is_serverless
        AND billing_origin_product IN ('APPS', 'MODEL_SERVING', 'OTHER'))
    SELECT usage_id, CAST(CAST(date_trunc('week', usage_date) AS DATE) AS VARCHAR) AS time_key, sku_name AS group_key,
           CAST(usage_usd AS DOUBLE) AS usage_usd_dynamic, CAST(usage_usd AS DOUBLE) AS usage_usd, usage_unit,
           CAST(usage_quantity AS DOUBLE) AS usage_dbus, 'Serverless' AS is_serverless, workspace AS workspace_norm,
           'Actuals' AS usage_type, 'per Week' AS time_period, CAST(min(usage_date) OVER () AS VARCHAR) AS start_time_window,
           CAST(max(usage_date) OVER () AS VARCHAR) AS end_time_window,
           CAST(min(usage_date) OVER () AS VARCHAR) || ' to ' || CAST(max(usage_date) OVER () AS VARCHAR) AS time_window_string
    FROM chosen""")
def usage_overview(c: Context) -> DataFrame:
    return U.usage_overview(c.t.usage(), workspaces(c), prices(c), DISCOUNTS, USAGE_AS_OF, "Week", "SKU", "Dollars",
                            ["APPS", "MODEL_SERVING", "OTHER"], ["Serverless"])


def list_cost(c: Context) -> DataFrame:
    return U.price_half_open(c.t.usage(), prices(c)).withColumn(
        "usage_usd", F.coalesce(U.cost().cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)")))


WEEKLY = f"""weekly AS (SELECT billing_origin_product AS group_key, CAST(date_trunc('week', usage_date) AS DATE) AS period,
    {COST} AS spend FROM priced_half_open GROUP BY 1, 2),
    lagged AS (SELECT *, lag(spend) OVER (PARTITION BY group_key ORDER BY period) AS prev FROM weekly)"""


@query("period_over_period", f"""
    WITH {WEEKLY} SELECT group_key, CAST(period AS VARCHAR) AS period, CAST(spend AS DOUBLE) AS spend_usd,
        CAST(prev AS DOUBLE) AS previous_usd, CAST(spend - prev AS DOUBLE) AS delta_usd,
        CASE WHEN prev <> 0 THEN CAST(spend - prev AS DOUBLE) / CAST(prev AS DOUBLE) END AS delta_share FROM lagged""")
def period_over_period(c: Context) -> DataFrame:
    return U.period_over_period(list_cost(c).withColumn("group_key", F.col("billing_origin_product")))


@query("top_n_with_remaining", f"""
    WITH k AS (SELECT user_id AS u, {COST} AS spend FROM (SELECT e.user_id, p.cost FROM priced_half_open p
                JOIN events e ON e.event_id = p.usage_id) GROUP BY 1),
    r AS (SELECT 'user' || CAST(u AS VARCHAR) AS group_key, spend,
          row_number() OVER (ORDER BY spend DESC, 'user' || CAST(u AS VARCHAR)) AS rn FROM k)
    SELECT CASE WHEN rn <= 10 THEN group_key ELSE 'remaining' END AS group_key, CAST(sum(spend) AS DOUBLE) AS spend_usd,
           count(*) AS n_keys FROM r GROUP BY 1""")
def top_n_with_remaining(c: Context) -> DataFrame:
    who = c.t.serving_usage().select(F.col("request_id").alias("usage_id"), F.col("requester").alias("group_key"))
    per_key = list_cost(c).join(who, "usage_id").groupBy("group_key").agg(F.sum("usage_usd").alias("spend_usd"))
    return U.top_n_with_remaining(per_key, 10)


@query("tag_match_summary", """
    SELECT 'team' AS tag_key, team AS tag_value, count(*) AS records,
           count(*) FILTER (WHERE team IN ('team1')) AS matched, count(*) FILTER (WHERE team NOT IN ('team1')) AS mismatched,
           CAST(sum(usage_quantity) AS DOUBLE) AS units FROM usage_facts GROUP BY team""")
def tag_match_summary(c: Context) -> DataFrame:
    return U.tag_match(c.t.usage(), "Team", "EAM1")


@query("contract_burndown", f"""
    WITH day AS (SELECT workspace_id, usage_date, {COST} AS spend FROM priced_half_open GROUP BY 1, 2)
    SELECT workspace_id, CAST(usage_date AS VARCHAR) AS usage_date, CAST(spend AS DOUBLE) AS spend_usd,
           CAST(sum(spend) OVER w AS DOUBLE) AS spent_usd, CAST(10000.00 - sum(spend) OVER w AS DOUBLE) AS remaining_usd
    FROM day WINDOW w AS (PARTITION BY workspace_id ORDER BY usage_date)""")
def contract_burndown(c: Context) -> DataFrame:
    daily = list_cost(c).groupBy("workspace_id", "usage_date").agg(F.sum("usage_usd").alias("spend_usd"))
    return U.burndown(daily, "10000.00")
