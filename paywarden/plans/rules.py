"""Rule columns, predicates and small projections, each over a whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.functions import text as X
from paywarden.operators import desk as K
from paywarden.operators import usage as U
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import arr, dbl, tim, txt

E, V = K.EXPOSURE, K.RECOVERY


@query("signal_strength", """
    SELECT payment_id, signal, CASE WHEN signal IN ('duplicate_identity','deceased_payee','cross_agency_fraud_flag')
           THEN 'strong' WHEN signal IN ('income_mismatch','benefit_overlap','employment_mismatch') THEN 'moderate'
           ELSE 'weak' END AS strength FROM payment_flags""")
def signal_strength(c: Context) -> DataFrame:
    return c.t.payment_flags().select("payment_id", "signal", R.signal_strength(F.col("signal")).alias("strength"))


@query("risk_level", "SELECT payment_id, n_signals, has_strong_signal, CASE WHEN n_signals >= 2 AND has_strong_signal = 1 "
                     "THEN 'high' WHEN n_signals >= 1 THEN 'moderate' ELSE 'low' END AS risk_level FROM summary")
def risk_level(c: Context) -> DataFrame:
    return c.s.summary.select("payment_id", "n_signals", "has_strong_signal",
                              R.risk_level(F.col("n_signals"), F.col("has_strong_signal")).alias("risk_level"))


@query("improper_exposure", f"SELECT payment_id, risk_level, {dbl('payment_amount_usd', E)} FROM open_queue")
def improper_exposure(c: Context) -> DataFrame:
    return c.s.queue.select("payment_id", "risk_level", "payment_amount_usd", E)


@query("has_strong", f"SELECT payment_id, {arr('signal_strengths')}, has_strong FROM open_queue")
def has_strong(c: Context) -> DataFrame:
    return c.s.queue.select("payment_id", "signal_strengths", "has_strong")


@query("projected_recovery", f"SELECT payment_id, {dbl(E, V)} FROM open_queue")
def projected_recovery(c: Context) -> DataFrame:
    return c.s.queue.select("payment_id", E, V)


@query("citizen_delay_cost", f"SELECT payment_id, {dbl('citizen_delay_cost_usd')} FROM recs")
def citizen_delay_cost(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", "citizen_delay_cost_usd")


@query("recommended_disposition", "SELECT payment_id, n_signals, recommended_disposition FROM recs")
def recommended_disposition(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", "n_signals", "recommended_disposition")


@query("confidence_score", "SELECT payment_id, risk_level, confidence_score FROM recs")
def confidence_score(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", "risk_level", "confidence_score")


@query("signal_strength_mix", "SELECT case_id, n_signals, signal_strength_mix FROM silver_outcomes")
def signal_strength_mix(c: Context) -> DataFrame:
    return c.t.outcomes().select("case_id", "n_signals", R.signal_strength_mix(F.col("n_signals"))
                                 .alias("signal_strength_mix"))


@query("recovery_outcome", f"SELECT case_id, was_improper, {dbl('recovery_outcome')} FROM case_outcomes")
def recovery_outcome(c: Context) -> DataFrame:
    return c.t.outcomes().select("case_id", "was_improper", R.recovery_outcome(
        F.col("was_improper"), F.col("recovery_amount_usd")).alias("recovery_outcome"))


@query("snapshot_filter", f"""
    SELECT payment_id, {txt('queue_date')} FROM silver WHERE queue_date <= DATE '2000-01-01'""")
def snapshot_filter(c: Context) -> DataFrame:
    from paywarden.operators.scoring import open_queue
    return open_queue(c.s.flagged, dt.date(2000, 1, 1)).select("payment_id", "queue_date")


@query("reasoning_text", "SELECT payment_id, reasoning FROM recs")
def reasoning_text(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", "reasoning")


@query("memo_scaffold", "SELECT payment_id, memo_scaffold FROM recs")
def memo_scaffold(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", "memo_scaffold")


@query("queue_filter", f"""
    SELECT payment_id, program, risk_level, {dbl(E)} FROM live_queue
    WHERE live_disposition IS NULL AND risk_level = 'high' AND program = 'TANF'""")
def queue_filter(c: Context) -> DataFrame:
    return K.queue_filter(c.desk.live, "open", "high", "TANF").select("payment_id", "program", "risk_level", E)


@query("queue_text_search", """
    SELECT payment_id, program, signals FROM positions
    WHERE contains(lower(CAST(payment_id AS VARCHAR)), 'deceased') OR contains(lower(coalesce(program, '')), 'deceased')
       OR contains(lower(coalesce(signals, '')), 'deceased')""")
def queue_text_search(c: Context) -> DataFrame:
    return K.text_search(c.desk.positions, "  DeceAsed ").select("payment_id", "program", "signals")


@query("in_review", "SELECT payment_id, live_disposition, action_status FROM live_queue WHERE live_disposition IS NOT NULL")
def in_review(c: Context) -> DataFrame:
    return c.desk.live.filter(F.col("live_disposition").isNotNull()).select(
        "payment_id", "live_disposition", "action_status")


@query("hold_hours", """
    SELECT payment_id, recommended_disposition, CAST(recommended_hold_hours AS BIGINT) AS recommended_hold_hours
    FROM rec_mirror""")
def hold_hours(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", "recommended_disposition",
                           R.hold_hours(F.col("recommended_disposition")).alias("recommended_hold_hours"))


@query("enum_sanitise", """
    WITH raw AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'release' WHEN 'signup' THEN 'hold_for_verification'
                 WHEN 'error' THEN 'refer_to_investigation' ELSE event_type END AS action,
                 CASE event_id % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' WHEN 2 THEN 'executed'
                      WHEN 3 THEN 'overridden' ELSE 'unknown' END AS status,
                 CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' END AS risk FROM events)
    SELECT event_id, CASE WHEN action IN ('release','hold_for_verification','refer_to_investigation') THEN action END
             AS queue_disposition,
           CASE WHEN status IN ('proposed','approved','executed','overridden') THEN status END AS queue_status,
           CASE WHEN action IN ('release','hold_for_verification','refer_to_investigation') THEN action
                ELSE 'hold_for_verification' END AS log_disposition,
           CASE WHEN status IN ('proposed','approved','executed','overridden') THEN status ELSE 'approved' END AS log_status,
           CASE WHEN risk = 'high' THEN 'high' ELSE 'moderate' END AS queue_risk,
           CASE WHEN risk IN ('high','moderate') THEN risk END AS flag_risk
    FROM raw""")
def enum_sanitise(c: Context) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    action = F.when(kind == "purchase", R.RELEASE).when(kind == "signup", R.HOLD).when(kind == "error", R.REFER) \
        .otherwise(kind)
    status = F.get(F.array(*[F.lit(s) for s in [*R.STATUSES, "unknown"]]), (e % 5).cast("int"))
    risk = F.get(F.array(*[F.lit(r) for r in R.RISKS], F.lit(None)), (e % 4).cast("int"))
    return c.t.read("events").select(
        "event_id",
        R.in_domain(action, R.DISPOSITIONS).alias("queue_disposition"),
        R.in_domain(status, R.STATUSES).alias("queue_status"),
        R.in_domain(action, R.DISPOSITIONS, R.HOLD).alias("log_disposition"),
        R.in_domain(status, R.STATUSES, "approved").alias("log_status"),
        R.queue_risk(risk).alias("queue_risk"), R.flag_risk(risk).alias("flag_risk"))


@query("primary_signal", """
    SELECT payment_id, CASE WHEN payment_id % 10 = 0 OR trim(split_part(signals, ',', 1)) = '' THEN 'unspecified'
           ELSE trim(split_part(signals, ',', 1)) END AS signal_type FROM positions""")
def primary_signal(c: Context) -> DataFrame:
    text = F.when(F.col("payment_id") % 10 != 0, F.col("signals")).when(F.col("payment_id") % 20 == 0, " , x")
    return c.desk.positions.select("payment_id", K.primary_signal(text).alias("signal_type"))


@query("numeric_coerce", """
    WITH cells AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
        WHEN 1 THEN '-' || CAST(event_id AS VARCHAR) WHEN 2 THEN event_type WHEN 3 THEN CAST(CAST(ts AS DATE) AS VARCHAR)
        ELSE CAST(user_id AS VARCHAR) || 'e3' END AS cell FROM events)
    SELECT event_id, CASE WHEN regexp_matches(cell, '^-?\\d+(\\.\\d+)?$') THEN CAST(cell AS DOUBLE) END AS number,
           CASE WHEN regexp_matches(cell, '^-?\\d+(\\.\\d+)?$') THEN NULL ELSE cell END AS label FROM cells""")
def numeric_coerce(c: Context) -> DataFrame:
    e = F.col("event_id")
    cell = (
        F.when(e % 5 == 0, F.col("value").cast("decimal(18,2)").cast("string"))
        .when(e % 5 == 1, F.concat(F.lit("-"), e.cast("string"))).when(e % 5 == 2, F.col("event_type"))
        .when(e % 5 == 3, F.col("ts").cast("date").cast("string"))
        .otherwise(F.concat(F.col("user_id").cast("string"), F.lit("e3"))))
    cells = c.t.read("events").select("event_id", cell.alias("cell"))
    number = X.numeric_cell(F.col("cell"))
    return cells.select("event_id", number.alias("number"),
                        F.when(number.isNull(), F.col("cell")).alias("label"))


@query("null_default_round", f"""
    SELECT p.payment_id, CAST(round(coalesce(q.{E}, 0), 2) AS DOUBLE) AS {E},
           CAST(round(coalesce(q.{V}, 0), 2) AS DOUBLE) AS projected_recovery_usd
    FROM payments p LEFT JOIN open_queue q ON p.payment_id = q.payment_id""")
def null_default_round(c: Context) -> DataFrame:
    def filled(name):
        return F.round(F.coalesce(F.col(name), F.lit(0).cast(R.MONEY)), 2).cast("double")
    queue = c.s.queue.select("payment_id", E, V)
    return c.t.payments().select("payment_id").join(queue, "payment_id", "left").select(
        "payment_id", filled(E).alias(E), filled(V).alias("projected_recovery_usd"))


@query("age_bucket", """
    WITH a AS (SELECT event_id, datediff('second', ts, TIMESTAMP '2024-01-30 12:00:00') AS naive,
               floor(date_part('epoch', TIMESTAMP '2024-01-30 12:00:00' - ts) / 60) AS mins FROM events)
    SELECT event_id, CASE WHEN floor(floor(mins / 60) / 24) >= 1 THEN CAST(CAST(floor(floor(mins / 60) / 24) AS BIGINT) AS VARCHAR)
               || 'd ago' WHEN floor(mins / 60) >= 1 THEN CAST(CAST(floor(mins / 60) AS BIGINT) AS VARCHAR) || 'h ago'
           WHEN mins >= 1 THEN CAST(CAST(mins AS BIGINT) AS VARCHAR) || 'm ago' ELSE 'just now' END AS age FROM a""")
def age_bucket(c: Context) -> DataFrame:
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return c.t.read("events").select("event_id", X.age_label(F.col("ts"), now).alias("age"))


@query("point_lookup", f"""
    SELECT payment_id, program, state, risk_level, recommended_disposition, live_disposition, action_status,
           {dbl(E)} FROM live_queue WHERE payment_id = 100""")
def point_lookup(c: Context) -> DataFrame:
    return c.desk.live.filter(F.col("payment_id") == 100).limit(1).select(
        "payment_id", "program", "state", "risk_level", "recommended_disposition", "live_disposition", "action_status", E)


@query("list_json_parse", """
    WITH cells AS (SELECT event_id, CASE event_id % 4
        WHEN 0 THEN '["' || event_type || '", 7, null, "user' || CAST(user_id AS VARCHAR) || '"]'
        WHEN 1 THEN 'not json ' || event_type WHEN 2 THEN props END AS cell, event_type, user_id FROM events)
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ',user' || CAST(user_id AS VARCHAR) ELSE '' END AS items,
           CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS n_items FROM cells""")
def list_json_parse(c: Context) -> DataFrame:
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    cell = (
        F.when(e % 4 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", 7, null, "user'), user, F.lit('"]')))
        .when(e % 4 == 1, F.concat(F.lit("not json "), F.col("event_type"))).when(e % 4 == 2, F.col("props")))
    return c.t.read("events").select("event_id", X.string_list(cell).alias("items")).withColumn("n_items", F.size("items"))


@query("clamp_limit", """
    SELECT id AS action_id, payment_id, strftime(coalesce(decided_at, created_at), '%Y-%m-%d %H:%M:%S.%f') AS at
    FROM case_actions ORDER BY coalesce(decided_at, created_at) DESC, id DESC LIMIT 100""")
def clamp_limit(c: Context) -> DataFrame:
    """A request for 5,000 rows comes back with the cap of 100."""
    return K.recent_activity(c.desk.actions, "5000").select("action_id", "payment_id", "at")


@query("text_snippet", "SELECT payment_id, left(reasoning, 300) AS reasoning FROM recs")
def text_snippet(c: Context) -> DataFrame:
    return c.s.recs.select("payment_id", F.left("reasoning", F.lit(300)).alias("reasoning"))


@query("usage_flags", """
    SELECT usage_id, CASE WHEN is_serverless THEN 'Serverless' ELSE 'Classic' END AS serverless,
           CASE WHEN is_photon THEN 'Photon' ELSE 'Spark' END AS engine FROM usage_facts""")
def usage_flags(c: Context) -> DataFrame:
    return U.with_flags(c.t.usage()).select("usage_id", "serverless", "engine")


@query("multi_select_filter", """
    SELECT usage_id, billing_origin_product FROM usage_facts
    WHERE billing_origin_product IN ('APPS', 'GENIE') AND is_serverless""")
def multi_select_filter(c: Context) -> DataFrame:
    u = U.with_flags(c.t.usage())
    u = U.multi_select(u, F.col("billing_origin_product"), ["APPS", "GENIE"])
    u = U.multi_select(u, F.col("serverless"), ["Serverless"])
    return U.multi_select(u, F.col("engine"), ["all"]).select("usage_id", "billing_origin_product")


@query("dynamic_group_key", """
    SELECT 'Product' AS grouping, billing_origin_product AS group_key, CAST(sum(usage_quantity) AS DOUBLE) AS units
    FROM usage_facts GROUP BY 2 UNION ALL SELECT 'SKU', sku_name, CAST(sum(usage_quantity) AS DOUBLE) FROM usage_facts GROUP BY 2
    UNION ALL SELECT 'Photon', CASE WHEN is_photon THEN 'Photon' ELSE 'Spark' END, CAST(sum(usage_quantity) AS DOUBLE)
    FROM usage_facts GROUP BY 2 UNION ALL SELECT 'Serverless', CASE WHEN is_serverless THEN 'Serverless' ELSE 'Classic' END,
    CAST(sum(usage_quantity) AS DOUBLE) FROM usage_facts GROUP BY 2""")
def dynamic_group_key(c: Context) -> DataFrame:
    u, out = U.with_flags(c.t.usage()), None
    for name in U.GROUP_KEYS:
        one = u.groupBy(U.group_key(name).alias("group_key")).agg(F.sum("usage_quantity").alias("units")) \
            .select(F.lit(name).alias("grouping"), "group_key", "units")
        out = one if out is None else out.unionByName(one)
    return out


@query("dynamic_time_key", """
    SELECT 'Day' AS bucket, CAST(usage_date AS VARCHAR) AS time_key, count(*) AS n FROM usage_facts GROUP BY 2
    UNION ALL SELECT 'Week', CAST(CAST(date_trunc('week', usage_date) AS DATE) AS VARCHAR), count(*) FROM usage_facts GROUP BY 2
    UNION ALL SELECT 'Month', CAST(CAST(date_trunc('month', usage_date) AS DATE) AS VARCHAR), count(*) FROM usage_facts GROUP BY 2
    UNION ALL SELECT 'Quarter', CAST(CAST(date_trunc('quarter', usage_date) AS DATE) AS VARCHAR), count(*) FROM usage_facts GROUP BY 2
    UNION ALL SELECT 'Year', CAST(CAST(date_trunc('year', usage_date) AS DATE) AS VARCHAR), count(*) FROM usage_facts GROUP BY 2""")
def dynamic_time_key(c: Context) -> DataFrame:
    out = None
    for name in U.TIME_KEYS:
        one = c.t.usage().groupBy(U.time_key(name).alias("time_key")).agg(F.count(F.lit(1)).alias("n")) \
            .select(F.lit(name).alias("bucket"), "time_key", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("measure_toggle", """
    SELECT billing_origin_product AS product, CAST(sum(CAST(cost AS DECIMAL(28,6))) AS DOUBLE) AS dollars,
           CAST(sum(usage_quantity) AS DOUBLE) AS units FROM priced_half_open GROUP BY 1""")
def measure_toggle(c: Context) -> DataFrame:
    priced = U.price_half_open(c.t.usage(), U.usd_prices(c.t.list_prices())).withColumn(
        "usage_usd", U.cost().cast("decimal(28,6)"))
    return priced.groupBy(F.col("billing_origin_product").alias("product")).agg(
        F.sum(U.measure("Dollars")).alias("dollars"), F.sum(U.measure("DBUs")).alias("units"))


@query("recent_window_filter", """
    SELECT usage_id, CAST(usage_date AS VARCHAR) AS usage_date FROM usage_facts
    WHERE usage_date BETWEEN DATE '2024-01-30' - 9 AND DATE '2024-01-30'""")
def recent_window_filter(c: Context) -> DataFrame:
    return U.recent(c.t.usage(), dt.date(2024, 1, 30), 10).select("usage_id", "usage_date")


@query("like_filter", """
    SELECT u.request_id, se.endpoint_name FROM serving_usage u JOIN served_entities se
      ON u.served_entity_id = se.served_entity_id
    WHERE lower(se.endpoint_name) LIKE '%agent%' AND u.requester = 'user8'""")
def like_filter(c: Context) -> DataFrame:
    joined = U.with_entities(c.t.serving_usage(), c.t.served_entities())
    return joined.filter(F.lower("endpoint_name").like("%agent%") & (F.col("requester") == "user8")).select(
        "request_id", "endpoint_name")


@query("label_with_fallback", """
    SELECT usage_id, CASE WHEN workspace_id = 'w2' THEN 'id: w2' ELSE 'Workspace ' || substring(workspace_id, 2)
           || ' (id: ' || workspace_id || ')' END AS workspace FROM usage_facts""")
def label_with_fallback(c: Context) -> DataFrame:
    name = F.when(F.col("workspace_id") != "w2", F.concat(F.lit("Workspace "), F.substring("workspace_id", 2, 9)))
    return c.t.usage().select("usage_id", U.workspace_label(name, F.col("workspace_id")).alias("workspace"))


@query("queue_projection", f"""
    SELECT payment_id, program, risk_level, n_signals, array_to_string(signal_list, ', ') AS signals,
           recommended_disposition, confidence_score, {dbl('payment_amount_usd', E, V)} FROM scored""")
def queue_projection(c: Context) -> DataFrame:
    return c.s.scored.select("payment_id", "program", "risk_level", "n_signals",
                             F.array_join("signal_list", ", ").alias("signals"), "recommended_disposition",
                             "confidence_score", "payment_amount_usd", E, V)


@query("case_status_label", """
    SELECT payment_id, CASE live_disposition WHEN 'hold_for_verification' THEN 'held' WHEN 'release' THEN 'released'
           WHEN 'refer_to_investigation' THEN 'investigating' ELSE 'pre-disbursement' END AS case_status FROM live_queue""")
def case_status_label(c: Context) -> DataFrame:
    return c.desk.live.select("payment_id", R.case_status(F.col("live_disposition")).alias("case_status"))


@query("scalar_functions", f"""
    SELECT o_orderkey AS id, upper(o_orderpriority) AS up, substring(o_orderpriority, 3) AS sub,
           replace(lower(o_orderpriority), '-', '_') AS repl, trim('  ' || o_orderstatus || ' ') AS trimmed,
           string_split(o_orderpriority, '-')[2] AS part, o_orderpriority LIKE '%H%' AS is_like,
           left(o_orderpriority, 3) AS lft, regexp_replace(o_orderpriority, '[0-9]+', '#') AS rrep,
           regexp_extract(o_orderpriority, '([0-9])', 1) AS rext, contains(o_orderpriority, 'LOW') AS has_low,
           lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded,
           CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS rounded,
           format('{{:,.0f}}', o_totalprice) AS grouped, TRY_CAST(o_orderstatus AS INTEGER) AS tried,
           CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week,
           CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter,
           CAST(CAST(o_orderdate AS DATE) - 29 AS VARCHAR) AS back, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS fwd,
           list_contains(['F','O'], o_orderstatus) AS in_list, array_to_string([o_orderstatus, 'x'], '+') AS joined,
           CAST(NULL AS VARCHAR) AS past_end, o_orderstatus AS struct_field, CAST(o_custkey AS BIGINT) AS map_value,
           CAST(o_custkey AS BIGINT) AS variant_value, o_orderstatus IS DISTINCT FROM 'F' AS distinct_from,
           {tim('o_orderdate')} FROM orders""")
def scalar_functions(c: Context) -> DataFrame:
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    date = F.col("o_orderdate").cast("date")
    return c.t.read("orders").select(
        F.col("o_orderkey").alias("id"), F.upper(pr).alias("up"), F.substring(pr, 3, 99).alias("sub"),
        F.replace(F.lower(pr), F.lit("-"), F.lit("_")).alias("repl"),
        F.trim(F.concat(F.lit("  "), st, F.lit(" "))).alias("trimmed"), F.get(F.split(pr, "-"), F.lit(1)).alias("part"),
        pr.like("%H%").alias("is_like"), F.left(pr, F.lit(3)).alias("lft"),
        F.regexp_replace(pr, "[0-9]+", "#").alias("rrep"), F.regexp_extract(pr, "([0-9])", 1).alias("rext"),
        F.contains(pr, F.lit("LOW")).alias("has_low"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("padded"),
        F.round(F.col("o_totalprice").cast(R.MONEY), 1).alias("rounded"),
        F.format_number("o_totalprice", 0).alias("grouped"), st.try_cast("int").alias("tried"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("week"),
        F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter"),
        F.date_sub(date, 29).alias("back"), F.date_add(date, 1).alias("fwd"),
        F.array_contains(F.array(F.lit("F"), F.lit("O")), st).alias("in_list"),
        F.array_join(F.array(st, F.lit("x")), "+").alias("joined"),
        F.try_element_at(F.array(st), F.lit(5)).alias("past_end"), F.struct(st.alias("a"))["a"].alias("struct_field"),
        F.create_map(F.lit("k"), F.col("o_custkey"))["k"].alias("map_value"),
        F.try_variant_get(F.parse_json(F.concat(F.lit('{"a":['), F.col("o_custkey").cast("string"), F.lit("]}"))),
                          "$.a[0]", "bigint").alias("variant_value"),
        (~st.eqNullSafe(F.lit("F"))).alias("distinct_from"), "o_orderdate")
