"""Usage facts, temporal prices, discounts and spend reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.operators.intervals import interval_join, longest_list
from paywarden.operators.joins import fits_broadcast, sized_join

SPEND = "decimal(18,2)"
# Products in scope of the governance report.
SCOPE = ["MODEL_SERVING", "AI_GATEWAY", "APPS", "GENIE"]
TIME_KEYS = {"Day": "day", "Week": "week", "Month": "month", "Quarter": "quarter", "Year": "year"}


def with_flags(usage: DataFrame) -> DataFrame:
    return usage.withColumn(
        "serverless", F.when(F.col("product_features.is_serverless"), "Serverless").otherwise("Classic")).withColumn(
        "engine", F.when(F.col("product_features.is_photon"), "Photon").otherwise("Spark"))


GROUP_KEYS = {"Product": "billing_origin_product", "SKU": "sku_name", "Photon": "engine", "Serverless": "serverless"}


def group_key(name: str) -> Column:
    return F.col(GROUP_KEYS[name]) if name in GROUP_KEYS else F.lit(None).cast("string")


def time_key(name: str) -> Column:
    """Bucket of the usage day; an unknown name means the day itself."""
    unit = TIME_KEYS.get(name, "day")
    return F.col("usage_date") if unit == "day" else F.date_trunc(unit, "usage_date").cast("date")


def measure(toggle: str) -> Column:
    return F.col("usage_quantity") if toggle == "DBUs" else F.col("usage_usd")


def multi_select(df: DataFrame, c: Column, chosen: list[str]) -> DataFrame:
    """No choice, or the choice 'all', is no predicate."""
    return df if not chosen or "all" in chosen else df.filter(c.isin(chosen))


def recent(usage: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    return usage.filter(F.col("usage_date").between(F.lit(as_of - dt.timedelta(days=days - 1)), F.lit(as_of)))


def workspace_label(name: Column, key: Column) -> Column:
    return F.coalesce(F.concat(name, F.lit(" (id: "), key, F.lit(")")), F.concat(F.lit("id: "), key))


def with_workspace_label(usage: DataFrame, workspaces: DataFrame) -> DataFrame:
    joined = sized_join(usage, workspaces.select("workspace_id", "workspace_name"), ["workspace_id"], "left",
                        spread=F.xxhash64("usage_id"))
    return joined.withColumn("workspace", workspace_label(F.col("workspace_name"), F.col("workspace_id"))) \
        .drop("workspace_name")


def usd_prices(list_prices: DataFrame, path: str = "$.effective_list.default") -> DataFrame:
    return list_prices.filter(F.col("currency_code") == "USD").select(
        "sku_name", "usage_unit", "price_start_time", "price_end_time",
        F.try_variant_get("pricing", path, "decimal(38,18)").alias("unit_price_usd"))


#: Price lists with more intervals of one SKU are joined by dyadic nodes, so that usage does not meet each of them.
LONG_LIST = 64


def _price_join(usage: DataFrame, prices: DataFrame, end: Column, closed: bool, long_list: int = LONG_LIST, **size) -> DataFrame:
    """Few SKUs carry most usage, so the price side is broadcast while small and salted otherwise."""
    keys, start, at = ["sku_name", "usage_unit"], F.col("price_start_time"), F.col("usage_end_time")
    if longest_list(prices, keys) > long_list:
        return interval_join(usage, "usage_id", keys, "usage_end_time", prices, "price_start_time", end, closed, **size)
    valid = (at >= start) & (at <= end if closed else end.isNull() | (at < end))
    return sized_join(usage, prices, keys, "left", residual=valid, spread=F.xxhash64("usage_id"), **size)


def price_half_open(usage: DataFrame, prices: DataFrame, **size) -> DataFrame:
    """start <= t < end; an open end never expires. Unmatched usage stays, unpriced."""
    return _price_join(usage, prices, F.col("price_end_time"), False, **size)


def price_closed(usage: DataFrame, prices: DataFrame, as_of: dt.date, **size) -> DataFrame:
    """start <= t <= end; a usage instant on a shared boundary matches both intervals."""
    until = F.coalesce(F.col("price_end_time"), F.date_add(F.lit(as_of), 1).cast("timestamp_ntz"))
    return _price_join(usage, prices, until, True, **size)


def cost() -> Column:
    """Quantity × unit price; prices per token need up to twelve decimals, and only sums are rounded."""
    return F.col("usage_quantity") * F.col("unit_price_usd").cast("decimal(20,12)")


def product_rollup(priced: DataFrame) -> DataFrame:
    return priced.groupBy(F.col("billing_origin_product").alias("product")).agg(
        F.count(F.lit(1)).alias("usage_records"),
        F.count_if(F.col("unit_price_usd").isNull()).alias("unpriced_records"),
        F.round(F.sum(F.coalesce(cost(), F.lit(0).cast("decimal(18,2)"))), 2).cast(SPEND).alias("list_price_cost_usd"),
    )


def zero_filled(rollup: DataFrame, products: list[str]) -> DataFrame:
    """Every product in scope, absent ones with zeros. Both sides hold one row per product."""
    scope = rollup.sparkSession.createDataFrame([(p,) for p in products], "product string")
    return scope.join(rollup, "product", "left").select(
        "product", F.coalesce("list_price_cost_usd", F.lit(0).cast(SPEND)).alias("list_price_cost_usd"),
        F.coalesce("usage_records", F.lit(0)).alias("usage_records"),
        F.coalesce("unpriced_records", F.lit(0)).alias("unpriced_records"))


def with_total(per_product: DataFrame) -> DataFrame:
    """The grand total beside each aggregated row, as a scalar subquery."""
    total = per_product.agg(F.sum("list_price_cost_usd").cast(SPEND)).scalar()
    return per_product.withColumn("total_list_price_cost_usd", total)


def governance_spend(usage: DataFrame, prices: DataFrame, as_of: dt.date, workspace: str | None = None,
                     products: list[str] = SCOPE) -> DataFrame:
    facts = recent(usage, as_of, 30).filter(F.col("billing_origin_product").isin(products))
    if workspace is not None:
        facts = facts.filter(F.col("workspace_id") == workspace)
    report = with_total(zero_filled(product_rollup(price_half_open(facts, prices)), products))
    return report.withColumn("reporting_start", F.lit(as_of - dt.timedelta(days=29))) \
        .withColumn("reporting_end", F.lit(as_of)).orderBy(F.desc("list_price_cost_usd"), "product")


def spend_totals(per_product: DataFrame) -> DataFrame:
    return per_product.agg(
        F.sum("list_price_cost_usd").alias("total_usd"), F.max("list_price_cost_usd").alias("max_product_usd"),
        F.sum("unpriced_records").alias("unpriced_records"))


def cost_by_product(usage: DataFrame, prices: DataFrame, as_of: dt.date) -> DataFrame:
    priced = price_closed(usage, prices, as_of)
    return priced.groupBy("billing_origin_product").agg(
        F.round(F.sum("usage_quantity"), 3).alias("dbus"),
        F.round(F.sum(F.coalesce(cost(), F.lit(0).cast("decimal(18,2)"))), 2).alias("usd"))


# -- discounts ------------------------------------------------------------------------------------

def parsed_pairs(text: Column) -> Column:
    """``"A=0.1;B=0.2"`` as an array of (order_id, product, discount, combination).

    The text is upper-cased and stripped of white space. Pairs are numbered in sorted order before
    those without '=' are dropped; a value that is no decimal gives a NULL discount.
    """
    pairs = F.sort_array(F.split(F.regexp_replace(F.upper(text), r"\s+", ""), ";"))
    numbered = F.transform(pairs, lambda p, i: F.struct(
        (i + 1).alias("order_id"), F.get(F.split(p, "="), F.lit(0)).alias("product"),
        F.get(F.split(p, "="), F.lit(1)).try_cast("decimal(10,3)").alias("discount"), p.alias("combination")))
    return F.filter(numbered, lambda p: F.contains(p["combination"], F.lit("=")))


def global_discount(text: str) -> Column:
    found = F.regexp_extract(F.lit(text), r"\s*\*\s*=\s*([0-9]*\.?[0-9]+)", 1)
    return found.try_cast("decimal(10,3)")


def discount_table(spark, text: str) -> DataFrame:
    return spark.range(1).select(F.inline(parsed_pairs(F.lit(text))))


def _discount_joins(usage: DataFrame, discounts: DataFrame) -> DataFrame:
    """The OR as two disjoint equi-joins plus the rows neither finds, for a discount table of any size."""
    d = discounts.select(F.col("product").alias("discount_product"), "discount")
    keys = d.select("discount_product").distinct()
    sku, product, found = F.col("sku_name"), F.col("billing_origin_product"), F.col("discount_product")
    by_sku = usage.join(d, found == sku)
    by_product = usage.join(d, (found == product) & ~product.eqNullSafe(sku))
    neither = usage.join(keys, found == sku, "left_anti").join(keys, found == product, "left_anti")
    return by_sku.unionByName(by_product).unionByName(neither, allowMissingColumns=True)


def with_discounts(usage: DataFrame, discounts: DataFrame, bounded: bool = False) -> DataFrame:
    """Usage ⟕ discounts on product = SKU or product = billing product.

    While the discounts fit a broadcast, the OR is two hash lookups in a table grouped by key; where SKU
    and billing product are one key its list is taken once. Larger tables take two disjoint joins. Either
    way equal entries are entries of their own. Usage without any entry stays.
    """
    if not bounded and not fits_broadcast(discounts):
        return _discount_joins(usage, discounts)
    entry = F.struct("order_id", "product", "discount")
    keyed = discounts.groupBy(F.col("product").alias("k")).agg(F.collect_list(entry).alias("found"))
    by_sku = keyed.select(F.col("k").alias("sku_name"), F.col("found").alias("by_sku"))
    by_product = keyed.select(F.col("k").alias("billing_origin_product"), F.col("found").alias("by_product"))
    spread = F.xxhash64("usage_id")
    both = sized_join(usage, by_sku, ["sku_name"], "left", spread=spread, bounded=True)
    both = sized_join(both, by_product, ["billing_origin_product"], "left", spread=spread, bounded=True)
    none = F.array().cast("array<struct<order_id:int,product:string,discount:decimal(10,3)>>")
    both_ways = F.col("sku_name").eqNullSafe(F.col("billing_origin_product"))
    hits = F.concat(F.coalesce("by_sku", none), F.when(both_ways, none).otherwise(F.coalesce("by_product", none)))
    return both.select(*usage.columns, F.explode_outer(hits).alias("d")).select(
        *usage.columns, F.col("d.product").alias("discount_product"), F.col("d.discount").alias("discount"))


def priced_usage(usage: DataFrame, prices: DataFrame, discounts: str, as_of: dt.date) -> DataFrame:
    """Cost with precedence: a global '*' discount, else the matching discount, else list price."""
    table = discount_table(usage.sparkSession, discounts)
    priced = price_closed(with_discounts(usage, table, bounded=True), prices, as_of)
    one = F.lit(1).cast("decimal(10,3)")
    rate = F.coalesce(one - global_discount(discounts), one - F.coalesce("discount", F.lit(0).cast("decimal(10,3)")))
    return priced.withColumn("usage_usd", (cost() * rate).cast("decimal(38,10)"))


def usage_overview(usage: DataFrame, workspaces: DataFrame, prices: DataFrame, discounts: str, as_of: dt.date,
                   time: str = "Day", group: str = "Product", toggle: str = "Dollars",
                   products: list[str] | None = None, serverless: list[str] | None = None) -> DataFrame:
    labelled = with_workspace_label(with_flags(usage), workspaces)
    chosen = multi_select(multi_select(labelled, F.col("billing_origin_product"), products or []),
                          F.col("serverless"), serverless or [])
    priced = priced_usage(chosen, prices, discounts, as_of)
    # the date window of all chosen rows, computed once as a scalar instead of a window over the facts
    span = chosen.agg(F.struct(F.min("usage_date").alias("a"), F.max("usage_date").alias("b"))).scalar()
    return priced.withColumn("w", span).select(
        "usage_id", time_key(time).alias("time_key"), group_key(group).alias("group_key"),
        measure(toggle).alias("usage_usd_dynamic"), "usage_usd", "usage_unit",
        F.col("usage_quantity").alias("usage_dbus"), F.col("serverless").alias("is_serverless"),
        F.col("workspace").alias("workspace_norm"), F.lit("Actuals").alias("usage_type"),
        F.lit(f"per {time}").alias("time_period"), F.col("w.a").alias("start_time_window"),
        F.col("w.b").alias("end_time_window"),
        F.concat(F.col("w.a").cast("string"), F.lit(" to "), F.col("w.b").cast("string")).alias("time_window_string"))


# -- serving --------------------------------------------------------------------------------------

def with_entities(requests: DataFrame, entities: DataFrame) -> DataFrame:
    return sized_join(requests, entities, ["served_entity_id"], "inner", spread=F.xxhash64("request_id"))


def usage_by_endpoint(requests: DataFrame, entities: DataFrame, approximate: bool = False) -> DataFrame:
    """Requests and tokens per endpoint; ``approximate`` trades the exact requester count for a sketch."""
    who = F.approx_count_distinct("requester") if approximate else F.countDistinct("requester")
    return with_entities(requests, entities).groupBy("endpoint_name", "entity_type", "task").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_token_count").alias("input_tokens"),
        F.sum("output_token_count").alias("output_tokens"), who.alias("requesters"),
        F.min("request_time").alias("first_request"), F.max("request_time").alias("last_request"))


# -- reports whose source publishes only a name; the definitions here are this project's -----------

def period_over_period(usage_usd: DataFrame, unit: str = "week") -> DataFrame:
    """Spend per key and period next to the previous period with rows. The window sees one row per period."""
    sums = usage_usd.groupBy("group_key", F.date_trunc(unit, "usage_date").cast("date").alias("period")).agg(
        F.sum("usage_usd").alias("spend_usd"))
    prev = F.lag("spend_usd").over(Window.partitionBy("group_key").orderBy("period"))
    return sums.withColumn("previous_usd", prev).withColumn("delta_usd", F.col("spend_usd") - F.col("previous_usd"))\
        .withColumn("delta_share", F.when(F.col("previous_usd") != 0, F.col("delta_usd").cast("double")
                                          / F.col("previous_usd").cast("double")))


def top_n_with_remaining(per_key: DataFrame, n: int) -> DataFrame:
    """The n largest keys plus one row for all others.

    The top is a bounded top-n; the remainder is the grand total minus it, so no global window ranks
    the keys.
    """
    top = per_key.orderBy(F.desc("spend_usd"), "group_key").limit(n)
    total = per_key.agg(F.struct(F.sum("spend_usd").alias("usd"), F.count(F.lit(1)).alias("n"))).scalar()
    rest = top.agg(F.coalesce(F.sum("spend_usd"), F.lit(0)).alias("usd"), F.count(F.lit(1)).alias("k")) \
        .withColumn("t", total).filter(F.col("t.n") > F.col("k")).select(
            F.lit("remaining").alias("group_key"), (F.col("t.usd") - F.col("usd")).alias("spend_usd"),
            (F.col("t.n") - F.col("k")).alias("n_keys"))
    return top.select("group_key", "spend_usd", F.lit(1).cast("bigint").alias("n_keys")).unionByName(rest)


def tag_match(usage: DataFrame, key: str, value: str, case_sensitive: bool = False) -> DataFrame:
    """Usage split by tag entry, counting rows whose tag matches the searched key and value."""
    entries = usage.select("usage_id", "usage_quantity", F.explode_outer(F.map_entries("custom_tags")).alias("t"))
    k, v = F.col("t.key"), F.col("t.value")
    if not case_sensitive:
        k, v, key, value = F.lower(k), F.lower(v), key.lower(), value.lower()
    hit = F.coalesce((k == key) & v.contains(value), F.lit(False))
    return entries.groupBy(F.col("t.key").alias("tag_key"), F.col("t.value").alias("tag_value")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("mismatched"),
        F.sum("usage_quantity").alias("units"))


def burndown(daily: DataFrame, commitment: str) -> DataFrame:
    """Cumulative spend per workspace against a committed amount; the window runs over daily sums only."""
    run = Window.partitionBy("workspace_id").orderBy("usage_date").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("spend_usd").over(run)
    return daily.withColumn("spent_usd", spent).withColumn(
        "remaining_usd", F.lit(commitment).cast("decimal(18,2)") - F.col("spent_usd"))
