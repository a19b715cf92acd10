"""Schemas of the input tables. Reading with a schema skips inference and its footer job."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SIGNAL_CLASSIFICATION = (
    "signal string, signal_category string, classification_confidence double, classification_error string"
)

LIST_PRICES = (
    "sku_name string, usage_unit string, currency_code string, price_start_time timestamp_ntz, "
    "price_end_time timestamp_ntz, unit_price decimal(38,18)"
)

SERVED_ENTITIES = "served_entity_id bigint, endpoint_name string, entity_type string, task string"
