"""Readers for the input tables and the domain tables derived from them.

Every derivation is a row-local projection or filter except ``payment_flags`` (one distinct) and
``beneficiaries`` (one lookup join), so column pruning and predicates reach the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden import schemas
from paywarden.functions import rules as R

SNAPSHOT_DATE = dt.date(2001, 7, 31)
ONSET_DATE = dt.date(1999, 1, 1)
QUEUE_AS_OF = dt.date(2001, 7, 31)
USAGE_AS_OF = dt.date(2024, 1, 30)

# Market segment → benefit program, order priority → claim type, event type → product / action.
PROGRAM = {
    "HOUSEHOLD": "TANF", "BUILDING": "SNAP", "FURNITURE": "Child Care",
    "MACHINERY": "Disability", "AUTOMOBILE": "Veteran's",
}
CLAIM_TYPE = {
    "1-URGENT": "new_application", "2-HIGH": "recertification", "3-MEDIUM": "supplemental",
    "4-NOT SPECIFIED": "adjustment", "5-LOW": "correction",
}
PRODUCT = {
    "view": "MODEL_SERVING", "click": "AI_GATEWAY", "purchase": "APPS", "signup": "GENIE", "error": "OTHER",
}
ACTION = {"purchase": R.RELEASE, "signup": R.HOLD, "error": R.REFER}
CATEGORY = {
    "duplicate_identity": "fraud", "deceased_payee": "fraud", "cross_agency_fraud_flag": "fraud",
    "income_mismatch": "eligibility", "employment_mismatch": "eligibility",
    "residence_mismatch": "eligibility", "benefit_overlap": "eligibility",
    "manual_review_flag": "administrative",
}
TOOLS = ["find_flag", "rank_dispositions", "ask_data"]


def quoted(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mapped(c: Column, mapping: dict[str, str]) -> Column:
    """The value a literal map holds for the column, NULL when it holds none."""
    entries = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({entries})"), c)


def pick(values: list[str], index: Column) -> Column:
    """Zero-based choice from a literal list."""
    return F.get(F.expr(f"array({', '.join(map(quoted, values))})"), index.cast("int"))


class Tables:
    """Lazy access to one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.path}/{name}.parquet")

    # -- payments ---------------------------------------------------------------------------------

    def beneficiaries(self) -> DataFrame:
        key = F.col("c_custkey")
        first, second = pick(R.SIGNALS, key % 8), pick(R.SIGNALS, (key + 3) % 8)
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                key.alias("beneficiary_id"),
                mapped(F.col("c_mktsegment"), PROGRAM).alias("program"),
                F.col("n_name").alias("state"),
                F.greatest(F.col("c_acctbal").cast(R.MONEY), F.lit(0).cast(R.MONEY)).alias("monthly_income_usd"),
                F.when(key % 3 == 1, first).when(key % 3 == 2, F.concat_ws(" | ", first, second))
                .alias("signal_tags"),
                F.date_add(F.lit(dt.date(1994, 1, 1)), (key % 365).cast("int")).alias("enrollment_date"),
            )
        )

    def claims(self) -> DataFrame:
        return (
            self.read("orders").filter(F.col("o_orderkey") % 20 != 0)
            .select(
                F.col("o_orderkey").alias("claim_id"),
                F.when(F.col("o_orderkey") % 20 == 1, F.col("o_custkey") + 1_000_000)
                .otherwise(F.col("o_custkey")).alias("beneficiary_id"),
                mapped(F.col("o_orderpriority"), CLAIM_TYPE).alias("claim_type"),
                F.col("o_totalprice").cast(R.MONEY).alias("claim_amount_usd"),
                F.col("o_orderdate").cast("date").alias("claim_date"),
            )
        )

    def payments(self) -> DataFrame:
        return (
            self.read("orders")
            .select(
                F.col("o_orderkey").alias("payment_id"),
                F.col("o_custkey").alias("beneficiary_id"),
                F.col("o_orderkey").alias("claim_id"),
                F.col("o_totalprice").cast(R.MONEY).alias("payment_amount_usd"),
                F.col("o_orderdate").cast("date").alias("queue_date"),
                F.lit("pre_disbursement").alias("payment_status"),
            )
        )

    def _flag_rows(self) -> DataFrame:
        return self.read("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05))

    def payment_flags(self) -> DataFrame:
        return self._flag_rows().select(
            F.col("l_orderkey").alias("payment_id"), pick(R.SIGNALS, F.col("l_partkey") % 8).alias("signal"),
        ).distinct()

    def flag_arrivals(self) -> DataFrame:
        """Flags as they arrive: one row per raw match, duplicates included, with an event time."""
        return self._flag_rows().select(
            F.col("l_orderkey").alias("payment_id"), pick(R.SIGNALS, F.col("l_partkey") % 8).alias("signal"),
            F.col("l_shipdate").cast("timestamp").alias("flagged_at"),
        )

    def payment_flags_wave(self) -> DataFrame:
        return (
            self.payment_flags().join(self.payments().select("payment_id", "queue_date"), "payment_id")
            .filter((F.col("queue_date") >= F.lit(ONSET_DATE)) | (F.col("payment_id") * 31 % 100 < 15))
        )

    def signal_classification(self) -> DataFrame:
        rows = [(s, CATEGORY[s], None, None) for s in R.SIGNALS]
        return self.spark.createDataFrame(rows, schemas.SIGNAL_CLASSIFICATION)

    # amount × (customer % 97) / 97, rounded half-up in whole cents
    _RECOVERY = """cast(((cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) * (o_custkey % 97) * 2 + 97) div 194)
                   * 0.01BD as decimal(18,2))"""

    def outcomes(self) -> DataFrame:
        cust, order = F.col("o_custkey"), F.col("o_orderkey")
        n = order % 5
        even = cust % 2 == 0
        improper = F.when(n >= 2, cust % 100 < 85).otherwise(cust % 100 < 8)
        amount = F.col("o_totalprice").cast(R.MONEY)
        return self.read("orders").filter(F.col("o_orderstatus") == "F").select(
            order.alias("case_id"),
            F.when(order % 25 == 0, cust + 1_000_000).otherwise(cust).alias("beneficiary_id"),
            F.col("o_orderdate").cast("date").alias("case_date"),
            amount.alias("amount_usd"),
            n.cast("int").alias("n_signals"),
            F.when(n >= 3, R.REFER)
            .when(n == 2, F.when(even, R.HOLD).otherwise(R.REFER))
            .when(n == 1, F.when(even, R.RELEASE).otherwise(R.HOLD))
            .otherwise(R.RELEASE).alias("disposition_chosen"),
            improper.alias("was_improper"),
            F.when(improper, F.expr(self._RECOVERY)).otherwise(F.lit(0).cast(R.MONEY)).alias("recovery_amount_usd"),
            (cust % 30 + 1).cast("int").alias("days_to_resolution"),
        )

    # -- decisions --------------------------------------------------------------------------------

    def supervisors(self) -> DataFrame:
        """Who may record decisions: three of four of all users that the events name."""
        return self.read("events").filter("user_id % 4 <> 0").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("identity")).distinct()

    def case_actions(self) -> DataFrame:
        e = F.col("event_id")
        status = pick(R.STATUSES, e % 4)
        action = mapped(F.col("event_type"), ACTION)
        by = F.when(e % 10 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string")))
        decided = F.when(status != "proposed", F.col("ts") + F.make_dt_interval(mins=(e % 60).cast("int")))
        base = self.read("events").filter(F.col("event_type").isin(list(ACTION))).select(
            e.alias("id"),
            (e * 7 % 3000).alias("payment_id"),
            pick(R.SIGNALS, e % 8).alias("signal_type"),
            action.alias("action_type"),
            F.when(action == R.HOLD, (e % 4 + 1) * 24).cast("int").alias("hold_duration_hours"),
            F.concat(F.lit("memo "), e.cast("string")).alias("drafted_request"),
            F.col("value").cast(R.MONEY).alias("predicted_recovery_usd"),
            status.alias("status"),
            by.alias("approved_by"),
            F.col("ts").alias("created_at"),
            decided.alias("decided_at"),
        )
        entry = F.struct(
            F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("at"),
            F.col("approved_by").alias("by"), F.col("status").alias("action"),
            F.col("drafted_request").alias("notes"), F.lit("execute_case_action").alias("tool"),
        )
        empty = F.array().cast("array<struct<at:string,by:string,action:string,notes:string,tool:string>>")
        return base.withColumn("audit_trail", F.when(F.col("decided_at").isNotNull(), F.array(entry)).otherwise(empty))

    def decision_events(self) -> DataFrame:
        """One row per event with the values the change feed carries for its entity."""
        e = F.col("event_id")
        return self.read("events").select(
            F.col("user_id").alias("id"), e.alias("event_id"), F.col("ts"), F.col("event_type"),
            pick(R.STATUSES, e % 4).alias("status"), mapped(F.col("event_type"), ACTION).alias("action_type"),
        )

    # -- usage ------------------------------------------------------------------------------------

    def usage(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        return self.read("events").select(
            e.alias("usage_id"),
            F.concat(F.lit("w"), (u % 3).cast("string")).alias("workspace_id"),
            mapped(F.col("event_type"), PRODUCT).alias("billing_origin_product"),
            F.upper("event_type").alias("sku_name"),
            F.lit("DBU").alias("usage_unit"),
            F.col("value").cast("decimal(18,4)").alias("usage_quantity"),
            F.col("ts").alias("usage_end_time"),
            F.col("ts").cast("date").alias("usage_date"),
            F.struct((e % 2 == 0).alias("is_serverless"), (e % 3 == 0).alias("is_photon")).alias("product_features"),
            F.when(u % 4 != 0, F.concat(F.lit("p"), (u % 4).cast("string"))).alias("budget_policy_id"),
            F.create_map(F.lit("team"), F.concat(F.lit("team"), (u % 5).cast("string"))).alias("custom_tags"),
        )

    def list_prices(self) -> DataFrame:
        """Temporal price list, with the default price also inside a nested pricing document."""
        start, turn = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 16)
        # Unit price before and from the turn of the month.
        unit = {"VIEW": ("0.07", "0.08"), "CLICK": ("0.10", "0.12"),
                "PURCHASE": ("0.95", "0.95"), "SIGNUP": ("0.04", "0.05")}
        rows = [(sku, "DBU", "USD", start, turn, Decimal(a)) for sku, (a, _) in unit.items()]
        rows += [(sku, "DBU", "USD", turn, None, Decimal(b)) for sku, (_, b) in unit.items()]
        rows.append(("VIEW", "DBU", "EUR", start, None, Decimal("0.06")))
        return self.spark.createDataFrame(rows, schemas.LIST_PRICES).select(
            "sku_name", "usage_unit", "currency_code", "price_start_time", "price_end_time",
            F.to_variant_object(
                F.struct(F.struct(F.col("unit_price").alias("default")).alias("effective_list"))
            ).alias("pricing"),
        )

    def serving_usage(self) -> DataFrame:
        u = F.col("user_id")
        return self.read("events").select(
            F.col("event_id").alias("request_id"), F.col("ts").alias("request_time"),
            F.concat(F.lit("user"), u.cast("string")).alias("requester"),
            (u % 4).alias("served_entity_id"),
            F.floor(F.col("value") * 10).cast("bigint").alias("input_token_count"),
            F.floor("value").cast("bigint").alias("output_token_count"),
            F.concat(F.lit("w"), (u % 3).cast("string")).alias("workspace_id"),
            F.col("props").alias("request"),
        )

    def served_entities(self) -> DataFrame:
        rows = [
            (0, "governed-agent", "EXTERNAL_MODEL", "chat"),
            (1, "text-embedder", "FOUNDATION_MODEL", "embedding"),
            (2, "coding-assistant", "EXTERNAL_MODEL", "chat"),
        ]
        return self.spark.createDataFrame(rows, schemas.SERVED_ENTITIES)

    # -- conversations ----------------------------------------------------------------------------

    def messages(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        step = F.struct(
            F.lit("tool_call").alias("kind"),
            F.concat_ws("-", F.lit("call"), conv.cast("string"), turn.cast("string")).alias("callId"),
            pick(TOOLS, turn % 3).alias("name"),
        )
        empty = F.array().cast("array<struct<kind:string,callId:string,name:string>>")
        return self.read("conversations").select(
            conv.alias("conversation_id"), turn.alias("position"), "role", F.col("text").alias("content"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
             + F.make_dt_interval(hours=conv.cast("int"), mins=turn.cast("int"))).alias("created_at"),
            F.when((F.col("role") == "assistant") & (conv % 2 == 0), F.array(step)).otherwise(empty).alias("thinking"),
        )

    def conversations(self) -> DataFrame:
        conv = F.col("conversation_id")
        return self.messages().groupBy("conversation_id").agg(
            F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        ).select(
            conv.alias("id"),
            F.concat(F.lit("user"), (conv % 10).cast("string")).alias("user_email"),
            F.concat(F.lit("Conversation "), conv.cast("string")).alias("title"),
            "created_at", "updated_at",
        )

    def feedback(self) -> DataFrame:
        return self.messages().filter((F.col("role") == "assistant") & (F.col("conversation_id") % 3 == 0)).select(
            "conversation_id", "position", "created_at",
            F.when(F.col("position") % 2 == 0, "down").otherwise("up").alias("value"),
        )

    # -- search -----------------------------------------------------------------------------------

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", "embedding", "label")

    def partly_embedded(self) -> DataFrame:
        """Embeddings with every 50th vector missing, for the queries that fill or count the missing ones."""
        return self.vectors().withColumn("embedding", F.when(F.col("vec_id") % 50 != 49, F.col("embedding")))

    def text_documents(self) -> DataFrame:
        return self.read("documents").select("doc_id", "text")

    def playbooks(self) -> DataFrame:
        """Verification guides derived from the documents: one guide per document."""
        d = F.col("doc_id")
        return self.read("documents").select(
            F.concat(F.lit("guide-"), d.cast("string")).alias("guide_id"),
            F.concat(F.lit("Guide "), d.cast("string")).alias("title"),
            F.concat(F.lit("Agency "), F.col("source")).alias("agency"),
            pick(list(PROGRAM.values()), d % 5).alias("program"),
            F.concat(pick(R.SIGNALS, d % 8), F.lit(" review")).alias("scenario"),
            F.col("text").alias("summary"),
            F.array(F.concat(F.lit("confirm "), pick(R.SIGNALS, d % 8)), F.lit("check records"))
            .alias("verification_steps"),
            F.array(F.lit("identity evidence"), F.concat(F.lit("statement "), (d % 7).cast("string")))
            .alias("required_documents"),
            F.concat(F.lit("hold at most "), (d % 4 + 1).cast("string"), F.lit(" days")).alias("hold_guidance"),
            F.concat(F.lit("Section "), (d % 90).cast("string")).alias("authority_citation"),
        )
