"""Adapter views: the product's data model over the driver's tables.

Each view is a narrow projection (no shuffle) so it fuses into the parquet scan.
The same mapping is written independently as DuckDB SQL in
``parcelwise.plans.sqlviews`` for the oracle.

| view            | from      |
|-----------------|-----------|
| properties      | part      |
| violations      | lineitem  |
| complaints      | events (all types but purchase) |
| class_c_events  | events (purchase) |
| requests        | events    |
| updates         | events    |
| subscriptions   | orders    |
| accounts        | customer  |
| categories      | documents |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R

HOTSPOT_DISTRICTS = list(D.INSPECTOR_HOTSPOTS)  # index 0..13 of hotspot_idx

COMPLAINT_TYPES = {"error": "HEAT/HOT WATER", "click": "PLUMBING", "view": "NOISE", "signup": "OTHER"}
SOURCES = ["DOB", "HPD", "FDNY"]


def bbl_of(partkey: Column, size: Column) -> Column:
    boro = (F.lit(1) + partkey % 5).cast("string")
    block = F.lpad((partkey % 100000).cast("string"), 5, "0")
    lot = F.lpad(size.cast("string"), 4, "0")
    return F.concat(boro, block, lot)


def severity_of(value: Column) -> Column:
    return (F.when(value >= 300, "CRITICAL").when(value >= 200, "HIGH")
            .when(value >= 100, "MEDIUM").otherwise("LOW"))


def _case(col: Column, mapping: dict) -> Column:
    """A CASE chain rather than a map lookup: a filter on the label then folds back
    into a predicate on the raw column, which Parquet can push down."""
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


MESSAGE_OF = {"click": "SUBSCRIBE", "view": "UNSUBSCRIBE", "signup": "AUTHENTICATE", "purchase": "PING"}


class Views:
    def __init__(self, tables):
        self.t = tables

    # ------------------------------------------------------------ property
    def properties(self) -> DataFrame:
        k = F.col("p_partkey")
        idx = k % 28
        district = F.when(idx < 14, F.element_at(R.lit_array(HOTSPOT_DISTRICTS), (idx + 1).cast("int")))
        bbl = bbl_of(k, F.col("p_size"))
        return self.t.part.select(
            k.alias("property_id"),
            bbl.alias("bbl"),
            R.borough_from_bbl(bbl).alias("borough"),
            F.col("p_name").alias("address"),
            F.col("p_size").alias("units"),
            F.when(k % 37 == 0, F.lit(None).cast("int"))
             .otherwise((F.lit(1890) + (k * 7) % 137).cast("int")).alias("year_built"),
            F.col("p_type").alias("building_class"),
            F.col("p_brand").alias("tenant_id"),
            (k % 10 != 0).alias("is_monitored"),
            district.alias("council_district"),
        )

    # ----------------------------------------------------------- violation
    def violations(self) -> DataFrame:
        rf = F.col("l_returnflag")
        issued = F.col("l_shipdate").cast("date")
        resolved = F.col("l_linestatus") == "F"
        return self.t.lineitem.select(
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("property_id"),
            F.col("l_suppkey").alias("supp_key"),
            F.when(rf == "R", "C").when(rf == "A", "B").when(rf == "N", "A").alias("violation_class"),
            F.element_at(R.lit_array(SOURCES), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("source"),
            resolved.alias("is_resolved"),
            issued.alias("issued_date"),
            F.when(resolved, F.date_add(issued, F.col("l_quantity").cast("int"))).alias("resolved_date"),
            (F.col("l_quantity") / 5.0).alias("risk_score"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("fine_amount"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("extended_price"),
        )

    # ----------------------------------------------------------- complaint
    def complaints(self, types: list[str] | None = None) -> DataFrame:
        """``types`` pre-filters on the raw event type so Parquet can skip row groups."""
        et = F.col("event_type")
        ev = self.t.events.filter(et != "purchase")
        if types is not None:
            ev = ev.filter(et.isin(*[k for k, v in COMPLAINT_TYPES.items() if v in types]))
        return (ev.select(
            F.col("event_id").alias("unique_key"),
            F.col("user_id").alias("property_id"),
            F.col("ts").alias("created"),
            _case(et, COMPLAINT_TYPES).alias("complaint_type"),
            F.col("value").alias("value"),
        ))

    def class_c_events(self) -> DataFrame:
        return (self.t.events.filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("violation_key"),
            F.col("user_id").alias("property_id"),
            F.col("ts").alias("issued"),
        ))

    def requests(self) -> DataFrame:
        return self.t.events.select(
            F.col("event_id").alias("request_id"),
            F.col("user_id").alias("client"),
            F.col("ts"),
            F.col("event_type").alias("endpoint"),
            (F.col("event_type") == "error").alias("is_error"),
            F.col("value").alias("latency"),
        )

    def updates(self) -> DataFrame:
        return self.t.events.select(
            F.col("event_id").alias("update_id"),
            F.col("user_id").alias("property_id"),
            F.col("event_type").alias("update_type"),
            severity_of(F.col("value")).alias("severity"),
            F.col("ts"),
        )

    def subscriptions(self) -> DataFrame:
        """Subscribed properties spread over keys that grow with the customers."""
        st = F.col("o_orderstatus")
        return self.t.orders.select(
            F.col("o_custkey").alias("connection"),
            F.expr("o_custkey DIV (1 + o_orderkey % 10)").alias("property_id"),
            F.when(st.isin("O", "P"), "SUBSCRIBE").when(st == "F", "UNSUBSCRIBE").alias("action"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_orderkey").alias("seq"),
        )

    def protocol_messages(self) -> DataFrame:
        """Inbound messages of connections, in the protocol's types; a third of them name no property."""
        et, v = F.col("event_type"), F.floor("value").cast("long")
        return self.t.events.select(
            F.col("event_id").alias("message_id"), F.col("user_id").alias("connection"), "ts",
            _case(et, MESSAGE_OF).alias("type"),
            F.when(v % 3 != 0, F.concat(F.lit("p-"), (v % 7).cast("string"))).alias("property_id"))

    def users(self) -> DataFrame:
        """A user per customer, in the tenant of its nation; admins by account balance."""
        return self.t.customer.select(
            F.col("c_custkey").alias("user_id"), F.concat(F.lit("t-"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
            F.lower("c_name").alias("email"), F.when(F.col("c_acctbal") > 5000, "admin").otherwise("member").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"))

    def tenants(self) -> DataFrame:
        """A tenant per nation."""
        return self.t.nation.select(
            F.concat(F.lit("t-"), F.col("n_nationkey").cast("string")).alias("tenant_id"), F.col("n_name").alias("name"),
            F.when(F.col("n_nationkey") % 3 == 0, "enterprise").when(F.col("n_nationkey") % 3 == 1, "pro").otherwise("free").alias("plan"))

    def audit_logs(self) -> DataFrame:
        """What a user did to which resource, from the request log."""
        return self.t.events.select(
            F.col("event_id").alias("log_id"), F.col("user_id"), F.col("ts").alias("created_at"),
            F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "update")
             .when(F.col("event_type") == "signup", "create").otherwise("other").alias("action"),
            F.concat(F.lit("property/"), (F.col("event_id") % 500).cast("string")).alias("resource"))

    def api_keys(self) -> DataFrame:
        """The keys of a user, as digests; every fourth one is revoked."""
        return self.t.customer.select(
            F.col("c_custkey").alias("key_id"), F.col("c_custkey").alias("user_id"),
            F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("key_hash"),
            (F.col("c_custkey") % 4 != 0).alias("is_active"), F.when(F.col("c_custkey") % 2 == 0, 1000).otherwise(100).alias("daily_limit"))

    def accounts(self) -> DataFrame:
        seg = F.col("c_mktsegment")
        return self.t.customer.select(
            F.col("c_custkey").alias("account_key"),
            F.col("c_name").alias("email"),
            F.when(seg == "BUILDING", "free").when(seg.isin("MACHINERY", "AUTOMOBILE"), "pro")
             .otherwise("enterprise").alias("tier"),
            F.col("c_nationkey").alias("nation_key"),
        )

    def categories(self) -> DataFrame:
        return self.t.documents.select(F.col("doc_id"), F.col("text").alias("category"))
