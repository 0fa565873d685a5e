"""Filters, listings, paging, set operations and table maintenance (F, T, U, J8–J11).

Optional API parameters become optional conjuncts; Catalyst pushes them into
the parquet scan.  Listings order by a total order so offset/limit pages are
stable; a global ``orderBy`` range-partitions on its keys, which also splits a
hot tenant across tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R

VIOLATION_ORDER_TIEBREAK = ["order_key", "line_no", "property_id", "supp_key", "quantity", "extended_price",
                            "violation_class", "source"]


def _and(conds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conds) if conds else None


def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    """every query restricted to one tenant."""
    return df.filter(F.col("tenant_id") == tenant_id)


def list_violations(violations: DataFrame, property_id=None, source=None, is_resolved=None,
                    skip: int = 0, limit: int = 100) -> DataFrame:
    """optional conjuncts; newest first with NULL dates first (as Postgres DESC); offset/limit."""
    conds = []
    if property_id is not None:
        conds.append(F.col("property_id") == property_id)
    if source is not None:
        conds.append(F.col("source") == source)
    if is_resolved is not None:
        conds.append(F.col("is_resolved") == is_resolved)
    v = violations.filter(_and(conds)) if conds else violations
    order = [F.col("issued_date").desc_nulls_first()] + [F.col(c).asc() for c in VIOLATION_ORDER_TIEBREAK]
    return v.orderBy(*order).offset(skip).limit(limit)


def property_search(scored: DataFrame, bbl=None, borough=None, min_risk=None, max_risk=None,
                    limit: int = 100) -> DataFrame:
    """F3 over the scored feed: equality / inclusive range, head(limit) by parcel key."""
    s = scored.withColumn("borough", R.borough_from_bbl("bbl"))
    conds = []
    if bbl is not None:
        conds.append(F.col("bbl") == bbl)
    if borough is not None:
        conds.append(F.upper("borough") == borough.upper())
    if min_risk is not None:
        conds.append(F.col("compliance_risk_score") >= min_risk)
    if max_risk is not None:
        conds.append(F.col("compliance_risk_score") <= max_risk)
    if conds:
        s = s.filter(_and(conds))
    return s.orderBy("bbl").limit(limit)


def property_lookup(properties: DataFrame, ids: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """point lookups by id (+ tenant) as a semi join against the requested ids."""
    p = properties if tenant_id is None else tenant_scope(properties, tenant_id)
    return p.join(ids.select("property_id").distinct(), "property_id", "left_semi")


def bbl_quality(raw: DataFrame, col: str = "raw_bbl") -> DataFrame:
    """strip, drop '-' and spaces, validate 10 digits with borough 1–5."""
    clean = R.clean_bbl(F.col(col))
    return raw.select("*", clean.alias("bbl"), R.valid_bbl(clean).alias("is_valid"),
                      R.borough_from_bbl(clean).alias("borough"))


def era_filter(properties: DataFrame, missing_year: int | None = 2000) -> DataFrame:
    """counts before 1974, before 1960 and their difference (no lower bound)."""
    y = F.coalesce(F.col("year_built"), F.lit(missing_year)) if missing_year is not None else F.col("year_built")
    agg = properties.groupBy("tenant_id").agg(F.count_if(y < D.ELEVATED_YEAR).alias("pre1974"),
                                              F.count_if(y < D.CRITICAL_YEAR).alias("pre1960"))
    return agg.withColumn("rent_stabilized_era", F.col("pre1974") - F.col("pre1960"))


def violations_by_address(properties: DataFrame, violations: DataFrame, needle: str) -> DataFrame:
    """properties whose address contains ``needle`` (case-insensitive) and their violations."""
    p = properties.filter(F.lower("address").contains(needle.lower())).select("property_id", "address", "bbl")
    per = violations.groupBy("property_id").agg(F.count(F.lit(1)).alias("violations"),
                                                F.count_if(~F.col("is_resolved")).alias("open_violations"))
    return p.join(per, "property_id", "left").fillna({"violations": 0, "open_violations": 0})


def retention_split(df: DataFrame, ts_col: str, as_of: str, keep_days: int | None = None,
                    keep_months: int | None = None) -> DataFrame:
    """flag rows younger than the retention period."""
    t = F.col(ts_col).cast("date")
    ref = F.lit(as_of).cast("date")
    cutoff = F.add_months(ref, -keep_months) if keep_months is not None else F.date_sub(ref, keep_days)
    return df.withColumn("retained", t >= cutoff)


def retained_rows(df: DataFrame, dataset: str, ts_col: str, as_of: str) -> DataFrame:
    """F13 summary: rows of a data class inside and outside its retention."""
    return (retention_split(df, ts_col, as_of, **D.RETENTION[dataset]).groupBy("retained")
            .agg(F.count(F.lit(1)).alias("rows")).withColumn("dataset", F.lit(dataset)))


def high_risk_topk(scored: DataFrame, limit: int = 20) -> DataFrame:
    """Order by score desc (key as tie-break), head(limit)."""
    return scored.orderBy(F.desc("compliance_risk_score"), F.asc("bbl")).limit(limit)


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """offset/limit over a total order."""
    return df.orderBy(*order).offset(skip).limit(limit)


# ------------------------------------------------------------- set operations
def canonical_violations(violations: DataFrame) -> DataFrame:
    """Three raw feeds with their own schemas mapped to one canonical record and stacked."""
    hpd = (violations.filter(F.col("source") == "HPD").select(
        F.concat_ws("-", F.lit("HPD"), "order_key", "line_no").alias("violationid"),
        "property_id", F.col("violation_class").alias("class"),
        F.when(F.col("is_resolved"), "Close").otherwise("Open").alias("currentstatus"),
        F.concat(F.lit("HPD class "), F.col("violation_class")).alias("novdescription")))
    dob = (violations.filter(F.col("source") == "DOB").select(
        F.concat_ws("-", F.lit("DOB"), "order_key", "line_no").alias("violation_number"),
        "property_id", F.col("violation_class").alias("violation_type"),
        F.when(F.col("is_resolved"), "RESOLVED").alias("disposition")))
    fdny = (violations.filter(F.col("source") == "FDNY").select(
        F.concat_ws("-", F.lit("FDNY"), "order_key", "line_no").alias("ticket"),
        "property_id", F.col("violation_class").alias("severity"), "is_resolved"))
    c_hpd = hpd.select(F.col("violationid").alias("external_id"), "property_id", F.lit("HPD").alias("source"),
                       F.col("class").alias("violation_type"), F.col("novdescription").alias("description"),
                       (F.col("currentstatus") != "Open").alias("is_resolved"))
    c_dob = dob.select(F.col("violation_number").alias("external_id"), "property_id", F.lit("DOB").alias("source"),
                       F.col("violation_type"),
                       F.upper(F.coalesce("disposition", F.lit(""))).isin(*D.RESOLVED_DISPOSITIONS).alias("is_resolved"))
    c_fdny = fdny.select(F.col("ticket").alias("external_id"), "property_id", F.lit("FDNY").alias("source"),
                         F.col("severity").alias("violation_type"), "is_resolved")
    return c_hpd.unionByName(c_dob, allowMissingColumns=True).unionByName(c_fdny, allowMissingColumns=True)


def bbl_universe(*keyed: DataFrame) -> DataFrame:
    """Distinct parcel keys of either side."""
    return reduce(lambda a, b: a.union(b), [k.select("bbl") for k in keyed]).distinct()


def dedup_on_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per natural key — the row with the greatest ``order_cols`` (then all
    other columns).  An aggregate of ``max(struct)`` is combined map-side, so a key
    holding a third of the rows never lands whole in one task."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols + rest])
    return df.groupBy(*keys).agg(F.max(packed).alias("_w")).select(*keys, "_w.*")


# ------------------------------------------------------------ maintenance
def semi(df: DataFrame, members: DataFrame, on) -> DataFrame:
    """J8 membership."""
    return df.join(members, on, "left_semi")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is absent are inserted (unioned); the others are reported rejected.
    Duplicate keys inside the batch keep one row each (deterministic)."""
    inc = dedup_on_key(incoming, keys, [c for c in incoming.columns if c not in keys][:1])
    accepted = inc.join(existing.select(*keys), keys, "left_anti")
    rejected = inc.join(existing.select(*keys), keys, "left_semi")
    return existing.unionByName(accepted, allowMissingColumns=True), rejected


def partial_update(existing: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``changes`` has ``<field>`` and ``<field>_set``; set fields win, even when null."""
    c = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields],
                       *[F.col(f"{f}_set").alias(f"_set_{f}") for f in fields])
    j = existing.join(c, key, "left")
    for f in fields:
        j = j.withColumn(f, F.when(F.coalesce(F.col(f"_set_{f}"), F.lit(False)), F.col(f"_new_{f}"))
                         .otherwise(F.col(f)).cast(existing.schema[f].dataType))
    return j.select(*existing.columns)


def delete_by_key(existing: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Anti join on the (tenant-scoped) key."""
    return existing.join(deletes.select(*keys), keys, "left_anti")


def compliance_report(violations: DataFrame, property_ids: DataFrame, start: str, end: str,
                      include_resolved: bool = False) -> DataFrame:
    """K4/F8: violations of the requested properties issued in [start, end]."""
    v = (violations.join(property_ids, "property_id", "left_semi")
         .filter(F.col("issued_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return v if include_resolved else v.filter(~F.col("is_resolved"))


def hash_keys(violations: DataFrame) -> DataFrame:
    """Stable digests of the duplicate key (md5 of the sorted fields, sha-256)."""
    s = F.concat_ws("|", F.concat(F.lit("line_no="), F.col("line_no").cast("string")),
                    F.concat(F.lit("order_key="), F.col("order_key").cast("string")))
    return violations.select("order_key", "line_no", F.md5(s).alias("md5_key"), F.sha2(s, 256).alias("sha256_key"))
