"""Inbound protocol messages: parse, validate, sanitise.

Messages arrive as JSON text; they are parsed with an explicit schema (unknown
fields are dropped by the schema itself — the whitelist), validated against
the protocol, and property ids are reduced to letters and digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.functions import dims as D

MESSAGE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("property_id", T.StringType()),
    T.StructField("token", T.StringType()),
])


def parse(raw: DataFrame, col: str = "raw") -> DataFrame:
    return raw.select("message_id", F.from_json(F.col(col), MESSAGE_SCHEMA).alias("m")).select("message_id", "m.*")


def validate(raw: DataFrame) -> DataFrame:
    """type must be one of the protocol's five; SUBSCRIBE/UNSUBSCRIBE need a property id."""
    m = parse(raw)
    ok = (F.col("type").isin(*D.MESSAGE_TYPES)
          & (~F.col("type").isin("SUBSCRIBE", "UNSUBSCRIBE") | F.col("property_id").isNotNull()))
    return m.select("message_id", "type", "property_id", F.coalesce(ok, F.lit(False)).alias("is_valid"))


def sanitise(raw: DataFrame) -> DataFrame:
    """whitelisted fields only; property id keeps Unicode letters and digits."""
    m = parse(raw)
    return m.select("message_id", "type",
                    F.regexp_replace("property_id", r"[^\p{L}\p{N}]", "").alias("property_id"), "token")
