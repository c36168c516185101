"""Stand-in table set over the driver's test tables.

The health tables are not public, so the test tables play their roles:

=====================  =====================================================
role                   test table (columns)
=====================  =====================================================
person                 ``customer`` (``c_custkey``; identity ``c_nationkey``,
                       ``c_mktsegment``; birth = first order date, derived)
measurement            ``events`` (``event_id``, ``user_id``, ``ts``,
                       ``value``, concept ``event_type``)
device_exposure        ``orders`` (``o_orderkey``, ``o_custkey``, ``o_orderdate``)
drug_exposure          ``lineitem`` ⋈ ``orders`` (start ``o_orderdate``,
                       end ``l_shipdate``; ``l_quantity``/``l_extendedprice``
                       only known once shipped)
goldstandard           ``labels`` over ``documents`` (status = ``quality``)
data_dictionary        ``part`` (``p_partkey`` → ``p_name``)
=====================  =====================================================

Every derived column is computed by Spark from the tables, so the work grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schemas as S
from .operators.joins import checked_broadcast
from .plans.explorer import Facet
from .plans.features import ChildConfig, FeatureConfig
from .sources.entityset import EntitySet, from_frames

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed cutoffs of the stand-in queries.
EVENTS_CUTOFF = "2024-02-01 00:00:00"
EVENTS_MID_CUTOFF = "2024-01-15 00:00:00"
ORDERS_CUTOFF = "2002-01-01 00:00:00"
SHIPPED_CUTOFF = "1998-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spec(name, cols, key=None, time=None, person=None, secondary=None):
    return S.TableSpec(name, tuple(S.Col(c, r) for c, r in cols), key=key, time_index=time,
                       secondary=secondary or {}, person_key=person or "person_id")


CUSTOMER_SPEC = _spec("customer", [("c_custkey", S.INDEX), ("c_nationkey", S.CATEGORICAL),
                                   ("c_mktsegment", S.CATEGORICAL), ("c_first_order", S.DATE_OF_BIRTH)],
                      key="c_custkey", person="c_custkey")
EVENTS_SPEC = _spec("events", [("event_id", S.INDEX), ("user_id", S.ID), ("ts", S.TIME_INDEX),
                               ("value", S.NUMERIC), ("event_type", S.CATEGORICAL)],
                    key="event_id", time="ts", person="user_id")
ORDERS_SPEC = _spec("orders", [("o_orderkey", S.INDEX), ("o_custkey", S.ID),
                               ("o_orderdate", S.TIME_INDEX)],
                    key="o_orderkey", time="o_orderdate", person="o_custkey")
SHIPMENTS_SPEC = _spec("shipments", [("l_orderkey", S.ID), ("o_custkey", S.ID),
                                     ("o_orderdate", S.TIME_INDEX), ("l_shipdate", S.DATETIME),
                                     ("l_quantity", S.NUMERIC), ("l_extendedprice", S.NUMERIC)],
                       time="o_orderdate", person="o_custkey",
                       secondary={"l_shipdate": ("l_shipdate", "l_quantity", "l_extendedprice")})
DOCUMENTS_SPEC = _spec("documents", [("doc_id", S.INDEX), ("lang", S.CATEGORICAL),
                                     ("source", S.CATEGORICAL)], key="doc_id", person="doc_id")
LABELS_SPEC = _spec("labels", [("doc_id", S.INDEX), ("status", S.CATEGORICAL)],
                    key="doc_id", person="doc_id")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a derived birth stand-in: the date of their first order."""
    first = (read(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("c_first_order"))
             .withColumnRenamed("o_custkey", "c_custkey"))
    return (read(spark, sf_dir, "customer")
            .select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(first, "c_custkey", "left"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's customer and date (drug-exposure role)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")


def customer_set(spark: SparkSession, sf_dir: str, with_shipments: bool = False) -> EntitySet:
    frames = {"customer": customers(spark, sf_dir),
              "events": read(spark, sf_dir, "events"),
              "orders": read(spark, sf_dir, "orders")}
    specs = {"customer": CUSTOMER_SPEC, "events": EVENTS_SPEC, "orders": ORDERS_SPEC}
    if with_shipments:
        frames["shipments"] = shipments(spark, sf_dir)
        specs["shipments"] = SHIPMENTS_SPEC
    return from_frames("standin", frames, specs, "customer", "c_custkey")


def document_set(spark: SparkSession, sf_dir: str) -> EntitySet:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("status"),
                                                   "toxic")
    frames = {"documents": read(spark, sf_dir, "documents").select("doc_id", "lang", "source"),
              "labels": labels}
    return from_frames("documents", frames, {"documents": DOCUMENTS_SPEC, "labels": LABELS_SPEC},
                       "documents", "doc_id")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"),
                                              F.col("p_name").alias("concept_name"))


def event_code(col: str = "props") -> F.Column:
    """Numeric code carried in the event properties (``{"k": n}``)."""
    return F.get_json_object(F.col(col), "$.k").cast("long")


# ---- feature configurations -----------------------------------------------

EVENT_PRIMS = ("mean", "max", "min", "std", "last", "skew", "time_since_last")
ORDER_PRIMS = ("count", "avg_time_between", "time_since_first")

FLAGSHIP_CONFIG = FeatureConfig(
    target="customer",
    children=(
        ChildConfig("events", EVENT_PRIMS, ("value",), ("event_type",), "event_type", EVENT_PRIMS),
        ChildConfig("orders", ORDER_PRIMS),
    ),
    identity_columns=("c_nationkey", "c_mktsegment"),
    age_column="c_first_order",
)


# ---- explorer facets ---------------------------------------------------------

def explorer_set(spark: SparkSession, sf_dir: str) -> EntitySet:
    """Person + event/visit/shipment children with the columns the views use."""
    ev = read(spark, sf_dir, "events")
    events = ev.select("event_id", "user_id", "ts", "event_type", "value",
                       event_code().alias("code"))
    # measurement ranges per event type: a grouped aggregate (one row per
    # type, partial aggregation) broadcast back after a row-count check
    ranges = ev.groupBy("event_type").agg(F.min("value").alias("range_low"),
                                          F.max("value").alias("range_high"))
    measured = events.join(checked_broadcast(ranges), "event_type", "left")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.substring("o_orderpriority", 1, 1).cast("long").alias("o_priority_code"))
    ship = shipments(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderdate", "l_shipdate",
        "l_quantity", "l_returnflag", "l_linestatus",
        F.col("l_linenumber").cast("double").alias("refills"),
        F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
        .cast("double").alias("days_supply"))
    frames = {"customer": customers(spark, sf_dir), "events": events, "measured": measured,
              "orders": orders, "shipments": ship, "labels": labels_as_status(spark, sf_dir)}
    specs = {
        "customer": CUSTOMER_SPEC, "events": EVENTS_SPEC,
        "measured": _spec("measured", [], key="event_id", time="ts", person="user_id"),
        "orders": ORDERS_SPEC,
        "shipments": _spec("shipments", [], time="o_orderdate", person="o_custkey"),
        "labels": _spec("labels", [], key="c_custkey", person="c_custkey"),
    }
    return EntitySet("explorer", frames, specs)


def labels_as_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document labels keyed like customers (status = quality)."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("c_custkey"),
                                                F.col("quality").cast("long").alias("status"))


# Stand-in text overrides: a returned line reads as "Yes", an accepted one as "No".
FLAG_OVERRIDES = {"R": 1.0, "A": 0.0}

TIMELINE_FACETS = (
    Facet("events", "condition_occurrence", "code",
          {"start_datetime": "ts", "end_datetime": "ts", "Y": "event_type"}),
    Facet("shipments", "drug_exposure", "l_partkey",
          {"start_datetime": "o_orderdate", "end_datetime": "l_shipdate", "refills": "refills",
           "quantity": "l_quantity", "days_supply": "days_supply", "stop_reason": "l_returnflag",
           "Y": "l_linestatus"}),
    Facet("orders", "visit_occurrence", "o_priority_code",
          {"start_datetime": "o_orderdate", "end_datetime": "o_orderdate"}, y_from_concept_name=True),
)

MEASUREMENT_FACETS = (
    Facet("measured", "measurement", "code",
          {"datetime": "ts", "range_low": "range_low", "range_high": "range_high",
           "value_as_number": "value", "unit_source_value": "event_type"},
          scale="minmax", scale_args={"value": "value", "low": "range_low", "high": "range_high"}),
    Facet("shipments", "observation", "l_partkey",
          {"datetime": "l_shipdate", "value_as_number": "l_quantity", "value_as_string": "l_returnflag",
           "unit_source_value": "l_linestatus"},
          scale="affine", scale_args={"value": "l_quantity", "text": "l_returnflag",
                                      "overrides": FLAG_OVERRIDES}),
)
