"""Registered queries over the driver's test tables, with their SQL twins.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs a library operator on the
stand-in tables (see ``standins``); ``ORACLE[name]`` is an independent SQL
statement over the raw tables that must give the same rows.  Doubles are
rounded to 6 places on both sides; every column is aliased the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from . import standins as SI
from .functions.scaling import affine_with_overrides, age_years, minmax_scale, recode_text
from .operators.clean import drop_all_null_columns
from .operators.contacts import contact_sessions
from .operators.encode import one_hot
from .operators.grouping import entropy, n_most_common
from .operators.joins import lookup_join
from .operators.keys import duplicate_keys, generate_key, orphan_links, with_bucket
from .operators.riskfilter import build_filter, filter_bits, probe_filter
from .operators.sketches import daily_sketches, error_bound, estimates, merge_sketches
from .operators.sparse import from_sparse
from .plans.explorer import patient_info, patient_measurements, patient_timeline
from .plans.features import ChildConfig, FeatureConfig, feature_matrix, plan_features
from .session import scratch_path
from .sources.bucketed import load_bucketed, save_bucketed
from .sources.csv import read_csv_typed
from .sources.encoders import fit_encoding, load_encoding, save_encoding
from .sources.entityset import RECODED, load_csv, load_parquet, save
from .sources.featuredefs import load_defs, save_defs, write_matrix

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every top-level double column for comparison (one SQL expression
    per column: fewer driver round trips than building Column objects)."""
    return df.selectExpr(*[f"round(`{f.name}`, {digits}) AS `{f.name}`"
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f"`{f.name}`"
                           for f in df.schema.fields])


# ---------------------------------------------------------------------------
# Aggregations over children (A1-A10), one config each
# ---------------------------------------------------------------------------

def _matrix(spark, sf_dir, config, cutoff, **kw) -> DataFrame:
    es = SI.customer_set(spark, sf_dir, with_shipments=any(c.table == "shipments"
                                                           for c in config.children))
    return rounded(feature_matrix(es, config, cutoff, **kw).matrix)


def _cfg(*children, identity=(), age=None):
    return FeatureConfig("customer", tuple(children), tuple(identity), age)


BASIC = _cfg(ChildConfig("events", ("mean", "max", "min", "std"), ("value",)))
LAST = _cfg(ChildConfig("events", ("last",), ("value",), ("event_type",)))
SKEW = _cfg(ChildConfig("events", ("skew",), ("value",)))
TIME_SINCE = _cfg(ChildConfig("orders", ("time_since_last", "time_since_first")))
COUNT_GAP = _cfg(ChildConfig("orders", ("count", "avg_time_between")))
VISIBLE = _cfg(ChildConfig("events", ("count", "mean", "last", "time_since_last"), ("value",)))
SHIPPED = _cfg(ChildConfig("shipments", ("count", "mean", "max"), ("l_quantity", "l_extendedprice")))
WHERE = _cfg(ChildConfig("events", (), ("value",), ("event_type",), "event_type", SI.EVENT_PRIMS))
HASHABLE = ("mean", "max", "min", "std", "skew", "count", "time_since_last")
SINGLE_SCAN = _cfg(ChildConfig("events", HASHABLE, ("value",), (), "event_type", HASHABLE))
EXTRA = _cfg(ChildConfig("events", ("sum", "median", "mode", "num_unique", "first"), ("value",),
                         ("event_type",)))
TREND = _cfg(ChildConfig("events", ("trend",), ("value",)))
BOOLEAN = _cfg(ChildConfig("events_flagged", ("any", "all", "num_true", "percent_true"), ("is_high",)))


def q_agg_basic(spark, sf_dir):
    return _matrix(spark, sf_dir, BASIC, SI.EVENTS_CUTOFF)


def q_agg_last(spark, sf_dir):
    return _matrix(spark, sf_dir, LAST, SI.EVENTS_MID_CUTOFF)


def q_agg_skew(spark, sf_dir):
    return _matrix(spark, sf_dir, SKEW, SI.EVENTS_CUTOFF)


def q_agg_time_since(spark, sf_dir):
    return _matrix(spark, sf_dir, TIME_SINCE, SI.ORDERS_CUTOFF)


def q_agg_count_gap(spark, sf_dir):
    return _matrix(spark, sf_dir, COUNT_GAP, SI.ORDERS_CUTOFF)


def q_cutoff_visibility(spark, sf_dir):
    return _matrix(spark, sf_dir, VISIBLE, SI.EVENTS_MID_CUTOFF)


def q_secondary_visibility(spark, sf_dir):
    return _matrix(spark, sf_dir, SHIPPED, SI.SHIPPED_CUTOFF)


def _event_cutoffs(spark, sf_dir) -> DataFrame:
    """Per-user cutoff derived from the data: three days before the user's last event."""
    return (SI.read(spark, sf_dir, "events").groupBy("user_id")
            .agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("cutoff_time"))
            .withColumnRenamed("user_id", "c_custkey"))


def q_cutoff_per_person(spark, sf_dir):
    es = SI.customer_set(spark, sf_dir)
    res = feature_matrix(es, VISIBLE, _event_cutoffs(spark, sf_dir).withColumnRenamed(
        "c_custkey", "person_id"))
    return rounded(res.matrix)


def q_agg_where_long(spark, sf_dir):
    es = SI.customer_set(spark, sf_dir)
    res = feature_matrix(es, WHERE, SI.EVENTS_CUTOFF, layout="long")
    return rounded(res.long["events"])


def q_agg_where_wide(spark, sf_dir):
    return _matrix(spark, sf_dir, WHERE, SI.EVENTS_CUTOFF, layout="wide")


def q_agg_where_single_scan(spark, sf_dir):
    """Per-person and per-type features from one grouping-sets scan (no ordered primitive)."""
    return _matrix(spark, sf_dir, SINGLE_SCAN, SI.EVENTS_CUTOFF, layout="wide")


def q_feature_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, SI.FLAGSHIP_CONFIG, SI.EVENTS_CUTOFF)


def q_feature_matrix_labelled(spark, sf_dir):
    es = SI.document_set(spark, sf_dir)
    cfg = FeatureConfig("documents", (), ("lang", "source"), None, "labels")
    res = feature_matrix(es, cfg, SI.EVENTS_CUTOFF, encode=True, top_n=3)
    return rounded(res.matrix)


def q_x_extra(spark, sf_dir):
    return _matrix(spark, sf_dir, EXTRA, SI.EVENTS_CUTOFF)


def q_x_trend(spark, sf_dir):
    return _matrix(spark, sf_dir, TREND, SI.EVENTS_CUTOFF)


def q_x_boolean(spark, sf_dir):
    es = SI.customer_set(spark, sf_dir)
    flagged = es["events"].withColumn("is_high", F.col("value") > F.lit(100.0))
    es = es.with_table("events_flagged", flagged, SI.EVENTS_SPEC)
    return rounded(feature_matrix(es, BOOLEAN, SI.EVENTS_CUTOFF).matrix)


def q_x_n_most_common(spark, sf_dir):
    ev = SI.read(spark, sf_dir, "events")
    top = n_most_common(ev, ["user_id"], "event_type", n=3)
    return top.select("user_id", F.array_join("n_most_common", ",").alias("n_most_common"))


def q_x_entropy(spark, sf_dir):
    ev = SI.read(spark, sf_dir, "events")
    return rounded(entropy(ev, ["user_id"], "event_type"))


# ---------------------------------------------------------------------------
# Several cutoffs a person, and conditional features beyond a column per code
# ---------------------------------------------------------------------------

MANY_CUTOFFS = _cfg(ChildConfig("events", ("count", "sum", "max", "min", "std", "last", "time_since_last", "time_since_first",
                                           "avg_time_between"), ("value",)), identity=("c_mktsegment",))
MANY_CODES = _cfg(ChildConfig("shipments", (), ("l_quantity",), (), "l_orderkey", ("count", "mean", "max")))
TWO_COLUMNS = _cfg(ChildConfig("events_levelled", (), ("value",), (), "event_type", ("mean", "max")),
                   ChildConfig("events_levelled", (), ("value",), (), "level", ("count", "min")))
DISTRIBUTION = _cfg(ChildConfig("events_coded", (), ("value",), ("code",), "event_type", ("median", "mode", "entropy", "num_unique")))


def q_cutoff_many_per_person(spark, sf_dir):
    """Two cutoffs a customer, by its key; the events are read once."""
    days = F.array(F.lit(9) + F.pmod("c_custkey", F.lit(5)), F.lit(19) + F.pmod("c_custkey", F.lit(3)))
    cutoffs = SI.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.explode(days).alias("d"))
    cutoffs = cutoffs.select("person_id", F.expr("timestampadd(DAY, cast(d AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("cutoff_time"))
    return rounded(feature_matrix(SI.customer_set(spark, sf_dir), MANY_CUTOFFS, cutoffs, many_cutoffs=True).matrix)


def q_agg_where_many_codes(spark, sf_dir):
    """Features per order key: at sf0.01 15,000 codes, as sparse vectors, unpacked."""
    es = SI.customer_set(spark, sf_dir, with_shipments=True)
    res = feature_matrix(es, MANY_CODES, SI.ORDERS_CUTOFF, layout="sparse")
    return rounded(from_sparse(res.matrix, ["c_custkey"], "shipments__where_l_orderkey", res.dictionaries["shipments__where_l_orderkey"]))


def q_agg_where_map(spark, sf_dir):
    """The map layout, unpacked."""
    m = feature_matrix(SI.customer_set(spark, sf_dir), WHERE, SI.EVENTS_CUTOFF, layout="map").matrix
    return rounded(m.select("c_custkey", F.explode("events__where_event_type").alias("event_type", "v")).select("c_custkey", "event_type", "v.*"))


def q_agg_where_two_columns(spark, sf_dir):
    """Two condition columns of one table, each with its own primitives."""
    es = SI.customer_set(spark, sf_dir)
    es = es.with_table("events_levelled", es["events"].withColumn("level", F.when(F.col("value") > 100.0, "high").otherwise("low")), SI.EVENTS_SPEC)
    m = feature_matrix(es, TWO_COLUMNS, SI.EVENTS_CUTOFF, layout="map").matrix
    stats = {"event_type": {"mean": "events_levelled__mean__value", "max": "events_levelled__max__value"},
             "level": {"n": "events_levelled__count", "min": "events_levelled__min__value"}}
    frames = [m.select("c_custkey", F.explode(f"events_levelled__where_{c}").alias("code", "v")).select(
        "c_custkey", F.concat(F.lit(f"{c}="), "code").alias("code"),
        *[(F.col(f"v.{names[a]}") if a in names else F.lit(None)).cast("double").alias(a) for a in ("mean", "max", "n", "min")])
        for c, names in stats.items()]
    return rounded(frames[0].unionByName(frames[1]))


def q_agg_where_distribution(spark, sf_dir):
    """Distribution primitives per code."""
    es = SI.customer_set(spark, sf_dir)
    es = es.with_table("events_coded", es["events"].withColumn("code", SI.event_code()), SI.EVENTS_SPEC)
    return rounded(feature_matrix(es, DISTRIBUTION, SI.EVENTS_CUTOFF, layout="long").long["events_coded"])


# ---------------------------------------------------------------------------
# Contacts and the at-risk filter
# ---------------------------------------------------------------------------

CONTACT_NEAR, CONTACT_GAP = 12 * 3600, 48 * 3600  # the test events are hours apart
CONTACT_SIGNAL = 5.0
RISK_SALT = "study-1:"
RISK_VALUE = 150.0  # a user with an error event above it is a reporter


def q_contact_sessions(spark, sf_dir):
    """Users seen at one place (the code of an event's properties) within CONTACT_NEAR seconds."""
    seen = SI.read(spark, sf_dir, "events").withColumn("place", SI.event_code())
    return contact_sessions(seen, "user_id", "place", "ts", CONTACT_NEAR, CONTACT_GAP, signal="value", least_signal=CONTACT_SIGNAL)


def q_at_risk_probe(spark, sf_dir):
    """Every visit (place and hour) probed against the filter of the reporters' visits, beside the exact answer."""
    visits = SI.read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.concat_ws(
        "@", SI.event_code().cast("string"), F.date_format("ts", "yyyy-MM-dd HH")).alias("visit"))
    reporters = visits.where((F.col("event_type") == "error") & (F.col("value") > RISK_VALUE)).select("user_id").distinct()
    reports = visits.join(reporters, "user_id", "left_semi").select("visit").distinct()
    n_bits = filter_bits(reports.count())
    probed = probe_filter(visits, "visit", build_filter(reports, "visit", n_bits, RISK_SALT), n_bits, RISK_SALT)
    return probed.join(reports.withColumn("reported", F.lit(True)), "visit", "left").select(
        "visit", "flagged", F.coalesce("reported", F.lit(False)).alias("reported"))


# ---------------------------------------------------------------------------
# Row-level transforms
# ---------------------------------------------------------------------------

def q_age_years(spark, sf_dir):
    o = SI.read(spark, sf_dir, "orders")
    return rounded(o.select("o_orderkey", age_years("o_orderdate", SI.EVENTS_CUTOFF).alias("age")))


def q_scale_minmax(spark, sf_dir):
    m = SI.explorer_set(spark, sf_dir)["measured"]
    return rounded(m.select("event_id", "value", "range_low", "range_high",
                            minmax_scale("value", "range_low", "range_high").alias("value_percentile")))


def q_scale_affine_override(spark, sf_dir):
    li = SI.read(spark, sf_dir, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
                             affine_with_overrides("l_quantity", "l_returnflag",
                                                   overrides=SI.FLAG_OVERRIDES)
                             .alias("value_percentile")))


# Stand-in recode at load: accepted lines read as "Yes" (100), open ones as "No" (0).
FLAG_RECODE = {"A": 100.0, "N": 0.0}


def q_recode_ingest(spark, sf_dir):
    li = SI.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                   "l_returnflag")
    out = li.withColumn("l_quantity", recode_text("l_quantity", "l_returnflag", FLAG_RECODE))
    return rounded(out.drop("l_returnflag"))


def q_one_hot(spark, sf_dir):
    c = SI.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return one_hot(c, ["c_mktsegment"], top_n=3)[0]


def q_one_hot_part(spark, sf_dir):
    p = SI.read(spark, sf_dir, "part").select("p_partkey", "p_type")
    return one_hot(p, ["p_type"], top_n=3)[0]


# ---------------------------------------------------------------------------
# Explorer views
# ---------------------------------------------------------------------------

ONE_PERSON = 7
INFO_COLUMNS = ("status", "c_first_order", "c_mktsegment")


def q_patient_info(spark, sf_dir):
    es = SI.explorer_set(spark, sf_dir)
    return patient_info(es, None, person="customer", label="labels", columns=INFO_COLUMNS)


def q_patient_info_one(spark, sf_dir):
    es = SI.explorer_set(spark, sf_dir)
    return patient_info(es, ONE_PERSON, person="customer", label="labels", columns=INFO_COLUMNS)


def q_patient_timeline(spark, sf_dir):
    es = SI.explorer_set(spark, sf_dir)
    return rounded(patient_timeline(es, SI.dictionary(spark, sf_dir), None, SI.TIMELINE_FACETS))


def q_patient_timeline_one(spark, sf_dir):
    es = SI.explorer_set(spark, sf_dir)
    return rounded(patient_timeline(es, SI.dictionary(spark, sf_dir), ONE_PERSON, SI.TIMELINE_FACETS))


def q_patient_measurements(spark, sf_dir):
    es = SI.explorer_set(spark, sf_dir)
    return rounded(patient_measurements(es, SI.dictionary(spark, sf_dir), None, SI.MEASUREMENT_FACETS))


def q_patient_measurements_one(spark, sf_dir):
    es = SI.explorer_set(spark, sf_dir)
    return rounded(patient_measurements(es, SI.dictionary(spark, sf_dir), ONE_PERSON,
                                        SI.MEASUREMENT_FACETS))


def _small_dictionary(spark, sf_dir) -> DataFrame:
    """Nation and region names as one code list: codes 0-4 occur twice."""
    n = SI.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("concept_id"),
                                               F.col("n_name").alias("concept_name"))
    r = SI.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("concept_id"),
                                               F.col("r_name").alias("concept_name"))
    return n.unionByName(r)


def q_dictionary_lookup(spark, sf_dir):
    li = SI.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = lookup_join(li, _small_dictionary(spark, sf_dir), "l_suppkey")
    return out.withColumn("concept_name", F.coalesce("concept_name", F.lit("NA")))


# ---------------------------------------------------------------------------
# Keys, links, cleaning
# ---------------------------------------------------------------------------

def q_drop_all_null(spark, sf_dir):
    o = SI.read(spark, sf_dir, "orders")
    # refund amount: only negative totals would carry one, and there are none
    o = o.withColumn("o_refund", F.when(F.col("o_totalprice") < 0, -F.col("o_totalprice")))
    return rounded(drop_all_null_columns(o, keep=("o_orderkey",)))


def q_key_generate(spark, sf_dir):
    li = SI.read(spark, sf_dir, "lineitem")
    return rounded(generate_key(li, "line_id", dense=True))


def q_key_check(spark, sf_dir):
    li = SI.read(spark, sf_dir, "lineitem")
    return duplicate_keys(li, ["l_orderkey", "l_linenumber"])


def q_orphan_check(spark, sf_dir):
    cust = SI.read(spark, sf_dir, "customer")
    orders = SI.read(spark, sf_dir, "orders")
    parts = [
        ("orders", orphan_links(orders, cust, "o_custkey", "c_custkey")),
        ("events", orphan_links(SI.read(spark, sf_dir, "events"), cust, "user_id", "c_custkey")),
        ("lineitem", orphan_links(SI.read(spark, sf_dir, "lineitem"), orders, "l_orderkey",
                                  "o_orderkey")),
        ("labels", orphan_links(SI.read(spark, sf_dir, "labels"), cust, "doc_id", "c_custkey")),
    ]
    frames = [df.agg(F.count(F.lit(1)).alias("orphan_keys"),
                     F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("orphan_rows"))
              .select(F.lit(name).alias("child"), "orphan_keys", "orphan_rows") for name, df in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def q_bucket_assign(spark, sf_dir):
    c = SI.read(spark, sf_dir, "customer").select("c_custkey")
    return with_bucket(c, "c_custkey", 16)


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

def _scratch(spark, tag) -> str:
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])


def q_csv_round_trip(spark, sf_dir):
    path = _scratch(spark, "orders-csv")
    SI.read(spark, sf_dir, "orders").write.option("header", "true").csv(path)
    return rounded(read_csv_typed(spark, path, ORDERS_SCHEMA))


def q_parquet_round_trip(spark, sf_dir):
    es = SI.customer_set(spark, sf_dir)
    es = es.with_table("orders", with_bucket(es["orders"], "o_custkey", 8))
    path = _scratch(spark, "standin-set")
    save(es, path, partition_by="partition")
    back = load_parquet(spark, path, tables=("orders",))
    return rounded(back["orders"].drop("partition"))


def _write_csv(df: DataFrame, folder: str, table: str) -> None:
    df.write.mode("append").option("header", "true").option("quote", '"').option("escape", '"').csv(f"{folder}/{table}.csv")


def q_load_csv_set(spark, sf_dir):
    """Persons, measurements and labels from CSV files of two column orders, with doubled quotes, NaN, codes
    written as floats and a label column beyond the declared ones; one row per table and key."""
    folder = _scratch(spark, "csv-set")
    ev = SI.read(spark, sf_dir, "events")
    odd = F.col("event_id") % 2 == 1
    cells = {"measurement_id": F.col("event_id"), "person_id": F.col("user_id"), "measurement_datetime": F.col("ts").cast("string"),
             "measurement_concept_id": F.when(odd, F.concat(SI.event_code().cast("string"), F.lit(".0"))).otherwise(SI.event_code().cast("string")),
             "value_as_number": F.when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("value").cast("string")),
             "unit_source_value": F.concat(F.lit('per "'), "event_type", F.lit('", mg'))}
    for names, part in ((list(cells), ~odd), (list(cells)[::-1], odd)):
        _write_csv(ev.where(part).select(*[cells[n].alias(n) for n in names]), folder, "measurement")
    _write_csv(SI.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gender_concept_id"), F.col("c_custkey").alias("person_id"),
                                                         F.col("c_mktsegment").alias("gender_source_value")), folder, "person")
    _write_csv(SI.read(spark, sf_dir, "labels").select(F.col("quality").alias("status"), F.col("toxic").alias("site"), F.col("doc_id").alias("person_id")),
               folder, "goldstandard")
    es = load_csv(spark, folder, tables=("person", "measurement", "goldstandard"), block_bytes=40 * 1024 * 1024)
    m = es["measurement"].select(F.lit("measurement").alias("tbl"), F.col("measurement_id").alias("id"), "person_id", F.col("measurement_concept_id").alias("code"),
                                 F.col("value_as_number").alias("value"), F.col("unit_source_value").alias("text"), F.col("measurement_datetime").alias("at"))
    p = es["person"].select(F.lit("person").alias("tbl"), F.col("person_id").alias("id"), "person_id", F.col("gender_concept_id").alias("code"),
                            F.lit(None).cast("double").alias("value"), F.col("gender_source_value").alias("text"), F.lit(None).cast("timestamp_ntz").alias("at"))
    g = es["goldstandard"].select(F.lit("goldstandard").alias("tbl"), F.col("person_id").alias("id"), "person_id", F.col("status").alias("code"),
                                  F.lit(None).cast("double").alias("value"), F.col("site").alias("text"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return rounded(m.unionByName(p).unionByName(g))


def q_load_csv_narrow(spark, sf_dir):
    """Observations by the narrow load: Yes, No and Never become numbers and the text goes."""
    folder = _scratch(spark, "csv-narrow")
    answer = (F.when(F.col("event_type") == "click", "Yes").when(F.col("event_type") == "error", "No")
              .when(F.col("event_type") == "view", "Never").when(F.col("event_type") == "signup", "maybe"))
    ev = SI.read(spark, sf_dir, "events").select(
        F.col("ts").cast("string").alias("observation_datetime"), answer.alias("value_as_string"), F.col("user_id").alias("person_id"), F.col("value").alias("value_as_number"),
        F.col("event_id").alias("observation_id"), SI.event_code().alias("observation_concept_id"), F.lit("x").alias("unit_source_value"))
    _write_csv(ev, folder, "observation")
    return rounded(load_csv(spark, folder, tables=("observation",), wide=False)["observation"].drop(RECODED))


def q_parquet_set_round_trip(spark, sf_dir):
    """Three tables saved by bucket and read back: a row per table and key, and whether its bucket is its person's."""
    es = SI.customer_set(spark, sf_dir)
    for name, key in (("customer", "c_custkey"), ("events", "user_id"), ("orders", "o_custkey")):
        es = es.with_table(name, with_bucket(es[name], key, 8))
    path = _scratch(spark, "bucketed-set")
    save(es, path, partition_by="partition")
    back = load_parquet(spark, path)

    def rows(name, key, person, value, text):
        ok = F.col("partition") == F.pmod(F.xxhash64(person), F.lit(8))
        return back[name].select(F.lit(name).alias("tbl"), F.col(key).alias("id"), F.col(person).alias("person"), F.col(value).cast("double").alias("value"),
                                 F.col(text).alias("text"), ok.alias("in_bucket"))

    return rounded(rows("customer", "c_custkey", "c_custkey", "c_nationkey", "c_mktsegment").unionByName(
        rows("events", "event_id", "user_id", "value", "event_type")).unionByName(rows("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")))


def q_bucket_check(spark, sf_dir):
    """Buckets of three tables: rows, persons, how many persons have one bucket, and whether all tables agree on it."""
    tables = (("customer", "c_custkey"), ("events", "user_id"), ("orders", "o_custkey"))
    marked = [with_bucket(SI.read(spark, sf_dir, t).select(F.col(k).alias("person")), "person", 16).withColumn("tbl", F.lit(t)) for t, k in tables]
    rows = marked[0].unionByName(marked[1]).unionByName(marked[2])
    person = rows.groupBy("person", "tbl").agg(F.count(F.lit(1)).alias("n"), F.min("partition").alias("low"), F.max("partition").alias("high"))
    across = person.groupBy("person").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.collect_list(F.struct("tbl", "n", "low", "high")).alias("t"))
    each = across.select("first", "last", F.explode("t").alias("t")).select("first", "last", "t.*")
    return each.groupBy("tbl").agg(
        F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("persons"), F.count_if(F.col("low") == F.col("high")).alias("one_bucket"),
        F.count_if(F.col("first") == F.col("last")).alias("same_in_all"), F.bool_and((F.col("low") >= 0) & (F.col("high") < 16)).alias("in_range"))


def q_bucketed_matrix(spark, sf_dir):
    """The flagship matrix from a set stored by person bucket."""
    path = _scratch(spark, "bucketed")
    save_bucketed(SI.customer_set(spark, sf_dir), path, 16)
    return rounded(feature_matrix(load_bucketed(spark, path), SI.FLAGSHIP_CONFIG, SI.EVENTS_CUTOFF).matrix)


def q_one_hot_saved(spark, sf_dir):
    """Categories and a range fitted on the customers, stored, and applied to a changed table; one row per customer and
    indicator."""
    c = SI.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    path = _scratch(spark, "encoding")
    save_encoding(spark, fit_encoding(c, ["c_mktsegment"], ["c_acctbal"], top_n=3), path)
    changed = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "SHIPYARD").when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    enc = load_encoding(spark, path)
    out = enc.apply(changed.withColumn("c_acctbal", F.col("c_acctbal") * 2))
    names = [n for n in out.columns if n.startswith("c_mktsegment__is_")]
    labels = [*enc.categories["c_mktsegment"], "(unknown)"]
    cells = F.array(*[F.struct(F.lit(v).alias("category"), F.col(n).alias("hit")) for v, n in zip(labels, names, strict=True)])
    return rounded(out.select("c_custkey", F.col("c_acctbal__scaled").alias("scaled"), F.explode(cells).alias("c")).select("c_custkey", "scaled", "c.*"))


def q_x_num_unique_sketch(spark, sf_dir):
    """Distinct codes of each user from merged daily sketches, against the exact count."""
    ev = SI.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", SI.event_code().alias("code"))
    out = None
    for column in ("code", "event_id"):
        kept = daily_sketches(ev, "user_id", "ts", column)
        found = estimates(merge_sketches(kept, "user_id")).join(ev.groupBy("user_id").agg(F.count_distinct(column).alias("exact")), "user_id")
        close = F.abs(F.col("num_unique") - F.col("exact")) <= error_bound(F.col("exact"))
        found = found.select(F.lit(column).alias("of"), "user_id", "exact", close.alias("within_bound"))
        out = found if out is None else out.unionByName(found)
    return out


def q_feature_defs_round_trip(spark, sf_dir):
    es = SI.customer_set(spark, sf_dir)
    defs = plan_features(es, SI.FLAGSHIP_CONFIG)
    path = _scratch(spark, "feature-defs")
    save_defs(spark, defs, path, SI.FLAGSHIP_CONFIG)
    loaded, cfg = load_defs(spark, path)
    return rounded(feature_matrix(es, cfg, SI.EVENTS_CUTOFF, defs=loaded).matrix)


def q_matrix_csv(spark, sf_dir):
    m = _matrix(spark, sf_dir, BASIC, SI.EVENTS_CUTOFF)
    path = _scratch(spark, "matrix-csv")
    write_matrix(m, path, fmt="csv")
    return rounded(read_csv_typed(spark, path, m.schema))


QUERIES = {
    "agg_basic": q_agg_basic,
    "agg_last": q_agg_last,
    "agg_skew": q_agg_skew,
    "agg_time_since": q_agg_time_since,
    "agg_count_gap": q_agg_count_gap,
    "agg_where_long": q_agg_where_long,
    "agg_where_wide": q_agg_where_wide,
    "agg_where_single_scan": q_agg_where_single_scan,
    "feature_matrix": q_feature_matrix,
    "feature_matrix_labelled": q_feature_matrix_labelled,
    "cutoff_visibility": q_cutoff_visibility,
    "cutoff_per_person": q_cutoff_per_person,
    "secondary_visibility": q_secondary_visibility,
    "age_years": q_age_years,
    "scale_minmax": q_scale_minmax,
    "scale_affine_override": q_scale_affine_override,
    "recode_ingest": q_recode_ingest,
    "one_hot": q_one_hot,
    "one_hot_part": q_one_hot_part,
    "patient_info": q_patient_info,
    "patient_info_one": q_patient_info_one,
    "patient_timeline": q_patient_timeline,
    "patient_timeline_one": q_patient_timeline_one,
    "patient_measurements": q_patient_measurements,
    "patient_measurements_one": q_patient_measurements_one,
    "dictionary_lookup": q_dictionary_lookup,
    "drop_all_null": q_drop_all_null,
    "key_generate": q_key_generate,
    "key_check": q_key_check,
    "orphan_check": q_orphan_check,
    "bucket_assign": q_bucket_assign,
    "csv_round_trip": q_csv_round_trip,
    "parquet_round_trip": q_parquet_round_trip,
    "feature_defs_round_trip": q_feature_defs_round_trip,
    "matrix_csv": q_matrix_csv,
    "cutoff_many_per_person": q_cutoff_many_per_person,
    "agg_where_many_codes": q_agg_where_many_codes,
    "agg_where_map": q_agg_where_map,
    "agg_where_two_columns": q_agg_where_two_columns,
    "agg_where_distribution": q_agg_where_distribution,
    "contact_sessions": q_contact_sessions,
    "at_risk_probe": q_at_risk_probe,
    "load_csv_set": q_load_csv_set,
    "load_csv_narrow": q_load_csv_narrow,
    "parquet_set_round_trip": q_parquet_set_round_trip,
    "bucket_check": q_bucket_check,
    "bucketed_matrix": q_bucketed_matrix,
    "one_hot_saved": q_one_hot_saved,
    "x_num_unique_sketch": q_x_num_unique_sketch,
    "x_extra": q_x_extra,
    "x_trend": q_x_trend,
    "x_boolean": q_x_boolean,
    "x_n_most_common": q_x_n_most_common,
    "x_entropy": q_x_entropy,
}
