"""SQL twins of the registered queries (run by DuckDB over the raw tables).

Written as plain SQL over the base tables — the definitions of the
primitives spelled out with ``GROUP BY``, ``row_number()`` and ``CASE`` — so
they check the Spark plans rather than restate them.  Doubles are rounded
to 6 places.  Category lists that name output columns (event types, top
one-hot values) are the values of the sf0.01 tables.
"""

from __future__ import annotations

D = 6
EVENTS_CUTOFF = "TIMESTAMP '2024-02-01 00:00:00'"
EVENTS_MID_CUTOFF = "TIMESTAMP '2024-01-15 00:00:00'"
ORDERS_CUTOFF = "TIMESTAMP '2002-01-01 00:00:00'"
SHIPPED_CUTOFF = "TIMESTAMP '1998-01-01 00:00:00'"

# The event types of the test tables, sorted.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def r(x: str) -> str:
    return f"round({x}, {D})"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1e6)"


def agg_expr(prim: str, v: str | None, t: str, cut: str) -> str:
    if prim == "mean":
        return f"avg({v})"
    if prim in ("max", "min", "sum", "median"):
        return f"{prim}({v})"
    if prim == "std":
        return f"stddev_samp({v})"
    if prim == "skew":
        return (f"CASE WHEN count({v}) < 3 THEN NULL WHEN min({v}) = max({v}) THEN 0.0 "
                f"ELSE skewness({v}) END")
    if prim == "time_since_last":
        return secs(f"max({t})", cut)
    if prim == "time_since_first":
        return secs(f"min({t})", cut)
    if prim == "count":
        return "count(*)"
    if prim == "avg_time_between":
        return (f"CASE WHEN count({t}) >= 2 THEN {secs(f'min({t})', f'max({t})')} / "
                f"(count({t}) - 1) END")
    if prim == "num_unique":
        return f"count(DISTINCT {v})"
    if prim == "trend":
        return f"regr_slope({v}, epoch_us({t}) / 86400e6)"
    if prim == "any":
        return f"bool_or({v})"
    if prim == "all":
        return f"bool_and({v})"
    if prim == "num_true":
        return f"CAST(count_if({v}) AS BIGINT)"
    if prim == "percent_true":
        return f"avg(CAST({v} AS DOUBLE))"
    raise KeyError(prim)


ORDERED = {"last": "DESC", "first": "ASC"}
DOUBLE_OUT = {"mean", "max", "min", "std", "skew", "time_since_last", "time_since_first",
              "avg_time_between", "sum", "median", "trend", "percent_true"}


class Child:
    """A child table as SQL: source, person, time, key columns."""

    def __init__(self, name, source, person, time, key):
        self.name, self.source, self.person, self.time, self.key = name, source, person, time, key


EVENTS = Child("events", "events", "user_id", "ts", "event_id")
ORDERS = Child("orders", "orders", "o_custkey", "o_orderdate", "o_orderkey")


def child_sql(ch: Child, cut: str, prims, values=(), cats=(), where=None):
    """CTEs and output expressions of one child table's features.

    Returns (ctes, [(alias_expr_sql, name)], join_sql) for the per-person
    select over ``customer c``.
    """
    vis = f"{ch.name}_vis"
    ctes = [f"{vis} AS (SELECT * FROM {ch.source} WHERE {ch.time} <= {cut})"]
    aggs, ords, mode_cols = [], [], []
    for p in prims:
        if p in ("count", "time_since_last", "time_since_first", "avg_time_between"):
            aggs.append((agg_expr(p, None, ch.time, cut), f"{ch.name}__{p}", p))
            continue
        cols = list(values) + (list(cats) if p in ("last", "first", "mode", "num_unique") else [])
        for c in cols:
            name = f"{ch.name}__{p}__{c}"
            if p in ORDERED:
                ords.append((p, c, name))
            elif p == "mode":
                mode_cols.append((c, name))
            else:
                aggs.append((agg_expr(p, c, ch.time, cut), name, p))
    joins, outs = [], []
    if aggs:
        a = f"{ch.name}_agg"
        body = ", ".join(f"{e} AS {n}" for e, n, _ in aggs)
        ctes.append(f"{a} AS (SELECT {ch.person} AS k, {body} FROM {vis} GROUP BY {ch.person})")
        joins.append(f"LEFT JOIN {a} ON {a}.k = c.c_custkey")
        for _, n, p in aggs:
            if p == "count" or p == "num_unique" or p == "num_true":
                outs.append(f"coalesce({a}.{n}, 0) AS {n}")
            elif p in DOUBLE_OUT:
                outs.append(f"{r(f'{a}.{n}')} AS {n}")
            else:
                outs.append(f"{a}.{n} AS {n}")
    for direction in ("DESC", "ASC"):
        sel = [(p, c, n) for p, c, n in ords if ORDERED[p] == direction]
        if not sel:
            continue
        o = f"{ch.name}_{'last' if direction == 'DESC' else 'first'}"
        body = ", ".join(f"{c} AS {n}" for _, c, n in sel)
        ctes.append(f"{o} AS (SELECT {ch.person} AS k, {body} FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY {ch.person} ORDER BY {ch.time} {direction}, {ch.key} {direction}) "
                    f"AS rn FROM {vis}) WHERE rn = 1)")
        joins.append(f"LEFT JOIN {o} ON {o}.k = c.c_custkey")
        for _, c, n in sel:
            outs.append(f"{r(f'{o}.{n}')} AS {n}" if c in values else f"{o}.{n} AS {n}")
    for c, n in mode_cols:
        m = f"{ch.name}_mode_{c}"
        ctes.append(f"{m} AS (SELECT k, v AS {n} FROM (SELECT {ch.person} AS k, {c} AS v, row_number() "
                    f"OVER (PARTITION BY {ch.person} ORDER BY count(*) DESC, {c} ASC) AS rn FROM {vis} "
                    f"WHERE {c} IS NOT NULL GROUP BY {ch.person}, {c}) WHERE rn = 1)")
        joins.append(f"LEFT JOIN {m} ON {m}.k = c.c_custkey")
        outs.append(f"{r(f'{m}.{n}')} AS {n}" if c in values else f"{m}.{n} AS {n}")
    return ctes, outs, joins


def where_sql(ch: Child, cut: str, prims, value: str, concept: str, types=EVENT_TYPES):
    """Per (person, concept) features pivoted into one column per concept value."""
    vis = f"{ch.name}_wvis"
    ctes = [f"{vis} AS (SELECT * FROM {ch.source} WHERE {ch.time} <= {cut} AND {concept} IS NOT NULL)"]
    stats = []
    for p in prims:
        if p in ("count", "time_since_last", "time_since_first", "avg_time_between"):
            stats.append((p, f"{ch.name}__{p}", agg_expr(p, None, ch.time, cut)))
        elif p in ORDERED:
            stats.append((p, f"{ch.name}__{p}__{value}", None))
        else:
            stats.append((p, f"{ch.name}__{p}__{value}", agg_expr(p, value, ch.time, cut)))
    body = ", ".join(f"{e} AS {n}" for p, n, e in stats if e is not None)
    ctes.append(f"{ch.name}_long AS (SELECT {ch.person} AS k, {concept} AS w, {body} "
                f"FROM {vis} GROUP BY {ch.person}, {concept})")
    ordered = [(p, n) for p, n, e in stats if e is None]
    src = f"{ch.name}_long"
    if ordered:
        parts = []
        for p, n in ordered:
            d = ORDERED[p]
            parts.append(f"(SELECT k2, w2, v2 AS {n} FROM (SELECT {ch.person} AS k2, {concept} AS w2, "
                         f"{value} AS v2, row_number() OVER (PARTITION BY {ch.person}, {concept} ORDER BY "
                         f"{ch.time} {d}, {ch.key} {d}) AS rn FROM {vis}) WHERE rn = 1) AS o_{p}")
        join = " ".join(f"LEFT JOIN {x} ON o_{p}.k2 = l.k AND o_{p}.w2 = l.w"
                        for x, (p, _) in zip(parts, ordered))
        cols = ", ".join(f"o_{p}.{n}" for p, n in ordered)
        ctes.append(f"{ch.name}_long2 AS (SELECT l.*, {cols} FROM {ch.name}_long l {join})")
        src = f"{ch.name}_long2"
    return ctes, src, [n for _, n, _ in stats], [p for p, _, _ in stats]


def long_query(ch: Child, cut: str, prims, value: str, concept: str) -> str:
    ctes, src, names, ps = where_sql(ch, cut, prims, value, concept)
    outs = ", ".join((f"{r(n)} AS {n}" if p in DOUBLE_OUT or p in ORDERED else n)
                     for n, p in zip(names, ps))
    return (f"WITH {', '.join(ctes)} SELECT k AS c_custkey, w AS {concept}, {outs} FROM {src}")


def wide_parts(ch: Child, cut: str, prims, value: str, concept: str, types=EVENT_TYPES):
    ctes, src, names, ps = where_sql(ch, cut, prims, value, concept, types)
    cols = []
    for t in types:
        for n, p in zip(names, ps):
            e = f"max(CASE WHEN w = '{t}' THEN {n} END)"
            cols.append(f"{e} AS {n}__where_{t}")
    ctes.append(f"{ch.name}_wide AS (SELECT k, {', '.join(cols)} FROM {src} GROUP BY k)")
    outs = []
    for t in types:
        for n, p in zip(names, ps):
            nm = f"{n}__where_{t}"
            if p == "count":   # no rows of that code -> 0
                outs.append(f"coalesce({ch.name}_wide.{nm}, 0) AS {nm}")
            elif p in DOUBLE_OUT or p in ORDERED:
                outs.append(f"{r(f'{ch.name}_wide.{nm}')} AS {nm}")
            else:
                outs.append(f"{ch.name}_wide.{nm} AS {nm}")
    return ctes, outs, [f"LEFT JOIN {ch.name}_wide ON {ch.name}_wide.k = c.c_custkey"]


def customer_query(parts, extra_cols=(), extra_ctes=()) -> str:
    ctes, outs, joins = list(extra_ctes), list(extra_cols), []
    for c, o, j in parts:
        ctes += c
        outs += o
        joins += j
    w = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{w}SELECT c.c_custkey{''.join(', ' + x for x in outs)} FROM customer c {' '.join(joins)}"


EVENT_PRIMS = ("mean", "max", "min", "std", "last", "skew", "time_since_last")
ORDER_PRIMS = ("count", "avg_time_between", "time_since_first")

FIRST_ORDER_CTE = "first_order AS (SELECT o_custkey AS k, min(o_orderdate) AS d FROM orders GROUP BY o_custkey)"


def age_sql(dob: str, cut: str) -> str:
    return f"CAST(floor((epoch_us({cut}) - epoch_us({dob})) / 86400e6) AS DOUBLE) / 365.0::DOUBLE"


def flagship_sql(cut: str = EVENTS_CUTOFF) -> str:
    ident = ["c.c_nationkey AS c_nationkey", "c.c_mktsegment AS c_mktsegment",
             f"{r(age_sql('fo.d', cut))} AS age__c_first_order"]
    parts = [child_sql(EVENTS, cut, EVENT_PRIMS, ("value",), ("event_type",)),
             wide_parts(EVENTS, cut, EVENT_PRIMS, "value", "event_type"),
             child_sql(ORDERS, cut, ORDER_PRIMS)]
    q = customer_query(parts, ident, [FIRST_ORDER_CTE])
    return q.replace("FROM customer c ", "FROM customer c LEFT JOIN first_order fo ON fo.k = c.c_custkey ", 1)


SHIPMENTS = Child("shipments", "(SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o "
                  "ON l.l_orderkey = o.o_orderkey)", "o_custkey", "o_orderdate", "l_orderkey")


def shipped_sql() -> str:
    cut = SHIPPED_CUTOFF
    src = (f"(SELECT o_custkey, o_orderdate, "
           f"CASE WHEN l_shipdate <= {cut} THEN l_quantity END AS l_quantity, "
           f"CASE WHEN l_shipdate <= {cut} THEN l_extendedprice END AS l_extendedprice, l_orderkey "
           f"FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)")
    ch = Child("shipments", src, "o_custkey", "o_orderdate", "l_orderkey")
    return customer_query([child_sql(ch, cut, ("count", "mean", "max"),
                                     ("l_quantity", "l_extendedprice"))])


def per_person_cutoff_sql() -> str:
    cuts = ("cuts AS (SELECT user_id AS k, max(ts) - INTERVAL 3 DAY AS cut FROM events GROUP BY user_id)")
    src = ("(SELECT e.*, cuts.cut FROM events e JOIN cuts ON cuts.k = e.user_id "
           "WHERE e.ts <= cuts.cut)")
    return (f"WITH {cuts}, v AS {src}, "
            f"a AS (SELECT user_id AS k, count(*) AS n, avg(value) AS m, "
            f"{secs('max(ts)', 'max(cut)')} AS tsl FROM v GROUP BY user_id), "
            f"l AS (SELECT user_id AS k, value AS lv FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
            f"ORDER BY ts DESC, event_id DESC) AS rn FROM v) WHERE rn = 1) "
            f"SELECT c.c_custkey, coalesce(a.n, 0) AS events__count, {r('a.m')} AS events__mean__value, "
            f"{r('l.lv')} AS events__last__value, {r('a.tsl')} AS events__time_since_last "
            f"FROM customer c JOIN cuts ON cuts.k = c.c_custkey LEFT JOIN a ON a.k = c.c_custkey "
            f"LEFT JOIN l ON l.k = c.c_custkey")


def one_hot_sql(table: str, key: str, col: str, top: tuple[str, ...]) -> str:
    cols = ", ".join(f"({col} IS NOT DISTINCT FROM '{v}') AS {col}__is_{v}" for v in top)
    known = ", ".join(f"'{v}'" for v in top)
    return (f"SELECT {key}, {cols}, NOT coalesce({col} IN ({known}), false) AS {col}__is_unknown "
            f"FROM {table}")


EXPLORER_DICT = "(SELECT p_partkey AS concept_id, p_name AS concept_name FROM part)"


DAYS_SUPPLY = "CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS DOUBLE)"


def flag_case(p: str) -> str:
    """Affine scaling with the stand-in text overrides (R -> 1, A -> 0)."""
    return (f"CASE WHEN {p}l_returnflag = 'R' THEN 1.0 WHEN {p}l_returnflag = 'A' THEN 0.0 "
            f"ELSE ({p}l_quantity - 90.0) / 10.0 END")


def timeline_sql(person=None) -> str:
    f = "" if person is None else f" WHERE {{p}} = {person}"
    ev = (f"SELECT e.user_id AS person_id, e.ts AS start_datetime, e.ts AS end_datetime, "
          f"e.event_type AS Y, d.concept_name, 'condition_occurrence' AS facet, "
          f"NULL::DOUBLE AS refills, NULL::DOUBLE AS quantity, NULL::DOUBLE AS days_supply, "
          f"NULL::VARCHAR AS stop_reason "
          f"FROM (SELECT * FROM events{f.format(p='user_id')}) e LEFT JOIN {EXPLORER_DICT} d "
          f"ON d.concept_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT)")
    sh = (f"SELECT o.o_custkey AS person_id, o.o_orderdate AS start_datetime, l.l_shipdate AS end_datetime, "
          f"l.l_linestatus AS Y, d.concept_name, 'drug_exposure' AS facet, "
          f"{r('CAST(l.l_linenumber AS DOUBLE)')} AS refills, {r('l.l_quantity')} AS quantity, "
          f"{r(DAYS_SUPPLY)} AS days_supply, "
          f"l.l_returnflag AS stop_reason "
          f"FROM lineitem l JOIN (SELECT * FROM orders{f.format(p='o_custkey')}) o ON l.l_orderkey = o.o_orderkey "
          f"LEFT JOIN {EXPLORER_DICT} d ON d.concept_id = l.l_partkey")
    vi = (f"SELECT o.o_custkey AS person_id, o.o_orderdate AS start_datetime, o.o_orderdate AS end_datetime, "
          f"d.concept_name AS Y, d.concept_name, 'visit_occurrence' AS facet, "
          f"NULL::DOUBLE AS refills, NULL::DOUBLE AS quantity, NULL::DOUBLE AS days_supply, "
          f"NULL::VARCHAR AS stop_reason "
          f"FROM (SELECT * FROM orders{f.format(p='o_custkey')}) o LEFT JOIN {EXPLORER_DICT} d "
          f"ON d.concept_id = CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT)")
    return (f"SELECT person_id, start_datetime, end_datetime, Y, coalesce(concept_name, 'NA') AS concept_name, "
            f"facet, refills, quantity, days_supply, stop_reason FROM ({ev} UNION ALL {sh} UNION ALL {vi})")


def measurements_sql(person=None) -> str:
    f = "" if person is None else f" WHERE {{p}} = {person}"
    me = (f"SELECT e.user_id AS person_id, e.ts AS datetime, {r('g.lo')} AS range_low, {r('g.hi')} AS range_high, "
          f"{r('e.value')} AS value_as_number, e.event_type AS unit_source_value, "
          f"{r('(e.value - g.lo) / nullif(g.hi - g.lo, 0)')} AS value_percentile, "
          f"d.concept_name, 'measurement' AS facet, NULL::VARCHAR AS value_as_string "
          f"FROM (SELECT * FROM events{f.format(p='user_id')}) e "
          f"LEFT JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type) g "
          f"ON g.event_type = e.event_type "
          f"LEFT JOIN {EXPLORER_DICT} d ON d.concept_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT)")
    ob = (f"SELECT o.o_custkey AS person_id, l.l_shipdate AS datetime, NULL::DOUBLE AS range_low, "
          f"NULL::DOUBLE AS range_high, {r('l.l_quantity')} AS value_as_number, "
          f"l.l_linestatus AS unit_source_value, "
          f"{r(flag_case('l.'))} AS value_percentile, "
          f"d.concept_name, 'observation' AS facet, l.l_returnflag AS value_as_string "
          f"FROM lineitem l JOIN (SELECT * FROM orders{f.format(p='o_custkey')}) o ON l.l_orderkey = o.o_orderkey "
          f"LEFT JOIN {EXPLORER_DICT} d ON d.concept_id = l.l_partkey")
    return (f"SELECT person_id, datetime, range_low, range_high, value_as_number, unit_source_value, "
            f"value_percentile, coalesce(concept_name, 'NA') AS concept_name, facet, value_as_string "
            f"FROM ({me} UNION ALL {ob})")


def info_sql(person=None) -> str:
    w = "" if person is None else f" WHERE c.c_custkey = {person}"
    return ("SELECT c.c_custkey, CAST(lb.quality AS BIGINT) AS status, fo.d AS c_first_order, c.c_mktsegment "
            f"FROM customer c LEFT JOIN labels lb ON lb.doc_id = c.c_custkey "
            f"LEFT JOIN (SELECT o_custkey AS k, min(o_orderdate) AS d FROM orders GROUP BY o_custkey) fo "
            f"ON fo.k = c.c_custkey{w}")


LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _lineitem_rounded() -> str:
    return ", ".join(r(c) + f" AS {c}" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
                     else c for c in LINEITEM_COLS)


ORDERS_ROUNDED = ("o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
                  "o_orderdate, o_orderpriority")


def orphan_sql() -> str:
    def one(name, child, ck, parent, pk):
        return (f"SELECT '{name}' AS child, count(*) AS orphan_keys, CAST(coalesce(sum(n), 0) AS BIGINT) "
                f"AS orphan_rows FROM (SELECT {ck} AS k, count(*) AS n FROM {child} GROUP BY {ck}) x "
                f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = x.k)")
    return " UNION ALL ".join([one("orders", "orders", "o_custkey", "customer", "c_custkey"),
                               one("events", "events", "user_id", "customer", "c_custkey"),
                               one("lineitem", "lineitem", "l_orderkey", "orders", "o_orderkey"),
                               one("labels", "labels", "doc_id", "customer", "c_custkey")])


def boolean_sql() -> str:
    ch = Child("events_flagged", "(SELECT *, value > 100.0 AS is_high FROM events)", "user_id", "ts",
               "event_id")
    return customer_query([child_sql(ch, EVENTS_CUTOFF, ("any", "all", "num_true", "percent_true"),
                                     ("is_high",))])


def labelled_sql() -> str:
    # Top-3 lang and source of the sf0.01 documents (by count,
    # ties by value: every source has 50 documents).
    langs, sources = ("en", "fr", "de"), ("src0", "src1", "src10")
    cols = [f"(d.lang IS NOT DISTINCT FROM '{v}') AS lang__is_{v}" for v in langs]
    cols.append(f"NOT coalesce(d.lang IN ({', '.join(repr(v) for v in langs)}), false) AS lang__is_unknown")
    cols += [f"(d.source IS NOT DISTINCT FROM '{v}') AS source__is_{v}" for v in sources]
    cols.append(f"NOT coalesce(d.source IN ({', '.join(repr(v) for v in sources)}), false) "
                "AS source__is_unknown")
    return (f"SELECT l.doc_id, {', '.join(cols)}, CAST(l.quality AS BIGINT) AS status, l.toxic "
            "FROM documents d RIGHT JOIN labels l ON l.doc_id = d.doc_id")


EVENT_CODE = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def many_cutoffs_sql() -> str:
    days = "CAST(unnest([9 + c_custkey % 5, 19 + c_custkey % 3]) AS INTEGER)"
    seen = "events e JOIN g ON e.user_id = g.k AND e.ts <= g.cutoff_time"
    return (
        f"WITH d AS (SELECT c_custkey AS k, c_mktsegment, {days} AS d FROM customer), "
        "g AS (SELECT k, c_mktsegment, TIMESTAMP '2024-01-01 00:00:00' + to_days(d) AS cutoff_time FROM d), "
        "a AS (SELECT g.k, g.cutoff_time, count(*) AS n, sum(value) AS total, max(value) AS hi, min(value) AS lo, stddev_samp(value) AS sd, "
        f"arg_max(value, ts) AS last, {secs('max(ts)', 'g.cutoff_time')} AS since_last, {secs('min(ts)', 'g.cutoff_time')} AS since_first, "
        f"{agg_expr('avg_time_between', None, 'ts', '')} AS gap FROM {seen} GROUP BY g.k, g.cutoff_time) "
        "SELECT g.k AS c_custkey, g.cutoff_time, g.c_mktsegment, coalesce(a.n, 0) AS events__count, "
        f"{r('a.total')} AS events__sum__value, {r('a.hi')} AS events__max__value, {r('a.lo')} AS events__min__value, {r('a.sd')} AS events__std__value, "
        f"{r('a.last')} AS events__last__value, {r('a.since_last')} AS events__time_since_last, {r('a.since_first')} AS events__time_since_first, "
        f"{r('a.gap')} AS events__avg_time_between FROM g LEFT JOIN a ON a.k = g.k AND a.cutoff_time = g.cutoff_time")


def many_codes_sql() -> str:
    stats = [("shipments__count", "CAST(count(*) AS DOUBLE)"), ("shipments__mean__l_quantity", "avg(q)"), ("shipments__max__l_quantity", "max(q)")]
    rows = ("SELECT o_custkey, l_orderkey, CASE WHEN l_shipdate <= " + ORDERS_CUTOFF + " THEN l_quantity END AS q FROM lineitem JOIN orders "
            f"ON l_orderkey = o_orderkey WHERE o_orderdate <= {ORDERS_CUTOFF} AND o_custkey IN (SELECT c_custkey FROM customer)")
    one = [f"SELECT o_custkey AS c_custkey, l_orderkey AS code, '{n}' AS statistic, {r(e)} AS value FROM v GROUP BY 1, 2 HAVING {e} IS NOT NULL" for n, e in stats]
    return f"WITH v AS ({rows}) " + " UNION ALL ".join(one)


def two_columns_sql() -> str:
    rows = f"(SELECT *, CASE WHEN value > 100.0 THEN 'high' ELSE 'low' END AS level FROM events WHERE ts <= {EVENTS_CUTOFF} AND user_id IN (SELECT c_custkey FROM customer))"
    return (f"SELECT user_id AS c_custkey, 'event_type=' || event_type AS code, {r('avg(value)')} AS mean, {r('max(value)')} AS max, CAST(NULL AS DOUBLE) AS n, "
            f"CAST(NULL AS DOUBLE) AS min FROM {rows} WHERE event_type IS NOT NULL GROUP BY user_id, event_type UNION ALL "
            f"SELECT user_id, 'level=' || level, NULL, NULL, CAST(count(*) AS DOUBLE), {r('min(value)')} FROM {rows} GROUP BY user_id, level")


def distribution_sql() -> str:
    base = f"(SELECT *, {EVENT_CODE} AS code FROM events WHERE ts <= {EVENTS_CUTOFF} AND event_type IS NOT NULL)"

    def mode(c: str) -> str:
        return (f"SELECT user_id, event_type, v AS m FROM (SELECT user_id, event_type, {c} AS v, row_number() OVER (PARTITION BY user_id, event_type "
                f"ORDER BY count(*) DESC, {c}) AS rn FROM {base} WHERE {c} IS NOT NULL GROUP BY user_id, event_type, {c}) WHERE rn = 1")

    def entropy(c: str) -> str:
        return (f"SELECT user_id, event_type, -sum(p * ln(p)) AS h FROM (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id, "
                f"event_type) AS p FROM {base} GROUP BY user_id, event_type, {c}) GROUP BY user_id, event_type")

    p = "events_coded__"
    joins = " ".join(f"LEFT JOIN ({q}) {n} ON {n}.user_id = a.user_id AND {n}.event_type = a.event_type"
                     for n, q in (("mv", mode("value")), ("mc", mode("code")), ("hv", entropy("value")), ("hc", entropy("code"))))
    return (f"SELECT a.user_id AS c_custkey, a.event_type, {r('a.med')} AS {p}median__value, {r('mv.m')} AS {p}mode__value, mc.m AS {p}mode__code, "
            f"{r('hv.h')} AS {p}entropy__value, {r('hc.h')} AS {p}entropy__code, a.nv AS {p}num_unique__value, a.nc AS {p}num_unique__code FROM "
            f"(SELECT user_id, event_type, median(value) AS med, count(DISTINCT value) AS nv, count(DISTINCT code) AS nc FROM {base} GROUP BY user_id, event_type) a {joins}")


def contacts_sql(near: int = 12 * 3600, gap: int = 48 * 3600, least: int = 900, signal: float = 5.0) -> str:
    return (
        f"WITH s AS (SELECT user_id AS p, {EVENT_CODE} AS place, epoch_us(ts) AS us FROM events WHERE value >= {signal}), "
        "m AS (SELECT least(x.p, y.p) AS a, greatest(x.p, y.p) AS b, x.us AS earlier, y.us AS later FROM s x JOIN s y ON x.place = y.place AND x.p <> y.p "
        f"AND y.us >= x.us AND y.us <= x.us + {near * 1_000_000} AND (x.us < y.us OR x.p < y.p)), "
        f"o AS (SELECT *, CASE WHEN later - lag(later) OVER (PARTITION BY a, b ORDER BY later) >= {gap * 1_000_000} THEN 1 ELSE 0 END AS begins FROM m), "
        "n AS (SELECT *, sum(begins) OVER (PARTITION BY a, b ORDER BY later ROWS UNBOUNDED PRECEDING) AS session FROM o) "
        "SELECT a, b, make_timestamp(min(earlier)) AS started, make_timestamp(max(later)) AS ended, (max(later) - min(earlier)) / 1e6 AS seconds, "
        f"count(*) AS moments FROM n GROUP BY a, b, session HAVING max(later) - min(earlier) > {least * 1_000_000}")


def risk_sql(salt: str = "study-1:", hashes: int = 4, bits: int = 10, value: float = 150.0) -> str:
    return (
        f"WITH v AS (SELECT user_id, event_type, value, CAST({EVENT_CODE} AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d %H') AS visit FROM events), "
        f"r AS (SELECT DISTINCT visit FROM v WHERE user_id IN (SELECT user_id FROM v WHERE event_type = 'error' AND value > {value})), "
        f"f AS (SELECT CAST(greatest(1, ceil(count(*) * {bits} / 32768.0)) AS BIGINT) * 32768 AS n FROM r), "
        "k AS (SELECT DISTINCT visit FROM v WHERE visit IS NOT NULL), "
        f"p AS (SELECT visit, CAST('0x' || substr(sha256('{salt}' || visit), 1 + 12 * i, 12) AS BIGINT) % (SELECT n FROM f) AS pos FROM k, range({hashes}) t(i)), "
        "b AS (SELECT DISTINCT pos FROM p WHERE visit IN (SELECT visit FROM r)) "
        "SELECT visit, bool_and(pos IN (SELECT pos FROM b)) AS flagged, visit IN (SELECT visit FROM r) AS reported FROM p GROUP BY visit")


def build() -> dict[str, str]:
    q = {}
    q["agg_basic"] = customer_query([child_sql(EVENTS, EVENTS_CUTOFF, ("mean", "max", "min", "std"),
                                               ("value",))])
    q["agg_last"] = customer_query([child_sql(EVENTS, EVENTS_MID_CUTOFF, ("last",), ("value",),
                                              ("event_type",))])
    q["agg_skew"] = customer_query([child_sql(EVENTS, EVENTS_CUTOFF, ("skew",), ("value",))])
    q["agg_time_since"] = customer_query([child_sql(ORDERS, ORDERS_CUTOFF,
                                                    ("time_since_last", "time_since_first"))])
    q["agg_count_gap"] = customer_query([child_sql(ORDERS, ORDERS_CUTOFF, ("count", "avg_time_between"))])
    q["agg_where_long"] = long_query(EVENTS, EVENTS_CUTOFF, EVENT_PRIMS, "value", "event_type")
    q["agg_where_wide"] = customer_query([wide_parts(EVENTS, EVENTS_CUTOFF, EVENT_PRIMS, "value",
                                                     "event_type")])
    hashable = ("mean", "max", "min", "std", "skew", "count", "time_since_last")
    q["agg_where_single_scan"] = customer_query([
        child_sql(EVENTS, EVENTS_CUTOFF, hashable, ("value",)),
        wide_parts(EVENTS, EVENTS_CUTOFF, hashable, "value", "event_type")])
    q["feature_matrix"] = flagship_sql()
    q["feature_matrix_labelled"] = labelled_sql()
    q["cutoff_visibility"] = customer_query([child_sql(EVENTS, EVENTS_MID_CUTOFF,
                                                       ("count", "mean", "last", "time_since_last"),
                                                       ("value",))])
    q["cutoff_per_person"] = per_person_cutoff_sql()
    q["secondary_visibility"] = shipped_sql()
    q["age_years"] = f"SELECT o_orderkey, {r(age_sql('o_orderdate', EVENTS_CUTOFF))} AS age FROM orders"
    q["scale_minmax"] = (
        "SELECT e.event_id, round(e.value, 6) AS value, round(g.lo, 6) AS range_low, round(g.hi, 6) AS range_high, "
        f"{r('(e.value - g.lo) / nullif(g.hi - g.lo, 0)')} AS value_percentile FROM events e "
        "LEFT JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type) g "
        "ON g.event_type = e.event_type")
    q["scale_affine_override"] = (
        "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, l_returnflag, "
        f"{r(flag_case(''))} "
        "AS value_percentile FROM lineitem")
    q["recode_ingest"] = (
        "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN 100.0 "
        "WHEN l_returnflag = 'N' THEN 0.0 ELSE l_quantity END, 6) AS l_quantity FROM lineitem")
    # Top-3 categories of the sf0.01 tables (by count, ties by value).
    q["one_hot"] = one_hot_sql("customer", "c_custkey", "c_mktsegment",
                               ("MACHINERY", "FURNITURE", "BUILDING"))
    q["one_hot_part"] = one_hot_sql("part", "p_partkey", "p_type", ("MEDIUM", "STANDARD", "LARGE"))
    q["patient_info"] = info_sql()
    q["patient_info_one"] = info_sql(7)
    q["patient_timeline"] = timeline_sql()
    q["patient_timeline_one"] = timeline_sql(7)
    q["patient_measurements"] = measurements_sql()
    q["patient_measurements_one"] = measurements_sql(7)
    q["dictionary_lookup"] = (
        "SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, coalesce(d.concept_name, 'NA') AS concept_name "
        "FROM lineitem l LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) AS concept_id, n_name AS concept_name "
        "FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region) d "
        "ON d.concept_id = l.l_suppkey")
    q["drop_all_null"] = f"SELECT {ORDERS_ROUNDED} FROM orders"
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in LINEITEM_COLS)
    q["key_generate"] = (f"SELECT {_lineitem_rounded()}, row_number() OVER (ORDER BY {order}) - 1 AS line_id "
                         "FROM lineitem")
    q["key_check"] = ("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem "
                      "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
    q["orphan_check"] = orphan_sql()
    q["csv_round_trip"] = f"SELECT {ORDERS_ROUNDED} FROM orders"
    q["parquet_round_trip"] = f"SELECT {ORDERS_ROUNDED} FROM orders"
    q["feature_defs_round_trip"] = flagship_sql()
    q["matrix_csv"] = q["agg_basic"]
    q["x_extra"] = customer_query([child_sql(EVENTS, EVENTS_CUTOFF,
                                             ("sum", "median", "mode", "num_unique", "first"),
                                             ("value",), ("event_type",))])
    q["cutoff_many_per_person"] = many_cutoffs_sql()
    q["agg_where_many_codes"] = many_codes_sql()
    q["agg_where_map"] = q["agg_where_long"]
    q["agg_where_two_columns"] = two_columns_sql()
    q["agg_where_distribution"] = distribution_sql()
    q["contact_sessions"] = contacts_sql()
    q["at_risk_probe"] = risk_sql()
    q["load_csv_set"] = (
        f"SELECT 'measurement' AS tbl, event_id AS id, user_id AS person_id, {EVENT_CODE} AS code, CASE WHEN event_id % 7 <> 0 THEN {r('value')} END AS value, "
        "'per \"' || event_type || '\", mg' AS text, ts AS at FROM events UNION ALL SELECT 'person', c_custkey, c_custkey, c_nationkey, NULL, c_mktsegment, NULL FROM customer "
        "UNION ALL SELECT 'goldstandard', doc_id, doc_id, quality, NULL, CAST(toxic AS VARCHAR), NULL FROM labels")
    q["load_csv_narrow"] = (
        f"SELECT event_id AS observation_id, user_id AS person_id, {EVENT_CODE} AS observation_concept_id, ts AS observation_datetime, "
        "CASE event_type WHEN 'click' THEN 100.0 WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.0 ELSE round(value, 6) END AS value_as_number FROM events")
    q["parquet_set_round_trip"] = (
        "SELECT 'customer' AS tbl, c_custkey AS id, c_custkey AS person, CAST(c_nationkey AS DOUBLE) AS value, c_mktsegment AS text, true AS in_bucket FROM customer "
        f"UNION ALL SELECT 'events', event_id, user_id, {r('value')}, event_type, true FROM events "
        f"UNION ALL SELECT 'orders', o_orderkey, o_custkey, {r('o_totalprice')}, o_orderpriority, true FROM orders")
    q["bucket_check"] = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, count(*) AS n_rows, count(DISTINCT {k}) AS persons, count(DISTINCT {k}) AS one_bucket, count(DISTINCT {k}) AS same_in_all, "
        f"true AS in_range FROM {t}" for t, k in (("customer", "c_custkey"), ("events", "user_id"), ("orders", "o_custkey")))
    q["bucketed_matrix"] = q["feature_matrix"]
    q["one_hot_saved"] = (
        "WITH top AS (SELECT c_mktsegment AS category FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), "
        "g AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), "
        "c AS (SELECT c_custkey, c_acctbal * 2 AS bal, CASE WHEN c_custkey % 5 = 0 THEN 'SHIPYARD' WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer) "
        f"SELECT c_custkey, {r('(bal - lo) / nullif(hi - lo, 0)')} AS scaled, category, coalesce(seg = category, false) AS hit FROM c, g, top UNION ALL "
        f"SELECT c_custkey, {r('(bal - lo) / nullif(hi - lo, 0)')}, '(unknown)', NOT coalesce(seg IN (SELECT category FROM top), false) FROM c, g")
    q["x_num_unique_sketch"] = " UNION ALL ".join(
        f"SELECT '{n}' AS of, user_id, count(DISTINCT {e}) AS exact, true AS within_bound FROM events GROUP BY user_id" for n, e in (("code", EVENT_CODE), ("event_id", "event_id")))
    q["x_trend"] = customer_query([child_sql(EVENTS, EVENTS_CUTOFF, ("trend",), ("value",))])
    q["x_boolean"] = boolean_sql()
    q["x_n_most_common"] = (
        "SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS n_most_common FROM ("
        "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, "
        "event_type ASC) AS r FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type) "
        "WHERE r <= 3 GROUP BY user_id")
    q["x_entropy"] = (
        "SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT user_id, "
        "count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) "
        "GROUP BY user_id")
    return q
