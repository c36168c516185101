"""Feature definitions and the per-person feature matrix.

The planner expands a ``FeatureConfig`` into a list of ``FeatureSpec``s
(child table × primitive × column [× concept value]) plus the target's own
categorical columns and its age.  Evaluation turns that list into, per child
table, **one** ``groupBy(person)`` for the plain aggregates and **one**
``groupBy(person, concept)`` for the conditional ones, then left-joins the
per-person results onto the target (all hash-partitioned on the person key).

Nothing large reaches the driver: only the concept vocabulary (for the wide
layout) and the top categories (for one-hot encoding).
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, asdict, replace

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.primitives import PRIMITIVES, default_for, primitive
from ..functions.scaling import age_years
from ..operators.encode import one_hot
from ..operators.grouping import (conditional_long, distinct_values, entropy, grouped_median,
                                  grouped_mode, long_to_map, n_most_common,
                                  pivot_rows, safe_token, value_place)
from ..operators.asof import MERGEABLE, asof_aggregates
from ..operators.joins import assemble, attach_label
from ..operators.sparse import feature_dictionary, to_sparse
from ..operators.visibility import (CUTOFF_COL, attach_cutoff, cutoff_is_small, is_per_person,
                                   visible_rows)
from ..session import written
from ..sources.entityset import EntitySet, RECODED

TABLE_LEVEL = {"count", "time_since_last", "time_since_first", "avg_time_between"}
VALUE_ANY_TYPE = {"last", "first", "mode", "num_unique", "num_unique_approx", "n_most_common", "entropy"}
# Primitives over a value distribution: computed from groupBy(person, value)
# counts, then one more groupBy(person) — not a single aggregate expression.
TWO_PHASE = {"n_most_common", "entropy", "median", "mode"}
# Primitives ordered by (time, key): their struct-typed buffers make Spark plan
# a sort-based aggregate.
ORDERED = {"last", "first"}
N_MOST_COMMON = 3


@dataclass(frozen=True)
class ChildConfig:
    table: str
    primitives: tuple[str, ...] = ()
    value_columns: tuple[str, ...] = ()        # numeric inputs
    categorical_columns: tuple[str, ...] = ()  # inputs of last/first/mode/num_unique only
    where_column: str | None = None            # concept column of conditional features
    where_primitives: tuple[str, ...] = ()
    where_values: tuple | None = None          # None: every distinct value
    n_most_common: int = N_MOST_COMMON         # values of the n_most_common primitive


@dataclass(frozen=True)
class FeatureConfig:
    target: str = "person"
    children: tuple[ChildConfig, ...] = ()
    identity_columns: tuple[str, ...] = ()
    age_column: str | None = None
    label_table: str | None = None


@dataclass(frozen=True)
class FeatureSpec:
    name: str                  # SQL-safe column name
    table: str
    primitive: str             # aggregate primitive, "identity" or "age"
    column: str | None = None
    where_column: str | None = None
    where_value: object = None  # None with a where_column: every value (long and map layouts)
    categorical: bool = False  # output is categorical (one-hot target)
    n: int = N_MOST_COMMON     # values of n_most_common

    @property
    def display(self) -> str:
        if self.primitive == "identity":
            return self.column
        inner = self.table if self.column is None else f"{self.table}.{self.column}"
        if self.where_column is not None:
            inner += f" WHERE {self.where_column} = {'each' if self.where_value is None else self.where_value}"
        return f"{self.primitive.upper()}({inner})"


# The reference's feature configuration (primitives, tables and
# columns it enables).
REFERENCE_AGG = ("mean", "max", "min", "std", "last", "skew", "time_since_last")
REFERENCE_DEVICE = ("count", "avg_time_between", "time_since_first")
REFERENCE_CONFIG = FeatureConfig(
    target="person",
    children=(
        ChildConfig("measurement", REFERENCE_AGG, ("value_as_number",), ("measurement_concept_id",),
                    "measurement_concept_id", REFERENCE_AGG),
        ChildConfig("observation", REFERENCE_AGG, (RECODED,), ("observation_concept_id",),
                    "observation_concept_id", REFERENCE_AGG),
        ChildConfig("device_exposure", REFERENCE_DEVICE),
    ),
    identity_columns=("gender_concept_id", "race_concept_id", "ethnicity_concept_id", "location_id"),
    age_column="birth_datetime",
    label_table="goldstandard",
)


def feature_name(table: str, prim: str, column: str | None = None,
                 where_column: str | None = None, where_value=None) -> str:
    name = f"{table}__{prim}" + (f"__{column}" if column else "")
    if where_column is not None:
        name += f"__where_{safe_token(where_value)}"
    return name


def _child_specs(cfg: ChildConfig, prims: tuple[str, ...], where_value=None, each: bool = False,
                 by_column: bool = False) -> list[FeatureSpec]:
    """``each``: conditional on every value; ``by_column``: the condition's column is in the name."""
    wc = cfg.where_column if where_value is not None or each else None
    token = "each" if each else f"{wc}_{where_value}" if by_column else where_value
    token = f"{wc}_each" if each and by_column else token
    out = []

    def add(p: str, column: str | None = None, categorical: bool = False) -> None:
        out.append(FeatureSpec(feature_name(cfg.table, p, column, wc, token), cfg.table, p, column, wc,
                               where_value, categorical, cfg.n_most_common))

    for p in prims:
        if p not in PRIMITIVES and p not in TWO_PHASE:
            raise ValueError(f"unknown primitive {p!r}")
        if p in TABLE_LEVEL:
            add(p)
            continue
        for c in cfg.value_columns:
            add(p, c)
        if p in VALUE_ANY_TYPE:
            for c in cfg.categorical_columns:
                if wc is not None and c == wc:
                    continue  # constant inside its own condition
                add(p, c, True)
    return out


def plan_features(es: EntitySet, config: FeatureConfig,
                  vocab: dict | None = None, layout: str = "wide") -> list[FeatureSpec]:
    """Expand the config into feature definitions (no feature is computed).

    Conditional features of the wide layout need the concept vocabulary: it is taken from
    ``where_values`` or ``vocab`` (keyed by table and column, or by the table alone for its first
    condition column) if given, else from one distinct job per child table and column.  The other
    layouts need none: one definition stands for every value.
    A table may have several ``ChildConfig``s.  Tables and columns that the set does not declare are
    an error, as are two definitions of one output name; declared columns that the load dropped
    (all null) give no features, as in the reference.
    """
    specs: list[FeatureSpec] = []
    present = {n: set(df.columns) for n, df in es.tables.items()}
    _check_names(es, config, present)
    tcols = present.get(config.target, set())
    for c in config.identity_columns:
        if c in tcols:
            specs.append(FeatureSpec(c, config.target, "identity", c, categorical=True))
    if config.age_column and config.age_column in tcols:
        specs.append(FeatureSpec(f"age__{config.age_column}", config.target, "age", config.age_column))
    first_column: dict[str, str] = {}
    for c in config.children:
        if c.where_column and c.where_primitives:
            first_column.setdefault(c.table, c.where_column)
    vocab = {(k, first_column.get(k)) if isinstance(k, str) else tuple(k): v for k, v in (vocab or {}).items()}
    wanted = list(dict.fromkeys(
        (c.table, c.where_column) for c in config.children if c.table in present and c.where_column in present[c.table]
        and c.where_primitives and c.where_values is None and (c.table, c.where_column) not in vocab)) if layout == "wide" else []
    found = {}
    if wanted:
        # one distinct job per child table and column, submitted together
        with ThreadPoolExecutor(max_workers=min(4, len(wanted))) as pool:
            found = dict(zip(wanted, pool.map(lambda x: distinct_values(es[x[0]], x[1]), wanted)))
    for child in config.children:
        if child.table not in present:
            continue
        have = present[child.table]
        child = replace(child, value_columns=tuple(c for c in child.value_columns if c in have),
                        categorical_columns=tuple(c for c in child.categorical_columns if c in have))
        specs += _child_specs(child, child.primitives)
        if child.where_column in have and child.where_primitives:
            values = child.where_values
            if values is None:
                at = (child.table, child.where_column)
                values = vocab.get(at, found.get(at))
            # a further condition column of a table is named, so that equal values don't clash
            by_column = first_column[child.table] != child.where_column
            if values is None:
                specs += _child_specs(child, child.where_primitives, each=True, by_column=by_column)
            for v in values or ():
                specs += _child_specs(child, child.where_primitives, v, by_column=by_column)
    specs = list(dict.fromkeys(specs))
    names: dict[str, FeatureSpec] = {}
    for d in specs:
        for name in _columns(d, d.name):
            other = names.setdefault(name.lower(), d)  # Spark's column names ignore case
            if other is not d:
                raise ValueError(f"{other.display} and {d.display} are both named {name}")
    return specs


def _check_names(es: EntitySet, config: FeatureConfig, present: dict[str, set]) -> None:
    """Refuse tables and columns that the table set neither holds nor declares."""
    def known(table: str) -> set:
        return present.get(table, set()) | ({*es.spec(table).column_names(), RECODED} if table in es.specs else set())

    for table in [config.target, *[c.table for c in config.children]]:
        if table not in present and table not in es.specs:
            raise ValueError(f"the table set has no table {table!r}")
    wanted = [(config.target, c) for c in (*config.identity_columns, config.age_column) if c]
    wanted += [(c.table, x) for c in config.children for x in (*c.value_columns, *c.categorical_columns, c.where_column) if x]
    for table, column in wanted:
        if column not in known(table):
            raise ValueError(f"table {table!r} has no column {column!r}")


# ---- S7/S8: definitions to and from JSON ----------------------------------

def defs_to_json(defs: list[FeatureSpec], config: FeatureConfig | None = None) -> str:
    body = {"features": [asdict(d) for d in defs]}
    if config is not None:
        body["config"] = asdict(config)
    return json.dumps(body, default=str, sort_keys=True)


def defs_from_json(text: str) -> tuple[list[FeatureSpec], FeatureConfig | None]:
    body = json.loads(text)
    defs = [FeatureSpec(**d) for d in body["features"]]
    cfg = None
    if "config" in body:
        c = body["config"]
        children = tuple(ChildConfig(**{k: (tuple(v) if isinstance(v, list) else v)
                                        for k, v in ch.items()}) for ch in c["children"])
        cfg = FeatureConfig(c["target"], children, tuple(c["identity_columns"]),
                            c["age_column"], c["label_table"])
    return defs, cfg


# ---- evaluation ------------------------------------------------------------

@dataclass
class FeatureResult:
    matrix: DataFrame
    defs: list[FeatureSpec]
    long: dict[str, DataFrame] = field(default_factory=dict)
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)  # of the sparse layout's vector columns
    categories: dict[str, list] = field(default_factory=dict)


def _agg_columns(defs: list[FeatureSpec], spec: S.TableSpec, cutoff) -> list:
    cols = []
    for d in defs:
        value = d.column if d.primitive not in TABLE_LEVEL else None
        cols.append(primitive(d.primitive, value, spec.time_index, spec.key, cutoff).alias(d.name))
    return cols


def _long_stat_name(d: FeatureSpec) -> str:
    return feature_name(d.table, d.primitive, d.column)


def _wanted(wc: str, cond: list[FeatureSpec]):
    """The codes that the conditional features are about."""
    values = {d.where_value for d in cond}
    return F.col(wc).isNotNull() if None in values else F.col(wc).isin(sorted(values))


def _wanted_by_stat(wc: str, cond: list[FeatureSpec]) -> dict[str, object]:
    """Condition per statistic, for those that are not asked for every code of ``cond``."""
    every = {d.where_value for d in cond}
    values: dict[str, set] = {}
    for d in cond:
        values.setdefault(_long_stat_name(d), set()).add(d.where_value)
    return {n: F.col(wc).isin(sorted(v)) for n, v in values.items() if None not in v and v != every}


def _masked(long: DataFrame, wc: str, cond: list[FeatureSpec]) -> DataFrame:
    """Statistics that are not asked for a row's code as null."""
    masks = _wanted_by_stat(wc, cond)
    stats = {_long_stat_name(d): d for d in cond}
    return long.withColumns({c: F.when(m, F.col(c)) for n, m in masks.items() for c in _columns(stats[n], n)}) if masks else long


def _distribution(rows: DataFrame, group: list[str], d: FeatureSpec, out: str) -> DataFrame:
    """A distribution primitive per group: ``out``, or ``out__0``, ``out__1``, ... of n_most_common."""
    if d.primitive == "entropy":
        return entropy(rows, group, d.column, out=out)
    if d.primitive == "median":
        return grouped_median(rows, group, d.column, out=out)
    if d.primitive == "mode":
        return grouped_mode(rows, group, d.column, out=out)
    top = n_most_common(rows, group, d.column, n=d.n, out="__top")
    return top.select(*group, *[F.get(F.col("__top"), i).alias(f"{out}__{i}") for i in range(d.n)])


def _columns(d: FeatureSpec, name: str) -> list[str]:
    return [f"{name}__{i}" for i in range(d.n)] if d.primitive == "n_most_common" else [name]


def _single_scan(rows: DataFrame, group: list[str], wc: str, plain: list[FeatureSpec],
                 cond: list[FeatureSpec], spec: S.TableSpec, cut, layout: str,
                 map_col: str) -> DataFrame:
    """Per-person and per-(person, code) statistics from one scan.

    ``GROUPING SETS ((person), (person, code))`` expands each row twice in
    memory and aggregates both sets in one partial/final aggregation, so the
    child table is read and shuffled once.  The per-person row (grouping id
    1) then rides along as an extra pivot value (wide) or next to the code
    map (map) in a single ``groupBy(person)`` over the small aggregated rows.
    """
    stats: dict[str, FeatureSpec] = {d.name: d for d in plain}
    cond_stats: list[str] = []
    for d in cond:
        n = _long_stat_name(d)
        if n not in cond_stats:
            cond_stats.append(n)
        stats.setdefault(n, replace(d, name=n, where_column=None, where_value=None))
    agg = (rows.groupingSets([group, group + [wc]], *group, wc)
           .agg(*_agg_columns(list(stats.values()), spec, cut), F.grouping_id().alias("__gid")))
    is_all = F.col("__gid") == 1
    if layout == "map":
        agg = _masked(agg, wc, cond)
        entry = F.struct(F.col(wc).alias("key"),
                         F.struct(*[F.col(s) for s in cond_stats]).alias("value"))
        entries = F.collect_list(F.when(~is_all & _wanted(wc, cond), entry))
        # no coded rows -> null (as for persons the long form has no row for)
        aggs = [F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias(map_col)]
        aggs += [F.first(F.when(is_all, F.col(d.name)), ignorenulls=True).alias(d.name) for d in plain]
        return agg.groupBy(*group).agg(*aggs)
    # the person's own row is place 0, its codes are places in the typed value list
    values = sorted({d.where_value for d in cond})
    place = F.when(is_all, F.lit(0)).otherwise(value_place(agg, wc, values))
    keyed = agg.select(*group, place.cast("int").alias("__pv"), *[F.col(s) for s in stats]).where("__pv IS NOT NULL")
    cells = [(0, d.name, d.name) for d in plain]
    cells += [(1 + values.index(d.where_value), _long_stat_name(d), d.name) for d in cond]
    return pivot_rows(keyed, group, "__pv", cells)


def feature_matrix(es: EntitySet, config: FeatureConfig, cutoff, *,
                   defs: list[FeatureSpec] | None = None, layout: str = "wide",
                   encode: bool = False, top_n: int = 10, label: bool = True,
                   categories: dict[str, list] | None = None, many_cutoffs: bool = False) -> FeatureResult:
    """One row per target person, a column per feature definition.

    ``cutoff``: a time literal for everyone, or a DataFrame with columns
    ``person_id``/``cutoff_time`` (per-person cutoffs; only those persons are
    returned).  With ``many_cutoffs`` a person may have several: the matrix has a row for each, told
    apart by ``cutoff_time``; without it a repeated person is an error.  ``layout``: ``wide`` pivots conditional features into columns,
    ``map`` keeps them in one ``map<concept, struct>`` column per table (bounded by a person's codes),
    ``sparse`` in one vector column per table with its index in ``result.dictionaries`` (numeric
    statistics, any number of codes), ``long`` returns them in ``result.long[table]``.
    """
    if layout not in ("wide", "map", "long", "sparse"):
        raise ValueError(layout)
    if defs is None:
        defs = plan_features(es, config, layout=layout)
    if layout == "wide" and any(d.where_column is not None and d.where_value is None for d in defs):
        raise ValueError("the definitions are for every value; the wide layout needs the values")
    tspec = es.spec(config.target)
    key = tspec.key
    per_person = is_per_person(cutoff)
    small = None
    if per_person:
        # one bounded count decides broadcast vs. salted join for every table
        small = cutoff_is_small(cutoff.select("person_id"))
        cutoff = cutoff.select("person_id", F.col("cutoff_time").cast("timestamp_ntz").alias("cutoff_time"))
        if many_cutoffs:
            cutoff = cutoff.distinct()
        elif not cutoff.groupBy("person_id").count().where("count > 1").isEmpty():
            raise ValueError("a person has several cutoffs: pass many_cutoffs=True")
    elif many_cutoffs:
        raise ValueError("many_cutoffs takes a table of cutoffs")
    extra = [CUTOFF_COL] if many_cutoffs else []

    # target rows, identity features and age
    target, tcut = attach_cutoff(es[config.target], cutoff, key, small=small, row_key=key)
    tcols = [F.col(key), *map(F.col, extra)]
    for d in defs:
        if d.table != config.target:
            continue
        if d.primitive == "identity":
            tcols.append(F.col(d.column).alias(d.name))
        elif d.primitive == "age":
            tcols.append(age_years(d.column, tcut).alias(d.name))
    base = target.select(*tcols)

    def finished(part: DataFrame, pk: str) -> DataFrame:
        """A child's result under the matrix's keys."""
        if per_person and not many_cutoffs:
            part = part.drop(CUTOFF_COL)
        return part.withColumnRenamed(pk, key) if pk != key else part

    parts, defaults, longs, dictionaries = [], {}, {}, {}
    for table in dict.fromkeys(c.table for c in config.children):
        cdefs = [d for d in defs if d.table == table]
        if not cdefs:
            continue
        spec = es.spec(table)
        pk = spec.person_key
        rows, cut = attach_cutoff(es[table], cutoff, pk, small=small, row_key=spec.key)
        rows = visible_rows(rows, spec.time_index, cut, spec.secondary)
        group = [pk] + ([CUTOFF_COL] if per_person else [])

        two = [d for d in cdefs if d.where_column is None and d.primitive in TWO_PHASE]
        for d in two:
            parts.append(finished(_distribution(rows, group, d, d.name), pk))

        plain = [d for d in cdefs if d.where_column is None and d.primitive not in TWO_PHASE]
        every = [d for d in cdefs if d.where_column is not None]
        for d in plain + (every if layout == "wide" else []):
            if d.primitive not in TWO_PHASE and default_for(d.primitive) is not None:
                defaults[d.name] = default_for(d.primitive)

        if many_cutoffs and spec.time_index and not spec.secondary:
            # one pass over the child: merged states instead of rows repeated for each cutoff
            once = [d for d in plain if d.primitive in MERGEABLE]
            if once:
                parts.append(finished(asof_aggregates(
                    es[table], cutoff, pk, spec.time_index, spec.key,
                    [(d.primitive, d.column if d.primitive not in TABLE_LEVEL else None, d.name) for d in once], small), pk))
                plain = [d for d in plain if d not in once]

        where_columns = list(dict.fromkeys(d.where_column for d in every))
        for wc in where_columns or [None]:
            cond = [d for d in every if d.where_column == wc]
            ordered = any(d.primitive in ORDERED | TWO_PHASE for d in plain + cond)
            if cond and layout in ("wide", "map") and not ordered:
                # one scan of the child for both the per-person and the per-code
                # statistics (grouping sets), folded per person in one more step
                part = _single_scan(rows, group, wc, plain, cond, spec, cut, layout,
                                    f"{table}__where_{wc}")
                parts.append(finished(part, pk))
                plain = []
                continue

            # ordered primitives (last/first) need sort-based aggregation; there
            # two separate aggregations beat one over grouping-set-expanded rows
            if plain:
                agg = rows.groupBy(*group).agg(*_agg_columns(plain, spec, cut))
                parts.append(finished(agg, pk))
                plain = []
            if cond:
                # one statistic per (primitive, column); codes become rows
                stat_defs = {}
                for d in cond:
                    stat_defs.setdefault(_long_stat_name(d), replace(d, name=_long_stat_name(d),
                                                                     where_column=None, where_value=None))
                coded = rows.where(_wanted(wc, cond))
                single = [d for d in stat_defs.values() if d.primitive not in TWO_PHASE]
                long = (conditional_long(coded, group, wc, _agg_columns(single, spec, cut)) if single
                        else coded.select(*group, wc).distinct())
                for d in stat_defs.values():
                    if d.primitive in TWO_PHASE:
                        long = long.join(_distribution(coded, [*group, wc], d, d.name), [*group, wc], "left")
                long = _masked(finished(long, pk), wc, cond)
                if layout == "wide":
                    cells = [(d.where_value, src, out) for d in sorted(cond, key=lambda d: d.where_value)
                             for src, out in zip(_columns(d, _long_stat_name(d)), _columns(d, d.name))]
                    wide = pivot_rows(long, [key, *extra], wc, cells)
                    parts.append(wide.select(key, *extra, *[c for d in cond for c in _columns(d, d.name)]))
                elif layout == "map":
                    parts.append(long_to_map(long, [key, *extra], wc,
                                             [c for n, d in stat_defs.items() for c in _columns(d, n)],
                                             map_col=f"{table}__where_{wc}"))
                elif layout == "sparse":
                    out = f"{table}__where_{wc}"
                    stats = [c for n, d in stat_defs.items() for c in _columns(d, n)]
                    long = written(long, "feature-rows")  # read by the dictionary and by the vectors
                    dictionaries[out] = feature_dictionary(long, wc, stats)
                    parts.append(to_sparse(long, [key, *extra], wc, stats, dictionaries[out], out))
                else:
                    longs[table if len(where_columns) == 1 else f"{table}__where_{wc}"] = long

    matrix = assemble(base, [key, *extra], parts, defaults)
    cats = {}
    if encode:
        enc = [d for d in defs if d.categorical and d.name in matrix.columns]
        missing = [d for d in enc if d.name not in (categories or {})]
        if any(d.table != config.target for d in missing):
            # a category computed from a child (e.g. the last code) would re-run
            # that child's aggregation in every frequency job: write the matrix
            # once (shared folder, columnar) and read the frequencies from it
            matrix = written(matrix, "feature-matrix")
        matrix, cats = one_hot(matrix, [d.name for d in enc], top_n=top_n, values=categories)
    if label and config.label_table and config.label_table in es:
        matrix = attach_label(matrix, es[config.label_table], key)
    if many_cutoffs:
        matrix = matrix.withColumnRenamed(CUTOFF_COL, "cutoff_time")
        longs = {t: df.withColumnRenamed(CUTOFF_COL, "cutoff_time") for t, df in longs.items()}
    return FeatureResult(matrix, defs, longs, dictionaries, cats)


def gen_feature_matrix(es: EntitySet, cutoff, features_only: bool = False,
                       feature_matrix_encode: bool = False, saved_features: str | None = None,
                       config: FeatureConfig = REFERENCE_CONFIG, layout: str = "wide",
                       top_n: int = 10):
    """The reference's entry point on Spark: ``(matrix, defs)``, or only ``defs``.

    ``saved_features`` is a definitions folder written by ``save_defs``; its
    stored configuration replaces ``config``.  The label is attached (right
    join) when the set holds the config's label table.  ``cutoff`` is
    required: the run's clock is never used implicitly.
    """
    if saved_features is not None:
        from ..sources.featuredefs import load_defs
        spark = next(iter(es.tables.values())).sparkSession
        defs, saved_config = load_defs(spark, saved_features)
        config = saved_config or config
    else:
        defs = plan_features(es, config, layout=layout)
        if features_only:
            return defs
    res = feature_matrix(es, config, cutoff, defs=defs, layout=layout,
                         encode=feature_matrix_encode, top_n=top_n)
    return res.matrix, defs
