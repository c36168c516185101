"""Quality rules as a bitmask ledger, in DataFrame expressions alone.

``ledger`` measures every text once and stores one bit per failed rule next to the
measurements.  ``apply_policy`` then keeps or rejects by a versioned mask, and
``ablation`` counts from the bits what each rule rejects alone, without reading a
text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The contract's word and symbol classes.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: (name, SQL condition on the measurements that means failure); the place is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("exclamations", "100 * n_exclaim > 20 * n_words"),
    ("many_digits", "100 * n_digits > 50 * word_chars"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits")


def mask(*names: str) -> int:
    """The bits of the named rules; all if none is named."""
    known = [n for n, _ in RULES]
    return sum(1 << known.index(n) for n in (names or known))


@dataclass(frozen=True)
class Policy:
    """A version and the rules (as bits) that reject under it."""

    version: str
    bits: int


BASE = Policy("base", mask("few_words", "repeated_windows"))
POLICY = Policy("v1", mask())


def _count_of(chars: str, text: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def measured(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns of ``docs`` plus MEASURES (long).  Null text counts as empty: all
    measurements are 0.  Raises if a measurement's name is taken."""
    if taken := sorted(set(docs.columns) & {*MEASURES, "_text", "_w", "_h", "_s", "_p", "rule_bits"}):
        raise ValueError(f"columns are there already: {taken}")
    keep = docs.columns
    q = lambda c: f"`{c}`"
    df = docs.withColumn("_text", F.coalesce(F.col(q(column)), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_text", WORD_GAP), ""))
    lines = F.expr(r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    df = df.select(
        *map(q, keep), F.col("_w"),
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS, "_text").cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        _count_of(UPPER, "_text").cast("long").alias("n_upper"),
        _count_of("!", "_text").cast("long").alias("n_exclaim"),
        _count_of("0123456789", "_text").cast("long").alias("n_digits"))
    at = ", ".join(f"get(_w, i + {j})" for j in range(WINDOW))
    # A window is told by the 64-bit hash of its words.
    df = df.withColumn("_h", F.expr(
        f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({at})) END"))
    df = df.select(
        "*", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # (hash, place) in order of the hash, only where some window repeats
        F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN "
               "sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END").alias("_s")).drop("_lines", "_h", "_w")
    # places of windows that are found twice or more
    df = df.withColumn("_p", F.expr(
        "sort_array(transform(filter(_s, (e, k) -> e.h <=> get(_s, k - 1).h OR e.h <=> get(_s, k + 1).h), e -> e.i))")).drop("_s")
    # words in their union: from each place to the next, at most a window's length
    covered = F.expr(f"aggregate(transform(_p, (x, k) -> least({WINDOW}, coalesce(get(_p, k + 1), x + {WINDOW}) - x)), "
                     "0L, (a, x) -> a + x)")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    return df.select(*map(q, keep), *MEASURES)


def ledger(docs: DataFrame, column: str = "text") -> DataFrame:
    """``measured`` plus ``rule_bits`` (long): bit i is set where RULES[i] fails."""
    bits = " + ".join(f"(CASE WHEN {cond} THEN {1 << i}L ELSE 0L END)" for i, (_, cond) in enumerate(RULES))
    # The row number's sign bit is 0.  As it is not deterministic, a filter on the bits is not
    # pushed below: Catalyst would copy the measurements' expressions into it, each into the next.
    return measured(docs, column).withColumn("rule_bits", F.expr(f"{bits} + shiftright(monotonically_increasing_id(), 63)"))


def apply_policy(led: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """Adds ``name``: no rule of the policy failed."""
    return led.withColumn(name, F.col("rule_bits").bitwiseAND(F.lit(policy.bits)) == 0)


def ablation(led: DataFrame, policies: list[Policy], by: list[str] | None = None) -> DataFrame:
    """Per policy and rule (and ``by``): documents, rejected in all, failing the rule, and
    rejected by the rule alone (kept if the rule were dropped).

    The texts are reduced to counts per distinct bit pattern first (at most 2**rules per
    group, summed on the map side), so a hot group costs one row per task and pattern."""
    by = by or []
    counts = led.groupBy(*by, "rule_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.bits).alias("bits"), F.lit(name).alias("rule"),
                               F.lit(1 << i).alias("bit"))
                      for p in policies for i, (name, _) in enumerate(RULES) if p.bits >> i & 1])
    failed = F.col("rule_bits").bitwiseAND(F.col("r.bits"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (counts.select("*", F.explode(rules).alias("r")).groupBy(*by, "r.policy", "r.rule")
            .agg(F.sum("n").alias("n_docs"), total(failed != 0).alias("n_rejected"),
                 total(failed.bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
                 total(failed == F.col("r.bit")).alias("n_alone"),
                 F.bit_or(failed).alias("any_bits"), F.bit_and(failed).alias("all_bits")))


def judged(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """doc_id, the five contract measurements, base_failed, kept, rule_bits."""
    led = apply_policy(ledger(docs.select("doc_id", "text")), BASE, "base_kept")
    return apply_policy(led, policy, "_kept").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("_kept")).alias("kept"), "rule_bits")


def judged_sql() -> str:
    """DuckDB SQL for ``judged``."""
    bits = " + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, (_, cond) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i,
               unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS s
        FROM d WHERE len(w) >= {WINDOW}),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range({WINDOW}) r(j) GROUP BY 1),
lin AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             length(t) - length(translate(t, '{UPPER}', '')) AS n_upper,
             length(t) - length(replace(t, '!', '')) AS n_exclaim,
             length(t) - length(translate(t, '0123456789', '')) AS n_digits
      FROM d JOIN lin USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ({bits})::BIGINT AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (rule_bits & {BASE.bits}) <> 0 AS base_failed, (rule_bits & {BASE.bits | POLICY.bits}) = 0 AS kept, rule_bits
FROM b"""
