"""At-risk filter against the same positions in Python."""

import hashlib

from cohortlens.operators.riskfilter import BUCKET_BITS, build_filter, filter_bits, merge_filters, probe_filter

SALT = "s:"


def positions(key, n_bits, hashes=4):
    h = hashlib.sha256((SALT + str(key)).encode()).hexdigest()
    return [int(h[12 * i:12 * i + 12], 16) % n_bits for i in range(hashes)]


def test_flags_match_the_bits(spark):
    keys = [f"k{i}" for i in range(9000)]
    n_bits = filter_bits(3000)
    assert n_bits == BUCKET_BITS and filter_bits(3300) == 2 * BUCKET_BITS and filter_bits(0) == BUCKET_BITS
    reported, n_bits = keys[:3000], 2 * n_bits
    df = spark.createDataFrame([(k,) for k in [*keys, "k5", None]], "key string")
    bits = build_filter(spark.createDataFrame([(k,) for k in [*reported, "k1", None]], "key string"), "key", n_bits, SALT)
    stored = {int(r.bucket): r.bits for r in bits.collect()}
    want = {p for k in reported for p in positions(k, n_bits)}
    assert {(b - 1) * BUCKET_BITS + i for b, x in stored.items() for i in range(8 * len(x)) if x[i // 8] >> i % 8 & 1} == want
    got = {r.key: r.flagged for r in probe_filter(df, "key", bits, n_bits, SALT).collect()}
    assert got == {k: set(positions(k, n_bits)) <= want for k in keys}
    assert all(got[k] for k in reported) and 0 < sum(got[k] for k in keys[3000:]) < 120


def test_filters_merge_and_may_be_empty(spark):
    def filter_of(keys):
        return build_filter(spark.createDataFrame([(k,) for k in keys], "key long"), "key", BUCKET_BITS, SALT, 5)

    both = merge_filters(filter_of(range(50)), filter_of(range(40, 100)))
    probe = spark.createDataFrame([(k,) for k in range(200)], "key long")
    flags = {r.key: r.flagged for r in probe_filter(probe, "key", both, BUCKET_BITS, SALT, 5).collect()}
    assert all(flags[k] for k in range(100)) and sum(flags.values()) < 105 and len(flags) == 200
    assert not any(r.flagged for r in probe_filter(probe, "key", filter_of([]), BUCKET_BITS, SALT, 5).collect())
    assert "PythonUDF" not in both._jdf.queryExecution().toString()
