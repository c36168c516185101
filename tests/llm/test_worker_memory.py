import glob

import public_tokenizers as P
import pyarrow as pa
import pytest

from cohortlens.llm import byte_bpe, shared, token_rollup

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


# -- 3 token counts ---------------------------------------------------------------

def test_counting_tokens_builds_no_encoder():
    byte_bpe.encoder.cache_clear()
    token_rollup._tiktoken.cache_clear()
    assert token_rollup._tiktoken(MULTI, P.PATTERN).encode_ordinary("ab")
    assert byte_bpe.encoder.cache_info().currsize == 0


def test_a_worker_gives_memory_back_when_its_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(shared.giving_back(lambda b: b)(iter([batch, batch]))) == [batch, batch]
    assert calls == [1]

    def broken(batches):
        yield next(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(shared.giving_back(broken)(iter([batch])))
    assert calls == [1, 1]


def test_small_tables_are_written_in_few_files(spark):
    n = spark.sparkContext.defaultParallelism
    got = shared.written(spark.range(500).repartition(5 * n), "few", few=True)
    assert got.count() == 500
    assert len({f for f in got.inputFiles() if glob.glob(f.removeprefix("file://"))}) <= n
