"""Tensor files read in ranges that are far smaller than a task."""

import numpy as np

from graftwork.sources import safetensors as S


def test_small_ranges_share_a_task(spark, tmp_path):
    values = {m: np.arange(64_000, dtype="f4") + k for k, m in enumerate(("m0", "m1"))}
    rows = [(m, "t", b, v[b * 64 : b * 64 + 64].tolist(), [1000, 64]) for m, v in values.items() for b in range(1000)]
    df = spark.createDataFrame(rows, "target string, tensor string, block_no bigint, values_ array<float>, shape array<bigint>")
    S.write_safetensors(df, str(tmp_path))
    back = S.read_safetensors(spark, {m: f"{tmp_path}/{m}/{S.FILE}" for m in values}, block=64, range_bytes=512)
    # A range a task would be 1,000 tasks, growing with the files.
    assert back.rdd.getNumPartitions() <= S.TASKS + len(values)
    got = {(r.model, r.block_no): r["values_"] for r in back.collect()}
    assert len(got) == 2000
    assert all(np.array_equal(got[m, b], v[b * 64 : b * 64 + 64]) for m, v in values.items() for b in range(1000))
