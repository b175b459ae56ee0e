"""Tensor files, written by hand and by the writer."""

import json
import struct

import numpy as np
import pytest

from graftwork.sources import safetensors as S


def _file(path, tensors, metadata=None):
    header, data = ({"__metadata__": metadata} if metadata else {}), b""
    for name, (kind, shape, raw) in tensors.items():
        header[name] = {"dtype": kind, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(header).encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)


def _parse(path):
    raw = path.read_bytes()
    n = struct.unpack("<Q", raw[:8])[0]
    header = json.loads(raw[8 : 8 + n])
    return {k: (v["dtype"], v["shape"], raw[8 + n + v["data_offsets"][0] : 8 + n + v["data_offsets"][1]]) for k, v in header.items()}


def _tensors(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.model, r.tensor, tuple(r["shape"])), {})[r.block_no] = r["values_"]
    assert all(sorted(v) == list(range(len(v))) for v in out.values())
    return {k: np.concatenate([v[i] for i in range(len(v))]) for k, v in out.items()}


def test_all_types(spark, tmp_path):
    values = np.array([0.0, 1.0, -2.5, 3.0], "f4")
    raw = {
        "F64": values.astype("<f8"), "F32": values, "F16": values.astype("<f2"), "BF16": (values.view("<u4") >> 16).astype("<u2"),
        "I64": np.arange(4, dtype="<i8"), "I32": np.arange(4, dtype="<i4"), "I16": np.arange(4, dtype="<i2"),
        "I8": np.arange(4, dtype="i1"), "U8": np.arange(4, dtype="u1"), "BOOL": np.array([0, 1, 0, 1], "u1"),
    }
    _file(tmp_path / "a b/x.safetensors", {k: (k, [2, 2], v.tobytes()) for k, v in raw.items()} | {"one": ("F32", [], values[1:2].tobytes()), "none": ("F32", [0, 3], b"")}, {"format": "pt"})
    got = _tensors(S.read_safetensors(spark, {"m": f"{tmp_path}/a b/x.safetensors"}, block=3))
    for k, v in raw.items():
        want = v.astype("f4") if k != "BF16" else values
        assert np.array_equal(got["m", k, (2, 2)], want)
    assert got["m", "one", ()].tolist() == [1.0] and len(got) == len(raw) + 1


def test_large_tensors_are_split_and_small_ones_share_a_task(spark, tmp_path):
    big = np.arange(10_000, dtype="<f4")
    _file(tmp_path / "x.safetensors", {"big": ("F32", [100, 100], big.tobytes())} | {f"s{k}": ("F32", [5], big[:5].tobytes()) for k in range(100)})
    df = S.read_safetensors(spark, {"m": str(tmp_path / "x.safetensors")}, block=256, range_bytes=8192)
    assert 5 <= df.rdd.getNumPartitions() <= 8
    got = _tensors(df)
    assert np.array_equal(got["m", "big", (100, 100)], big) and len(got) == 101


@pytest.mark.parametrize("raw", [b"", b"1234", struct.pack("<Q", 50) + b"{}", struct.pack("<Q", 4) + b"nope", struct.pack("<Q", 2**60)])
def test_broken_files_fail(spark, tmp_path, raw):
    (tmp_path / "x.safetensors").write_bytes(raw)
    with pytest.raises(Exception, match="no tensor header"):
        S.read_safetensors(spark, {"m": str(tmp_path / "x.safetensors")}).collect()


def test_headers_that_lie_fail(spark, tmp_path):
    for kind, shape, raw, said in (("F32", [3], b"1234", "do not fit"), ("F99", [1], b"1", "not known")):
        _file(tmp_path / "x.safetensors", {"t": (kind, shape, raw)})
        with pytest.raises(Exception, match=said):
            S.read_safetensors(spark, {"m": str(tmp_path / "x.safetensors")}).collect()
    with pytest.raises(Exception, match="none.safetensors"):
        S.read_safetensors(spark, {"m": str(tmp_path / "none.safetensors")}).collect()


@pytest.mark.parametrize("kind", S.WRITABLE)
def test_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    tensors = {m: {t: rng.normal(size=s).astype("f4") for t, s in (("q.lora_A", (3, 50)), ("q.lora_B", (40, 3)), ("b", (7,)))} for m in ("m0", "m1")}
    for m, own in tensors.items():
        _file(tmp_path / m / S.FILE, {t: ("F32", list(v.shape), v.tobytes()) for t, v in own.items()})
    read = S.read_adapters(spark, {m: str(tmp_path / m) for m in tensors}, block=32)
    files = S.write_safetensors(read.repartition(7), str(tmp_path / "out"), "model", kind).collect()
    assert {(r.model, r.file, r.tensors) for r in files} == {("m0", S.FILE, 3), ("m1", S.FILE, 3)}
    assert not list((tmp_path / "out").rglob(".*"))
    for m, own in tensors.items():
        back = _parse(tmp_path / "out" / m / S.FILE)
        for t, v in own.items():
            assert back[t][:2] == (kind, list(v.shape)) and back[t][2] == S.stored_bytes(v, kind)
    again = _tensors(S.read_adapters(spark, {m: str(tmp_path / "out" / m) for m in tensors}))
    tolerance = {"F32": 0, "F16": 1e-2, "BF16": 2e-2}[kind]
    assert all(np.allclose(again[m, t, v.shape], v.ravel(), atol=tolerance) for m, own in tensors.items() for t, v in own.items())


def test_halves_round_to_even():
    bits = np.array([0x3F808000, 0x3F818000, 0x3F808001, 0x7F800000, 0x7FC00000, 0x7F800001], "<u4").view("<f4")
    got = np.frombuffer(S.stored_bytes(bits, "BF16"), "<u2").tolist()
    assert got[:4] == [0x3F80, 0x3F82, 0x3F81, 0x7F80] and np.isnan(S.floats(S.stored_bytes(bits, "BF16"), "BF16")[4:]).all()


def test_shards(spark, tmp_path):
    rows = [("m", f"t{k}", 0, [float(k)] * 100, [100]) for k in range(10)] + [("m", "t99", b, [1.0] * 100, [300]) for b in range(3)]
    df = spark.createDataFrame(rows, "target string, tensor string, block_no bigint, values_ array<float>, shape array<bigint>")
    files = S.write_safetensors(df, str(tmp_path), name="model.safetensors", shard_bytes=1000).collect()
    names = sorted(r.file for r in files)
    assert len(names) == 5 and names[0] == "model-00001-of-00005.safetensors"
    got = _tensors(S.read_safetensors(spark, {"m": [f"{tmp_path}/m/{n}" for n in names]}))
    assert len(got) == 11 and len(got["m", "t99", (300,)]) == 300


@pytest.mark.parametrize(
    ("rows", "said"),
    [([("m", "t", 1, [1.0], [1])], "lacks block 0"), ([("m", "t", 0, [1.0], [2])], "does not fill"),
     ([("m", "a", 0, [1.0], [2]), ("m", "b", 0, [1.0], [1])], "does not fill"), ([("m", "t", 0, [1.0], None)], "no single shape"),
     ([("m", "t", 0, [1.0], [2]), ("m", "t", 1, [1.0], [3])], "no single shape")],
)
def test_incomplete_tensors_fail(spark, tmp_path, rows, said):
    df = spark.createDataFrame(rows, "target string, tensor string, block_no bigint, values_ array<float>, shape array<bigint>")
    with pytest.raises(Exception, match=said):
        S.write_safetensors(df, str(tmp_path))


def test_average_of_adapter_files(spark, tmp_path):
    for k in range(3):
        _file(tmp_path / f"a{k}" / S.FILE, {"x.lora_A.weight": ("F32", [2, 2], np.full(4, k, "<f4").tobytes())})
        (tmp_path / f"a{k}/adapter_config.json").write_text(json.dumps({"r": 2, "own": k}))
    S.average_adapter_files(spark, [str(tmp_path / f"a{k}") for k in range(3)], f"{tmp_path}/out/merged")
    back = _parse(tmp_path / "out/merged" / S.FILE)
    assert back["x.lora_A.weight"] == ("F32", [2, 2], np.ones(4, "<f4").tobytes())
    assert json.loads((tmp_path / "out/merged/adapter_config.json").read_text())["own"] == 0
    with pytest.raises(ValueError, match="at least 2"):
        S.average_adapter_files(spark, [str(tmp_path / "a0")], str(tmp_path / "o"))
