import fnmatch
import gzip
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import at

from sensorframe.sources import arrays
from sensorframe.sources.arrays import read_arrays

EPOCH_1900 = 3_913_056_000  # seconds from 1900-01-01 to 2024-01-01


def pack(kind, raw):
    if kind == "zlib":
        return zlib.compress(raw)
    if kind == "gzip":
        return gzip.compress(raw)
    if kind == "zstd":
        return pa.Codec("zstd").compress(raw).to_pybytes()
    if kind == "lz4":
        return len(raw).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(raw).to_pybytes()
    return raw


def write_array(root, name, values, chunks, dims, kind=None, skip=(), fill=None, order="C", **attrs):
    folder = root / name
    folder.mkdir(parents=True)
    meta = {
        "shape": values.shape,
        "chunks": chunks,
        "dtype": values.dtype.str,
        "compressor": {"id": kind} if kind else None,
        "fill_value": fill,
        "order": order,
        "filters": None,
        "zarr_format": 2,
    }
    (folder / ".zarray").write_text(json.dumps(meta))
    (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **attrs}))
    counts = [-(-s // c) for s, c in zip(values.shape, chunks)]
    for index in np.ndindex(*counts):
        if index in skip:
            continue
        block = np.zeros(chunks, dtype=values.dtype)
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        (folder / ".".join(map(str, index))).write_bytes(pack(kind, block.tobytes(order)))


@pytest.mark.parametrize("kind", [None, "zlib", "gzip", "zstd", "lz4"])
def test_group(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(arrays, "BLOCK_ROWS", 7)
    n = 50
    time = EPOCH_1900 + np.arange(n, dtype="f8") / 2
    temperature = np.where(np.arange(n) % 9 == 0, np.nan, np.arange(n) * 1.5)
    count = np.arange(n, dtype=">i4") * 3
    spectra = np.arange(n * 5, dtype="f4").reshape(n, 5)
    write_array(tmp_path, "time", time, (16,), ["time"], kind, units="seconds since 1900-01-01 00:00:00")
    write_array(tmp_path, "temperature", temperature, (11,), ["time"], kind)
    write_array(tmp_path, "count", count, (50,), ["time"], kind, skip={(0,)} if kind is None else (), fill=-1)
    write_array(tmp_path, "spectra", spectra, (13, 2), ["time", "wavelength"], kind, order="F")
    write_array(tmp_path, "wavelength", np.arange(5.0), (5,), ["wavelength"], kind)

    df = read_arrays(spark, str(tmp_path))
    assert set(df.columns) == {"_pos", "time", "temperature", "count", "spectra"}
    rows = sorted(df.collect(), key=lambda r: r["_pos"])
    assert [r["_pos"] for r in rows] == list(range(n))
    assert [r["time"] for r in rows] == [at(i / 2) for i in range(n)]
    assert [r["temperature"] for r in rows] == [None if i % 9 == 0 else i * 1.5 for i in range(n)]
    assert [r["count"] for r in rows] == [-1 if kind is None else i * 3 for i in range(n)]
    assert dict(df.dtypes)["count"] == "bigint"
    assert [r["spectra"] for r in rows] == spectra.astype(float).tolist()


def test_missing_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK_ROWS", 4)
    write_array(tmp_path, "time", EPOCH_1900 + np.arange(10.0), (5,), ["time"])
    write_array(tmp_path, "v", np.arange(10.0), (3,), ["time"], skip={(1,)}, fill=None)
    rows = sorted(read_arrays(spark, str(tmp_path)).collect(), key=lambda r: r["_pos"])
    assert [r["v"] for r in rows] == [0, 1, 2, None, None, None, 6, 7, 8, 9]


def test_refusals(spark, tmp_path):
    write_array(tmp_path / "a", "time", np.arange(3.0), (3,), ["time"], "blosc")
    with pytest.raises(ValueError, match="compressor 'blosc' is not supported"):
        read_arrays(spark, str(tmp_path / "a"))
    write_array(tmp_path / "b", "v", np.arange(3.0), (3,), ["time"])
    with pytest.raises(ValueError, match="no 'time' variable"):
        read_arrays(spark, str(tmp_path / "b"))
    write_array(tmp_path / "c", "time", np.arange(3.0), (3,), ["time"], calendar="noleap")
    with pytest.raises(ValueError, match="calendar"):
        read_arrays(spark, str(tmp_path / "c"))


def test_types_and_coordinates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "BLOCK_ROWS", 4)
    n = 6
    write_array(tmp_path, "time", EPOCH_1900 + np.arange(n, dtype="i8"), (4,), ["time"])
    write_array(tmp_path, "big", np.arange(n, dtype="i8") + 2**60, (4,), ["time"], skip={(1,)})
    write_array(tmp_path, "flag", np.array(["ok", "no", "é", "a", "b", "c"]), (3,), ["time"])
    write_array(tmp_path, "spectra", np.arange(n * 5.0).reshape(n, 5), (4, 2), ["time", "wavelength"])
    write_array(tmp_path, "wavelength", np.arange(400, 450, 10), (2,), ["wavelength"])
    write_array(tmp_path, "label", np.array([b"x", b"y", b"z", b"u", b"v"]), (5,), ["wavelength"])
    rows = sorted(read_arrays(spark, str(tmp_path), {"wavelength": (405, 430)}).collect(), key=lambda r: r["_pos"])
    assert [r["time"] for r in rows] == [at(i) for i in range(n)]
    assert [r["big"] for r in rows] == [*(2**60 + i for i in range(4)), None, None]
    assert [r["flag"] for r in rows] == ["ok", "no", "é", "a", "b", "c"]
    assert [r["spectra"] for r in rows] == [[5.0 * i + 1, 5.0 * i + 2, 5.0 * i + 3] for i in range(n)]
    found = arrays.read_coordinates(spark, str(tmp_path)).collect()
    assert {(r.variable, r.dimension, r["index"], r.value, r.text) for r in found} == {
        *(("wavelength", "wavelength", i, 400.0 + 10 * i, None) for i in range(5)),
        *(("label", "wavelength", i, None, t) for i, t in enumerate("xyzuv")),
    }
    with pytest.raises(ValueError, match="no coordinates"):
        read_arrays(spark, str(tmp_path), {"depth": (0, 1)})


@pytest.mark.parametrize("first,last", [(0, 0), (0, 9), (7, 23), (37, 152), (95, 1204), (100, 100), (999, 1000), (0, 1500)])
def test_number_glob(first, last):
    pattern = arrays.number_glob(first, last)
    assert [i for i in range(2000) if any(fnmatch.fnmatchcase(str(i), p) for p in pattern[1:-1].split(","))] == list(
        range(first, last + 1)
    )
    assert len(pattern) < 150


@pytest.mark.parametrize("order", ["C", "F"])
def test_cuts_open_only_their_chunks(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(arrays, "BLOCK_ROWS", 7)
    n, width = 60, 30
    spectra = np.arange(n * width, dtype="f8").reshape(n, width)
    write_array(tmp_path, "time", EPOCH_1900 + np.arange(n, dtype="f8"), (5,), ["time"], "zlib")
    write_array(tmp_path, "v", np.arange(n, dtype="i4"), (11,), ["time"], "zlib")
    write_array(tmp_path, "spectra", spectra, (4, 2), ["time", "wavelength"], "zlib", skip={(6, 5)}, fill=-1.0, order=order)
    write_array(tmp_path, "wavelength", np.arange(400.0, 430), (10,), ["wavelength"], "zlib")
    ranges = {"time": ("2024-01-01 00:00:17", "2024-01-01 00:00:33"), "wavelength": (406.5, 413)}
    df = read_arrays(spark, str(tmp_path), ranges)
    opened = {"/".join(f.rsplit("/", 2)[1:]) for f in df.inputFiles()}
    assert opened == {
        *(f"time/{i}" for i in range(3, 7)),
        *(f"v/{i}" for i in range(1, 4)),
        *(f"spectra/{i}.{j}" for i in range(4, 9) for j in range(3, 7) if (i, j) != (6, 5)),
    }
    spectra[24:28, 10:12] = -1
    rows = sorted(df.collect(), key=lambda r: r["_pos"])
    assert [(r["_pos"], r["time"], r["v"]) for r in rows] == [(i, at(i), i) for i in range(17, 34)]
    assert [r["spectra"] for r in rows] == spectra[17:34, 7:14].tolist()

    late = sorted(read_arrays(spark, str(tmp_path), {"time": ("2024-01-01 00:00:58", None)}).collect())
    assert [r["_pos"] for r in late] == [58, 59] and late[0]["spectra"] == spectra[58].tolist()
    assert read_arrays(spark, str(tmp_path), {"time": (None, "2023-01-01")}).count() == 0
    none = read_arrays(spark, str(tmp_path), {"wavelength": (500, 600)}).collect()
    assert len(none) == n and all(r["spectra"] == [] and r["v"] == r["_pos"] for r in none)
