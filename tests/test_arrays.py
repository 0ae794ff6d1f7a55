"""Arrays as relations, and fitted parameters written and read back."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from metricloom.operators import curves
from metricloom.sources import arrays, sinks
from metricloom.sources.arrays import scan_arrays


def _rows(df):
    return {(r.name, r.row): list(r["values"]) for r in df.collect()}


def test_arrays_of_all_layouts_are_read(spark, tmp_path):
    draws = np.random.default_rng(1).normal(size=(500, 3))
    held = {"by rows": draws, "by columns": np.asfortranarray(draws), "cube": draws.reshape(50, 5, 6), "vector": draws[:, 0], "other order": draws.astype(">f8"), "whole": np.arange(7), "signs": np.array([True, False]), "none": np.empty((0, 3)), "narrow": np.empty((2, 0)), "point": np.array(2.5)}
    np.savez_compressed(tmp_path / "d.npz", **held)
    got = _rows(scan_arrays(spark, str(tmp_path / "d.npz")))
    want = {(k, i): v.reshape(len(v), -1)[i].astype(float).tolist() for k, v in held.items() if v.ndim and k not in ("none", "narrow") for i in range(len(v))}
    assert got == want | {("narrow", 0): [], ("narrow", 1): [], ("point", 0): [2.5]}


def test_files_blocks_and_types(spark, tmp_path, monkeypatch):
    whole = np.array([[2**62 + 1, -1], [0, 5]])
    for k in "ab":
        np.save(tmp_path / f"{k}.npy", whole)
    got = scan_arrays(spark, str(tmp_path), "bigint")
    assert got.select("file").distinct().count() == 2
    assert _rows(got) == {(k, i): whole[i].tolist() for k in "ab" for i in (0, 1)}
    with pytest.raises(PythonException):
        scan_arrays(spark, str(tmp_path), "int").collect()
    monkeypatch.setattr(arrays, "_BLOCK", 6)
    values = np.arange(50.0).reshape(25, 2)
    np.save(tmp_path / "long", values)
    with open(tmp_path / "long.npy", "rb") as f:
        parts = list(arrays.blocks(f, "long"))
    assert [at for at, _ in parts] == list(range(0, 25, 3))
    assert np.array_equal(np.concatenate([p for _, p in parts]), values)


def test_what_is_no_array_of_numbers_is_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", {"a": np.ones(3)}, allow_pickle=True)
    np.save(tmp_path / "s.npy", np.array(["a", "b"]))
    np.save(tmp_path / "t.npy", np.ones(100))
    (tmp_path / "t.npy").write_bytes((tmp_path / "t.npy").read_bytes()[:-8])
    (tmp_path / "x.npy").write_bytes(b"text")
    for name, why in {"o": "pickled", "s": "only numbers", "t": "ends before", "x": "not an array"}.items():
        with pytest.raises(PythonException, match=why):
            scan_arrays(spark, str(tmp_path / f"{name}.npy")).collect()


def test_curves_and_draws_are_read_back(spark, tmp_path):
    rows = [(s, f"m{m}", d, float(n), 0.5 * n ** -(0.2 + 0.01 * m) + 0.001 * ((7 * d + n) % 5)) for s in ("random", "scaffold") for m in range(7) for d in range(3) for n in (1, 2, 4, 8, 16)]
    points = spark.createDataFrame(rows, "split string, method_id string, draw int, n double, y double")
    fits = curves.fitted(points, "split", "method_id", "draw", parts=2)
    sinks.write_params(fits, str(tmp_path / "p"), "split", "method_id")
    back = sinks.scan_params(spark, str(tmp_path / "p"), "split string, method_id string, draw int, a double, b double, c double, ssr double")
    assert back.select(*fits.columns).exceptAll(fits).isEmpty()
    assert back.count() == 42
    files = back.where("split = 'random' AND method_id = 'm3'").select(F.input_file_name()).distinct().collect()
    assert files and all("split=random/method_id=m3/" in f for (f,) in files)
    # the same arrays as a dictionary of one array for each curve
    held = {f"{s}-m{m}": np.array([list(r) for r in back.where(f"split = '{s}' AND method_id = 'm{m}'").orderBy("draw").select("a", "b", "c").collect()]) for s in ("random", "scaffold") for m in (0, 6)}
    np.savez(tmp_path / "curves.npz", **held)
    assert _rows(scan_arrays(spark, str(tmp_path / "curves.npz"))) == {(k, i): v[i].tolist() for k, v in held.items() for i in range(3)}
