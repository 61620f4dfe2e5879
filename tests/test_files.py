"""Reading folders of spectrum files and tables, and writing them back."""

import json

import pytest
from pyspark.sql import functions as F

from spectraloom.sinks import tables as sinks
from spectraloom.sources import files, tables
from spectraloom.sources.paths import path_fields


def two_row(axis, values):
    return " ".join(map(str, axis)) + "\n" + "\t".join(map(str, values)) + "\n"


def in_columns(columns):
    return "\n".join(" ".join(map(str, row)) for row in zip(*columns)) + "\n"


@pytest.fixture()
def root(tmp_path):
    base = tmp_path / "set one+two"
    sheets = {
        "230101_s1": ({"source": "lab", "species": "casei", "pcr": "a, b", "device": "x", "strain": None,
                       "measurement": "by hand"}, ["m_pos01_000001.txt", "m_pos02_000002.txt"]),
        "brevis_probe_3": (None, ["n_p11_000001.txt"]),
        "unlisted": (None, ["z_p01_000001.txt"]),
        "casei_broken": ("{not json", ["k_p07_000001.txt"]),
    }
    for folder, (sidecar, names) in sheets.items():
        (base / folder).mkdir(parents=True)
        if sidecar is not None:
            (base / folder / "metadata.json").write_text(sidecar if isinstance(sidecar, str) else json.dumps(sidecar))
        for k, name in enumerate(names):
            (base / folder / name).write_text("# comment\n\n" + two_row([400.5, 401, 402.5], [1 + k, 2.5, -3e2]))
    (base / "230101_s1" / "notes.csv").write_text("not a spectrum")
    (base / "230101_s1" / "deeper").mkdir()
    (base / "230101_s1" / "deeper" / "q_p01_000001.txt").write_text("text that is not a spectrum")
    return base


def test_folder_scan_and_metadata(spark, root):
    df = files.read_dataset(spark, str(root), ["casei", "brevis"], "unlisted lab")
    rows = {r["spectrum_id"]: r for r in df.collect()}
    assert set(rows) == {"m_pos01_000001", "m_pos02_000002", "n_p11_000001", "k_p07_000001"}
    first = rows["m_pos01_000001"]
    assert first["wavenumbers"] == [400.5, 401.0, 402.5] and first["intensities"] == [1.0, 2.5, -300.0]
    assert (first["source"], first["species"], first["pcr"], first["sample"]) == ("lab", "casei", "a+b", "s1")
    assert first["measurement"] == "by hand" and first["extra"] == {"device": "x"} and first["idx"] == 1
    assert first["filename"] == "m_pos01_000001.txt" and first["growth_time"] is None
    fallback = rows["n_p11_000001"]
    assert (fallback["source"], fallback["species"], fallback["pcr"]) == ("unlisted lab", "brevis", None)
    assert fallback["sample"] == "brevis" and fallback["measurement"] == "n_p11" and fallback["idx"] == 11
    assert rows["k_p07_000001"]["species"] == "casei"


def test_column_layouts_and_old_form(spark, tmp_path):
    folder = tmp_path / "230101_s1"
    (folder / "OldForm").mkdir(parents=True)
    (folder / "metadata.json").write_text('{"source": "lab", "species": "casei", "pcr": null}')
    (folder / "a_p01_000001.txt").write_text(in_columns([[0, 1], [400, 401], [7, 8]]))
    (folder / "OldForm" / "b_p02_000001.txt").write_text(in_columns([[0, 1], [9, 9], [500, 501], [3, 4]]))
    rows = {r["spectrum_id"]: r for r in files.read_dataset(spark, str(tmp_path), ["casei"], "f", "oem").collect()}
    assert rows["a_p01_000001"]["wavenumbers"] == [400.0, 401.0] and rows["a_p01_000001"]["intensities"] == [7.0, 8.0]
    assert rows["b_p02_000001"]["wavenumbers"] == [500.0, 501.0] and rows["b_p02_000001"]["intensities"] == [3.0, 4.0]
    assert {r["sample"] for r in rows.values()} == {"s1"}
    assert files.read_spectrum_files(spark, str(tmp_path), "oem_oldform").columns


@pytest.mark.parametrize("content", ["1 2 x\n1 2 3\n", "1 2 3\n1 2\n"])
def test_bad_files_fail(spark, tmp_path, content):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a_p01_000001.txt").write_text(content)
    with pytest.raises(Exception):
        files.read_spectrum_files(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        files.read_spectrum_files(spark, str(tmp_path), "three_row")


def test_same_stem_in_two_folders(spark, tmp_path):
    from spectraloom.operators.joins import assert_unique
    for folder in ("casei_1", "casei_2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a_p01_000001.txt").write_text(two_row([1, 2], [3, 4]))
    with pytest.raises(ValueError):
        assert_unique(files.read_dataset(spark, str(tmp_path), ["casei"], "f"))
    qualified = assert_unique(files.read_dataset(spark, str(tmp_path), ["casei"], "f", qualify_ids=True))
    assert {r["spectrum_id"] for r in qualified.collect()} == {"casei_1/a_p01_000001", "casei_2/a_p01_000001"}


def test_path_fields_edges(spark):
    paths = ["/d/x_y_z/noext", "/d/solo/.txt", "/d/a_b/t_q7_1.tar.txt"]
    df = spark.createDataFrame(list(enumerate(paths)), "id int, path string")
    rows = df.select("id", *[c.alias(n) for n, c in path_fields(F.col("path")).items()]).orderBy("id").collect()
    assert [r["spectrum_id"] for r in rows] == ["noext", ".txt", "t_q7_1.tar"]
    assert [r["idx"] for r in rows] == [None, None, None]
    assert [r["sample"] for r in rows] == ["x", "solo", "b"]


def test_different_axes_are_reported(spark, tmp_path):
    (tmp_path / "casei").mkdir()
    (tmp_path / "casei" / "a_p01_000001.txt").write_text(two_row([1, 2], [3, 4]))
    files.assert_common_axis(files.read_spectrum_files(spark, str(tmp_path)))
    (tmp_path / "casei" / "b_p01_000001.txt").write_text(two_row([1, 3], [3, 4]))
    with pytest.raises(ValueError, match="axes"):
        files.assert_common_axis(files.read_spectrum_files(spark, str(tmp_path)))


def test_wide_csv_round_trip_through_registry(spark, root, tmp_path):
    df = files.read_dataset(spark, str(root), ["casei", "brevis"], "f").cache()
    out = str(tmp_path / "processed")
    meta = ["spectrum_id", "species", "pcr", "sample"]
    sinks.write_spectra(df, out, meta, "csv")
    registry = {"done": tables.DataSet(out, "processed"),
                "raw": tables.DataSet(str(root), species=["casei", "brevis"], fallback_source="f")}
    columns = ["spectrum_id", "wavenumbers", "intensities", "species", "pcr", "sample"]
    expected = sorted(map(tuple, df.select(*columns).collect()), key=str)
    for name in registry:
        again = tables.load_dataset(spark, name, registry).select(*columns)
        assert sorted(map(tuple, again.collect()), key=str) == expected
    with pytest.raises(KeyError):
        tables.load_dataset(spark, "other", registry)
    df.unpersist()


def test_parquet_tables_and_splits(spark, root, tmp_path):
    df = files.read_dataset(spark, str(root), ["casei", "brevis"], "f")
    out = str(tmp_path / "t")
    sinks.write_spectra(df, out, ["spectrum_id", "species", "sample"])
    metadata = spark.read.parquet(f"{out}/metadata")
    assert metadata.count() == spark.read.parquet(f"{out}/spectra").count() == 4
    sinks.write_splits(metadata, f"{out}/splits", n_splits=2)
    written = spark.read.parquet(f"{out}/splits")
    assert written.count() == 8
    plan = written.where("split = 1 AND role = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_legacy_groups(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("id\t400.5\t401\nr1\t1\t2\nr2\t3\t4\n")
    (tmp_path / "two.tsv").write_text("id\t400.5\t401\nr1\t5\t6\n")
    groups = {"g": {"fnames": ["one.tsv", "two.tsv"], "target": "casei"}, "h": {"fnames": ["two.tsv"], "target": "notarget"}}
    rows = tables.read_group_files(spark, str(tmp_path), groups).collect()
    assert len(rows) == 4
    assert {(r["group"], r["filename"], r["id_in_file"], r["is_target"]) for r in rows} == {
        ("g", "one.tsv", "r1", "target"), ("g", "one.tsv", "r2", "target"), ("g", "two.tsv", "r1", "target"),
        ("h", "two.tsv", "r1", "no target")}
    assert all(r["wavenumbers"] == [400.5, 401.0] for r in rows)


def test_exports(spark, tmp_path):
    results = {"spectra_raw": spark.createDataFrame([("a", [1.0, 2.0])], "spectrum_id string, intensities array<double>"),
               "confusion": spark.createDataFrame([(0, 0, 3)], "y int, y_pred int, n int")}
    sinks.export_results(results, str(tmp_path / "results"))
    assert spark.read.option("header", True).csv(str(tmp_path / "results/spectra_raw")).first()["intensities"] == "1.0 2.0"
    assert spark.read.option("header", True).csv(str(tmp_path / "results/confusion")).first()["n"] == "3"
