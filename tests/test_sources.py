from __future__ import annotations

import json
import math
import os

import model
import pytest

from incidentlens import dedupe_points
from incidentlens.sources import (
    ParsedIncidents,
    parse_lines,
    read_hotspots,
    read_incidents,
    write_hotspots,
)
from incidentlens.sources import incidents
from incidentlens.workspace import Files


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id BIGINT, line STRING")
    return ParsedIncidents(parse_lines(df))


def test_good_lines(spark):
    parsed = parse(
        spark,
        "52.10\t-1.50\t10\tA1\tA1 north\t2016-01-02\t12:30\tMonday",
        "52.1\t-1.5\t 10 \t\tsomewhere",
        "52.1\t-1.5\t10\tA1",
        "NaN\t-1.5\t10\tA1",
    )
    assert parsed.rejects.count() == 0
    rows = parsed.good.orderBy("row_id").collect()
    assert (rows[0].lat_text, rows[0].lat, rows[0].weekday) == ("52.10", 52.1, "Monday")
    assert (rows[1].bearing, rows[1].partial_location, rows[1].date) == (10, "", None)
    assert rows[2].full_location is None
    assert math.isnan(rows[3].lat)


def test_rejects_say_why(spark):
    bad = ["52\t-1\t10", "", "north\t-1\t10\tA1", "52\t\t10\tA1", "52\t-1\t12.5\tA1", "52\t-1\tx\tA1"]
    parsed = parse(spark, *bad, "52\t-1\t10\tA1")
    got = {r.row_id: (r.line, r.reject_reason) for r in parsed.rejects.collect()}
    reasons = ["missing field"] * 2 + ["bad latitude", "bad longitude"] + ["bad bearing"] * 2
    assert got == {i: (line, reason) for i, (line, reason) in enumerate(zip(bad, reasons))}
    assert [r.row_id for r in parsed.good.collect()] == [6]


def test_row_ids_follow_file_order(spark, ws, tmp_path):
    """Files of different size, read in several splits, are numbered by name and line."""
    sizes = {"a.txt": 3, "b.txt": 5000, "c.txt": 400}
    want, n = {}, 0
    for name, count in sizes.items():
        with open(tmp_path / name, "w") as out:
            for i in range(count):
                out.write(f"{n}.5\t1\t10\troad {name}\n")
                want[n] = n + 0.5
                n += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good = read_incidents(spark, str(tmp_path), workspace=ws, min_partitions=3).good
        assert good.rdd.getNumPartitions() == 3
        assert {r.row_id: r.lat for r in good.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_write_and_read_back(spark, tmp_path, format):
    spots = spark.createDataFrame(
        [(0, 1.5, 2.5, 0), (1, 3.25, 4.0, 10), (2, 5.0, 6.0, 11)],
        "row_id BIGINT, lat DOUBLE, lon DOUBLE, fitness BIGINT",
    )
    path = str(tmp_path / "spots")
    write_hotspots(spots, path, format=format)
    got = sorted(tuple(r) for r in read_hotspots(spark, path, format).collect())
    assert got == [(3.25, 4.0, 10), (5.0, 6.0, 11)]
    strong = read_hotspots(spark, f"{path}_grt10", format).collect()
    assert [tuple(r) for r in strong] == [(5.0, 6.0, 11)]


def outputs(spark, path):
    return [sorted(tuple(r) for r in read_hotspots(spark, p).collect()) for p in (path, f"{path}_grt10")]


def test_both_outputs_or_neither(spark, tmp_path, monkeypatch):
    """A failure between the two outputs leaves nothing, or what was there before."""
    schema = "row_id BIGINT, lat DOUBLE, lon DOUBLE, fitness BIGINT"
    first = spark.createDataFrame([(1, 3.25, 4.0, 10), (2, 5.0, 6.0, 11)], schema)
    second = spark.createDataFrame([(3, 1.0, 1.0, 12), (4, 2.0, 2.0, 0), (5, 3.0, 3.0, 1)], schema)
    path, rename = str(tmp_path / "spots"), Files.rename

    def failing(self, source, target):
        if "staging" in source and target.endswith("_grt10"):
            raise OSError("lost")
        rename(self, source, target)

    monkeypatch.setattr(Files, "rename", failing)
    with pytest.raises(OSError):
        write_hotspots(first, path)
    assert not os.listdir(tmp_path)
    monkeypatch.setattr(Files, "rename", rename)
    assert write_hotspots(first, path) == {"all": 2, "strong": 1}
    before = outputs(spark, path)
    monkeypatch.setattr(Files, "rename", failing)
    with pytest.raises(OSError):
        write_hotspots(second, path, mode="overwrite")
    monkeypatch.setattr(Files, "rename", rename)
    with pytest.raises(FileExistsError):
        write_hotspots(second, path)
    assert outputs(spark, path) == before and len(os.listdir(tmp_path)) == 2
    assert write_hotspots(second, path, mode="overwrite") == {"all": 2, "strong": 1}
    assert outputs(spark, path) == [[(1.0, 1.0, 12), (3.0, 3.0, 1)], [(1.0, 1.0, 12)]]
    manifest = json.loads((tmp_path / "spots" / "_manifest.json").read_text())
    assert manifest == {"rows": {"all": 2, "strong": 1}, "output": "all"}
    assert write_hotspots(second.filter("fitness = 0"), path, mode="overwrite") == {"all": 0, "strong": 0}
    assert outputs(spark, path) == [[], []]


@pytest.mark.parametrize("few", [True, False])
def test_lines_are_numbered_where_they_lie(spark, ws, tmp_path, monkeypatch, few):
    """The table of splits is broadcast, so that parsed lines are not shuffled; many splits are joined."""
    monkeypatch.setattr(incidents, "BROADCAST_SPLITS", 100 if few else 0)
    (tmp_path / "a.txt").write_text("52\t1\t10\tr\n" * 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = read_incidents(spark, str(tmp_path), workspace=ws).good
        plan = good._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) != few
        assert sorted(r.row_id for r in good.select("row_id").collect()) == list(range(50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_to_text_keeps_coordinates_as_written(spark, ws, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("52.100\t-1.50\t10\tA1\n52.1\t-1.5\t20\ta1\nbroken\n52.1\t-1.5\t20\tB2\n")
    good = read_incidents(spark, str(source), workspace=ws).good
    run = dedupe_points(good, 0.5, workspace=ws)
    write_hotspots(run.suppressors, str(tmp_path / "out"), incidents=good)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["52.100\t-1.50\t1"]


def test_model_and_schema_agree():
    assert len(model.random_rows(5, seed=0)[0]) == len(model.SCHEMA.split(","))
