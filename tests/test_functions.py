import pytest
from pyspark.sql import functions as F

from runlens.functions import durations, labels, names
from runlens.functions.grading import half_even, shift_severity, volatility_label


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_duration_texts(spark):
    seconds = [0.0, 45.0, 59.6, 60.0, 305.0, 480.0, 3723.0]
    assert column(spark, seconds, "double", durations.compact_duration) == ["0s", "45s", "1m", "1m", "5m05s", "8m", "62m03s"]
    assert column(spark, [305.0], "double", lambda x: durations.compact_duration(x, pad=False)) == ["5m5s"]
    assert column(spark, [0.0, 300.0, 3600.0, 3723.0, -5.0], "double", durations.duration_text) == ["0s", "5m0s", "1h0m0s", "1h2m3s", "-5s"]
    assert column(spark, [9000.0, 1800.0, 59.0], "double", durations.total_time_text) == ["2h30m", "30m", "0m"]


def test_parse_duration(spark):
    texts = ["0s", "5m30s", "1h0m0s", "1.5s", "-2m", "250ms", "0"]
    assert column(spark, texts, "string", durations.parse_duration) == [0.0, 330.0, 3600.0, 1.5, -120.0, 0.25, 0.0]
    for bad in ["", "abc", "5", "m5"]:
        with pytest.raises(Exception, match="invalid duration"):
            column(spark, [bad], "string", durations.parse_duration)


def test_stamps(spark):
    lenient = column(spark, ["2026-04-09T10:07:24Z", "", "garbage", None], "string", lambda x: durations.parse_stamp(x, strict=False))
    assert lenient[0] is not None and lenient[1:] == [None, None, None]
    assert column(spark, [""], "string", lambda x: durations.parse_stamp(x, strict=True)) == [None]
    with pytest.raises(Exception, match="not-a-timestamp"):
        column(spark, ["not-a-timestamp"], "string", lambda x: durations.parse_stamp(x, strict=True))


def test_multiplier_and_cores(spark):
    cases = {
        "ubuntu-latest": 1, "windows-2022": 2, "macos-14": 10, "ubuntu-latest-16-cores": 8, "windows-latest-8-cores": 8,
        "macos-latest-12-core": 60, "self-hosted,linux": 0, "Self-Hosted": 0, "custom": 1, "custom,macos-13": 10, "x-1-cores": 1, "": 1,
    }
    rate = lambda x: labels.multiplier(labels.labels_from_text(x))
    assert column(spark, list(cases), "string", rate) == list(map(float, cases.values()))
    assert column(spark, ["custom"], "string", lambda x: labels.multiplier(labels.labels_from_text(x), {"custom": 3.0})) == [3.0]
    cores = {"blacksmith-16vcpu-ubuntu-2404": 16, "ubuntu-latest": 2, "windows-latest": 2, "macos-14": 4, "ubuntu-latest-16-cores": 2,
             "runner-8cores": 8, "4core": 4, "other": 0, "0vcpu-linux": 2, "a-vcpu-8core": 8}
    assert column(spark, list(cores), "string", labels.core_count) == list(cores.values())
    assert column(spark, [0.0, -3.0, 1.0, 60.0, 61.0], "double", labels.billable_minutes) == [0, 0, 1, 1, 2]


def test_names(spark):
    full = ["test (ubuntu-latest, 20)", "build", "a (b) (c)", "(x)"]
    assert column(spark, full, "string", names.matrix_base) == ["test", "build", "a", ""]
    assert column(spark, full, "string", names.matrix_variant) == ["ubuntu-latest, 20", "", "b) (c", "x"]
    steps = ["(jest runner)", "Run e2e", "Lint and Format Check", "Compile", "Checkout", "Set up docker compose", "Deploy infrastructure", "Install deps"]
    assert column(spark, steps, "string", names.step_category) == ["test", "test", "build", "build", "infra", "infra", "other", "infra"]
    stages = [["build"], ["test (a)", "test (b)"], ["tests / unit", "lint"], ["a", "b", "c", "d"], ["ci / x", "ci / y"], ["build", "build"]]
    assert column(spark, stages, "array<string>", names.stage_name) == [
        "build", "test (2 variants)", "unit, lint", "a, b, +2 more", "x, y", "build (2 variants)"]


def test_grades(spark):
    assert column(spark, [1.0, 1.3, 2.0, 3.0], "double", volatility_label) == ["stable", "variable", "spiky", "volatile"]
    assert column(spark, [0.5, 1.5, 2.5], "double", half_even) == ["0", "2", "2"]
    p = [0.001, 0.03, 0.2]
    assert column(spark, p, "double", lambda x: shift_severity(x, F.lit(25.0), F.lit(60.0))) == ["critical", "warning", "info"]
    assert column(spark, p, "double", lambda x: shift_severity(x, F.lit(25.0), F.lit(9.0))) == ["info"] * 3
