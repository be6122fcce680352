"""Formatting, levels, series, selection, safety and settings on fixed inputs, and properties."""

import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import derived, formatting as fmt, levels
from tidegauge.operators import safety, selection, series, snapshot
from tidegauge.plans import render, views
from tidegauge.sources.settings import INTERVALS, Settings
from tidegauge.sources.tables import CRITICAL, PROTECTED, process_class


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


BYTES = [(0, "00 B"), (5, "05 B"), (10, "10 B"), (100, "100 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (2047, "1.9 KB"), (10239, "9.9 KB"), (10240, "10 KB"), (1048575, "1024 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"), (2**40, "1.0 TB"), (2**50, "1.0 PB"), (2**60, "1.0 EB")]


def test_format_bytes(spark):
    assert [r[0] for r in values(spark, BYTES, "n long, want string", fmt.format_bytes(F.col("n")))] == [w for _, w in BYTES]


def test_format_number(spark):
    rows = [(0, "0"), (999, "999"), (1000, "1.00K"), (1500, "1.50K"), (999999, "1000.00K"), (1000000, "1.00M"), (2500000000, "2.50B")]
    assert [r[0] for r in values(spark, rows, "n long, w string", fmt.format_number(F.col("n")))] == [w for _, w in rows]


def test_zero_padded(spark):
    rows = [(0, "00"), (5, "05"), (42, "42"), (1000, "1000"), (999999, "999999")]
    assert [r[0] for r in values(spark, rows, "n long, w string", fmt.zero_padded(F.col("n")))] == [w for _, w in rows]


@pytest.mark.parametrize(("text", "most", "want"), [("hello", 10, "hello"), ("hello world", 8, "hello..."), ("日本語テスト", 5, "日本..."), ("test", 3, "test")])
def test_truncate(spark, text, most, want):
    assert values(spark, [(text,)], "s string", fmt.truncate(F.col("s"), most)) == [(want,)]


def test_temperatures(spark):
    assert [r[0] for r in values(spark, [(59.9,), (60.0,), (70.0,), (85.0,)], "t double", levels.level(F.col("t"), levels.TEMP_LABEL))] == ["Normal", "Warm", "High", "Critical"]
    assert [r[0] for r in values(spark, [(0.0,), (35.0,), (56.0,), (85.0,)], "t double", fmt.format_temperature(F.col("t"), "F"))] == ["32°F", "95°F", "133°F", "185°F"]
    rows = derived.temperature_estimates(spark.createDataFrame([(0.0,), (42.0,), (100.0,)], "u double"), "u").select("package", "cores", "gpu", "ane", "fan_rpm").collect()
    assert [tuple(map(float, r)) for r in rows] == [(35, 37, 35, 35, 2000), (56, 58, 47.6, 43.4, 3680), (85, 87, 65, 55, 6000)]


def test_bar(spark):
    assert values(spark, [(50.0,), (-5.0,), (500.0,)], "v double", fmt.bar(F.col("v"), 100, 10)) == [("▓" * 5 + "░" * 5,), ("░" * 10,), ("▓" * 10,)]


def test_padded_never_cuts(spark):
    assert values(spark, [("ab",), ("abcdef",)], "s string", fmt.padded(F.col("s"), 4)) == [("ab  ",), ("abcdef",)]


@pytest.mark.parametrize(("given_values", "width", "want"), [([3.0, 1.0], 5, [3, 1]), (list(map(float, range(10))), 4, [1, 4, 6, 9]), (list(map(float, range(15))), 11, [0, 1, 3, 4, 5, 7, 8, 9, 11, 12, 13])])
def test_downsample(spark, given_values, width, want):
    assert values(spark, [(given_values,)], "v array<double>", series.downsampled(F.col("v"), width))[0][0] == want


def test_exact_downsample_keeps_the_newest(spark):
    assert values(spark, [(list(map(float, range(15))),)], "v array<double>", series.downsampled(F.col("v"), 11, exact=True))[0][0][-1] == 14


@hyp(max_examples=12, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=80), st.integers(1, 40))
def test_downsample_properties(spark, data, width):
    got = values(spark, [(data,)], "v array<double>", series.downsampled(F.col("v"), width))[0][0]
    assert len(got) == min(len(data), width) and set(got) <= set(data) and max(got) <= max(data)


@pytest.mark.parametrize(("data", "want"), [([10.0, 20.0, 30.0, 40.0, 50.0], [0, 2, 4, 5, 7]), ([7.0, 7.0], [8, 8]), ([0.0, 0.0], [0, 0]), ([0.5, 0.5], [4, 4])])
def test_chart_levels(spark, data, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(data)], "k int, idx int, v double")
    assert [r.level for r in series.chart_levels(df, ["k"], "v").orderBy("idx").collect()] == want


def test_rates_resets_and_standing_time(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 0), (1, 2, "2024-01-01 00:00:01", 100), (1, 3, "2024-01-01 00:00:03", 300), (1, 4, "2024-01-01 00:00:04", 50), (1, 5, "2024-01-01 00:00:04", 60)]
    df = spark.createDataFrame(rows, "k int, id int, t string, c long").withColumn("t", F.col("t").cast("timestamp"))
    got = series.rates(df, ["k"], ["id"], "c", "t").orderBy("id").select("rate", "counter_reset").collect()
    assert [tuple(r) for r in got] == [(None, False), (100, False), (100, False), (None, True), (None, False)]


@pytest.mark.parametrize("n", [10, 75])
def test_ring_keeps_the_last_sixty(spark, n):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "k int, id int, v double")
    got = series.history_arrays(df, ["k"], ["id"], "v").first()["values"]
    assert got == [float(i) for i in range(max(0, n - 60), n)]


def test_appended_ring(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    assert df.select(series.appended(F.col("a"), F.lit(4.0), 3)).first()[0] == [2.0, 3.0, 4.0]


def test_array_max_by_position(spark):
    rows = values(spark, [([1.0, 5.0], [3.0]), ([], [2.0])], "a array<double>, b array<double>", series.array_max_by_position(F.col("a"), F.col("b")))
    assert rows == [([3.0, 5.0],), ([2.0],)]


def test_empty_range(spark):
    got = series.value_range(spark.createDataFrame([], "v double"), [], "v").first()
    assert tuple(got) == (0.0, 1.0)


PEOPLE = [(1, "launchd", "root"), (57, "mds", "root"), (100, "Finder", "alice"), (200, "cfprefsd", "root"), (300, "helper", "_mbsetupuser"), (400, "Editor", "alice"), (500, "日本語テスト", "bob"), (600, "ghost", "")]


def test_safety_table(spark):
    df = spark.createDataFrame(PEOPLE, "pid long, name string, user string")
    listed = {r.pid: (r.is_protected, r.is_system) for r in safety.listed_flags(df).collect()}
    assert listed == {1: (True, True), 57: (False, True), 100: (True, False), 200: (False, True), 300: (False, True), 400: (False, False), 500: (False, False), 600: (False, False)}
    kinds = {r.pid: (r.protected, r.system, r.sudo, len(r.warnings)) for r in safety.classified(df, "alice").collect()}
    assert kinds == {1: (True, False, True, 2), 57: (True, False, True, 2), 100: (True, False, False, 1), 200: (False, True, True, 2), 300: (False, True, True, 2), 400: (False, False, False, 0), 500: (False, False, True, 1), 600: (False, False, False, 0)}
    checked = {r.pid: (r.ok, len(r.warnings)) for r in safety.validated(df, "alice").collect()}
    assert checked == {1: (False, 1), 57: (True, 2), 100: (True, 1), 200: (True, 2), 300: (True, 1), 400: (True, 0), 500: (True, 1), 600: (True, 0)}


def test_confirmation_and_plan(spark):
    df = spark.createDataFrame(PEOPLE, "pid long, name string, user string")
    chosen = spark.createDataFrame([(p,) for p, *_ in PEOPLE] + [(999,)], "pid long")
    got = safety.confirmation(df, chosen, "alice").first()
    assert (got.processes, got.has_protected, got.has_system, got.requires_sudo, got.n_warnings) == (8, True, True, True, 10)
    plan = {r.pid: r.action for r in safety.kill_plan(df, chosen, "alice", force=True).collect()}
    assert plan == {p: "SKIP_PROTECTED" if p <= 100 else "KILL" for p, *_ in PEOPLE}
    nobody = safety.confirmation(df, chosen.where("pid = 999"), "alice").first()
    assert (nobody.processes, nobody.has_protected, nobody.n_warnings, nobody.warnings) == (0, False, 0, "")


@pytest.mark.parametrize("pid", [0, -1])
def test_unknown_pids_match_nothing(spark, pid):
    df = spark.createDataFrame(PEOPLE, "pid long, name string, user string")
    assert safety.kill_plan(df, spark.createDataFrame([(pid,)], "pid long"), "alice").count() == 0


def test_process_classes(spark):
    assert len(PROTECTED) == 16 and set(CRITICAL) <= set(PROTECTED)
    df = spark.createDataFrame(PEOPLE, "pid long, name string, user string")
    joined = {r.pid: r.is_protected for r in safety.flags_by_join(df, process_class(spark)).collect()}
    assert joined == {r.pid: r.is_protected for r in safety.listed_flags(df).collect()}


def test_selection(spark):
    rows = spark.createDataFrame([(p, 100.0 - i) for i, p in enumerate((100, 200, 300, 400, 500))], "pid long, cpu_percent double")
    pids = lambda df: sorted(r.pid for r in df.collect())
    assert pids(selection.select_range(rows, 200, 400)) == pids(selection.select_range(rows, 400, 200)) == [200, 300, 400]
    assert pids(selection.select_range(rows, 200, 999)) == []
    assert pids(selection.select_range(rows, 200, 200)) == [200]
    some = selection.select_range(rows, 100, 200)
    assert pids(selection.toggled(some, rows.where("pid in (200, 300)").select("pid"))) == [100, 300]
    assert pids(selection.added(some, some)) == [100, 200]
    assert pids(selection.select_all(rows)) == [100, 200, 300, 400, 500]


def test_sort_spec():
    spec = snapshot.SortSpec()
    assert spec.toggled("cpu") == snapshot.SortSpec("cpu", True)
    assert spec.toggled("name") == snapshot.SortSpec("name", True)
    assert spec.toggled("name", from_keyboard=True) == snapshot.SortSpec("name", False)
    assert str(snapshot.SortSpec("no such key", True).columns()) == str(spec.columns())


def test_settings(tmp_path):
    path = tmp_path / "deep" / "settings.json"
    assert Settings.load(path) == Settings()
    assert Settings.parse("{not json") == Settings()
    assert Settings.parse("{}") == Settings(mouse_enabled=False)
    changed = Settings().changed("update_interval").changed("temperature_unit").changed("max_processes", -1)
    assert changed == Settings(2_000_000_000, "F", False, 20, True)
    changed.save(path)
    assert Settings.load(path) == changed and path.read_text().startswith("{\n  ")
    assert Settings(update_interval=7).changed("update_interval").update_interval == INTERVALS[1]
    assert Settings(update_interval=5_000_000_000).changed("update_interval").update_interval == INTERVALS[0]
    assert Settings(max_processes=200).changed("max_processes").max_processes == 20


def test_process_table_filters(spark):
    df = spark.createDataFrame([(1, "launchd", "root", 5.0, 10, 1, 0, 0), (200, "Editor", "alice", 7.0, 2048, 2, 1024, 1024)], "pid long, name string, user string, cpu_percent double, memory long, threads int, io_write_bytes long, io_read_bytes long")
    chosen = spark.createDataFrame([(200,)], "pid long")
    got = views.process_table(df, chosen, show_system=False, text="EDI", most=5).collect()
    assert [(r.pid, r.name, r.memory, r.net_io) for r in got] == [(200, "▶ Editor", "2.0 KB", "2.0 KB")]


def test_cpu_view_has_the_first_eight_cores(spark):
    rows = [(k, "host", f"core{k % 10}", float(k)) for k in range(40)]
    got = views.cpu(spark.createDataFrame(rows, "event_id long, series string, core string, value double")).select("core").distinct().collect()
    assert sorted(r.core for r in got) == [f"core{k}" for k in range(8)]


def test_render(spark):
    assert render.text_table(spark.createDataFrame([(1, 0.25, None), (20, 2.0, "x")], "a int, b double, c string")) == "a   b    c\n1   0.2\n20  2.0  x"
    chart = render.sparkline([0, 2, 4, 5, 7], 5).split("\n")
    assert len(chart) == 5 and chart[-1].strip()
    assert render.gauge("▓░", percent=50.0) == "▓░  50.0%" and render.gauge("▓░", value=3.0, unit="W") == "▓░    3.0 W"


def test_sparkline_fills_a_line_for_each_level():
    """Five values between 10 and 50 at a height of 5: levels over 5 fill the column, a level of 2 fills two lines."""
    assert render.sparkline([0, 2, 4, 5, 7], 5).split("\n") == ["   ▅▇", "  ▄▅▇", "  ▄▅▇", " ▂▄▅▇", " ▂▄▅▇"]
    assert render.labelled_sparklines({"down": [0, 8], "": [4]}) == "       down:  █\n▄"


@pytest.mark.parametrize("x", [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.25, 2.675, 9.95, 99.95, 123.45, 1e9 + 0.05, 0.3, 2.0 / 3])
def test_fixed_rounds_the_binary_value(spark, x):
    assert spark.range(1).select(fmt.fixed(F.lit(x))).first()[0] == f"{x:.1f}"


def test_scratch_folder_on_a_cluster():
    """Without a shared folder a session of several machines is an error."""
    from types import SimpleNamespace

    from tidegauge.shared import scratch_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_dir(bare)
    bare.conf = SimpleNamespace(get=lambda key, other: "hdfs://x/shared/")
    assert scratch_dir(bare) == "hdfs://x/shared"


def test_command_line(spark, tmp_path, capsys):
    """Version and tables on stdout; an unknown query is an error and unreadable settings a warning on stderr."""
    from tidegauge import __version__
    from tidegauge.__main__ import main
    from tidegauge.sources.settings import default_path

    with pytest.raises(SystemExit) as end:
        main(["--version"])
    assert end.value.code == 0 and capsys.readouterr().out.strip() == __version__
    assert main(["--show", "no_such_query", str(tmp_path)]) == 1 and "no_such_query" in capsys.readouterr().err
    (tmp_path / "bad.json").write_text("{")
    assert main(["--settings", str(tmp_path / "bad.json")]) == 0
    said = capsys.readouterr()
    assert "warning" in said.err and '"max_processes": 50' in said.out
    assert str(default_path("/home/x")) == "/home/x/.config/tidegauge/settings.json"


def test_first_of_and_unit_helpers(spark):
    row = spark.range(1).select(derived.first_of(F.array(F.lit(3), F.lit(4))).alias("a"), derived.first_of(F.array().cast("array<int>")).alias("b"), derived.gigahertz(F.lit(2400.0)).alias("c"), derived.thread_count(F.lit(4), F.lit(2)).alias("d"))
    assert tuple(row.first()) == (3, None, 2.4, 8)



def test_two_decimals_as_c_prints_them(spark):
    """Ties of the decimal text that are none of the binary value, true ties, carries, signs and large numbers."""
    import random

    rng = random.Random(3)
    values = [0.0, 1.005, 2.675, 0.125, 0.375, 9.995, 99.995, 0.005, 1e9 + 0.005, 123456789.125, -1.005, -0.004, 2.0**40 + 0.25] + [rng.randrange(10**6) / 1000 for _ in range(500)] + [rng.random() * 10 ** rng.randint(-3, 9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", fmt.fixed(F.col("v"), 2).alias("two"), fmt.fixed(F.col("v")).alias("one"), fmt.mini_gauge(F.col("v"), "GB", 50.0, 4).alias("mini")).collect()
    assert all((r.two, r.one) == (f"{r.v:.2f}", f"{r.v:.1f}") for r in got)
    assert all(r.mini[4:] == f" {r.v:6.1f} GB" for r in got)
