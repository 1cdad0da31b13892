import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["priority", "priority_rank", "rule"]


def test_every_query_has_a_builder():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def test_forecast_one_row_per_open_line(spark):
    sf = "/root/testdata/sf0.001"
    f = E.queries()["forecast_demand"](spark, sf)
    assert f.count() == f.select("service_id", "flight_id", "product_id").count()
    open_lines = E.queries()["scan_lot_services"](spark, sf).where("consumed_qty IS NULL").count()
    assert f.count() <= open_lines


def test_queries_run_from_another_directory(tmp_path):
    """Python workers must not need the package on their path (the driver may
    import __spark_entry__ from anywhere)."""
    import subprocess
    import sys

    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "import __spark_entry__ as E\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
        "print('N', E.queries()['forecast_demand'](s, '/root/testdata/sf0.001').count())\n"
    ) % root
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert any(line.startswith("N ") for line in out.stdout.splitlines())
