import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "ATTRIBUTED_ORDERS" in df.columns


def test_every_query_has_oracle_or_is_documented(spark):
    from touchline.plans.registry import QUERIES
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o)


def test_all_queries_run_on_smoke_data(spark):
    from touchline.plans.registry import QUERIES
    for name, fn in QUERIES.items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name


def test_workers_get_the_package_from_any_folder(tmp_path):
    """A driver in another folder that set ``sys.path`` alone."""
    import os
    import subprocess
    import sys
    home = os.path.dirname(os.path.abspath(entry_mod.__file__))
    code = f"""
import sys
sys.path.insert(0, {home!r})
from touchline.session import get_session, ship_package
spark = get_session("local[2]", shuffle_partitions=2)
ship_package(spark)
ship_package(spark)

def run(batches):
    from touchline.functions import text
    for b in batches:
        yield b

assert spark.range(3).mapInArrow(run, "id bigint").count() == 3
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_absent_subpackage_is_told_from_a_broken_one():
    assert entry_mod._present("touchline.session")
    assert not entry_mod._present("touchline.nowhere.queries")
    assert not entry_mod._present("nowhere_at_all")
