"""Paths of users: each user has its own, over all of its events."""

import duckdb
import pandas as pd
import pytest

from meridia import queries

SF = "/root/testdata/sf0.001"
PATHS = f"""pt AS (SELECT user_id AS sim_id, row_number() OVER w - 1 AS day, 1000 + sum(value - 50) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 10 AS value FROM '{SF}/events.parquet' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
en AS (SELECT sim_id, arg_max(value, day) / arg_min(value, day) - 1 AS ret FROM pt GROUP BY 1)"""
WHOLE = {
    "simulation_metrics": "SELECT avg(ret) AS mean, median(ret) AS median, min(q) AS var, avg(CASE WHEN ret <= q THEN ret END) AS cvar, min(q) AS p5, quantile_cont(ret, 0.95) AS p95 FROM en CROSS JOIN (SELECT quantile_cont(ret, 0.05) AS q FROM en)",
    "success_probabilities": "SELECT threshold, avg(CASE WHEN ret > threshold THEN 1.0 ELSE 0.0 END) AS prob FROM en CROSS JOIN (SELECT unnest([0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.50])::DOUBLE AS threshold) GROUP BY 1",
    "time_to_target": "SELECT median(day) AS median_day, avg(CASE WHEN day IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT min(CASE WHEN value >= 1010 THEN day END) AS day FROM pt GROUP BY sim_id)",
    "path_bands": f"SELECT CAST(day AS INT) AS day, {', '.join(f'quantile_cont(value, {q}) AS p{int(q * 100):02d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM pt GROUP BY 1",
}


def test_every_event_is_in_its_users_path(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    paths = queries._paths(spark, SF)
    assert paths.count() == events.count()
    assert paths.select("sim_id").distinct().count() == events.select("user_id").distinct().count()


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_paths(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duckdb.sql(f"WITH {PATHS} {WHOLE[name]}").df()
    by = list(got.columns)
    got, want = (x[by].sort_values(by, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)
