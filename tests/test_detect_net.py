"""The net detectors against their SQL where the first step matters."""

import duckdb
import pytest

from cadenza.plans import catalogue
from tests.test_queries import plain

#: The SQL takes a saturated first step as a peak; thinning then passes over other peaks than from the second step on.
FILMS = {
    0: [92.4, 45.13, 34.39, 29.21, 0.69, 33.12, 12.56, 4.9, 0.52, 22.48, 13.64, 26.38, 88.22, 27.66, 56.5, 2.22, 1.87, 21.52, 85.71, 53.67, 130.9, 26.71, 67.17, 26.0, 43.05, 30.38, 12.11, 4.34, 25.02, 18.23, 24.01, 36.59, 68.51, 7.38, 34.72, 3.33, 23.06, 62.62, 117.83, 22.16, 122.55, 92.95, 4.65, 104.42, 123.56, 35.83, 59.24, 9.46, 6.81, 6.51, 61.74, 0.69, 3.76, 24.51, 36.33, 15.32, 34.88, 12.89, 34.96, 31.65, 31.13, 46.27, 88.16, 58.5],
    1: [95.0, *[90.0 - k for k in range(30)], 10.0],
    2: [89.9, *[80.0 - k for k in range(25)], 10.0],
    3: [90.0, 90.0, 60.0, 55.0, 50.0],
    4: [300.0],
    5: [None, 60.0, 70.0, 50.0],
}


@pytest.mark.parametrize("name", ["detect_net", "detect_net_guarded"])
def test_first_steps_count_as_in_sql(spark, tmp_path, name):
    rows = [(film * 100 + i, film, "view", value) for film, values in FILMS.items() for i, value in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = sorted(found.columns)
    expected = plain(duck.sql(catalogue.ORACLES[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert plain(found.select(*columns).collect()) == expected
