"""Many rows at one place, and rows with missing values."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tectra.plans import files
from tectra.queries import ORACLES, QUERIES

START = datetime(2024, 1, 1)


def events(path, rows):
    """rows: (event_id, hours since START, user_id, event_type, value)."""
    ids, hours, users, kinds, values = zip(*rows, strict=True)
    table = {
        "event_id": pa.array(ids, pa.int64()),
        "ts": pa.array([None if h is None else START + timedelta(hours=h) for h in hours], pa.timestamp("us")),
        "user_id": pa.array(users, pa.int64()),
        "event_type": pa.array(kinds, pa.string()),
        "value": pa.array(values, pa.float64()),
    }
    pq.write_table(pa.table(table), f"{path}/events.parquet")
    return str(path)


def nodes(plan):
    """All nodes of a plan that has run."""
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(k) for k in range(plan.children().size())]
    for node in below:
        yield from nodes(node)


def joined(found):
    """The largest number of rows that a join of found, collected before, has made."""
    joins = [n for n in nodes(found._jdf.queryExecution().executedPlan()) if "Join" in n.getClass().getSimpleName()]
    assert joins
    return max(n.metrics().apply("numOutputRows").value() for n in joins)


def test_nearest_vertex_makes_no_pairs_at_a_crowded_place(spark, tmp_path):
    sf = events(tmp_path, [(k, 30.5, k % 300, "click" if k % 2 else "view", 31.0) for k in range(3000)])
    found = QUERIES["nearest_vertex"](spark, sf)
    # Hour 6 of the second day asks at row 180; rows 30 and 180 are apart, so there is nothing to find.
    assert found.collect() == []
    sf = events(tmp_path, [(k, 0.5, k % 300, "click" if k % 2 else "view", 31.0) for k in range(3000)])
    found = QUERIES["nearest_vertex"](spark, sf)
    assert sorted(map(tuple, found.collect())) == [(k, 0, 0, 0) for k in range(1, 3000, 2)]
    assert joined(found) <= 3000


def test_nearest_vertex_with_missing_values_agrees_with_the_oracle(spark, tmp_path):
    rows = [(1, 0.1, None, "view", 5.0), (2, 0.2, 7, "view", 5.0), (3, None, 7, "view", 5.0), (4, 0.3, 7, "click", None), (5, 0.4, 7, "click", 6.5), (None, 0.5, 8, "click", 5.5), (None, 0.6, 8, "click", 90.0), (6, 0.0, None, "click", 90.0), (7, 0.0, 9, None, 5.0)]
    sf = events(tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(f"SELECT req_id, edge_id, i, d2 FROM ({ORACLES['nearest_vertex']})").fetchall()
    assert len(want) == 3
    assert sorted(map(tuple, QUERIES["nearest_vertex"](spark, sf).collect()), key=repr) == sorted(want, key=repr)


def test_project_round_trip_broadcasts_no_pixels(spark):
    found = QUERIES["project_round_trip"](spark, "/root/testdata/sf0.001")
    assert found.count() == len(found.collect()) == 32000
    kinds = [n.getClass().getSimpleName() for n in nodes(found._jdf.queryExecution().executedPlan())]
    assert "SortMergeJoinExec" in kinds
    assert not [k for k in kinds if "Broadcast" in k]
    assert joined(found) <= 500  # lines of 64 pixels


def test_an_empty_project_is_saved_and_opened(spark, tmp_path):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["project_round_trip"](spark, str(tmp_path)).collect() == []


def test_a_project_whose_tables_have_different_pixels_is_refused(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, x, x, 0, 9) for x in range(3)], "image_id long, y int, x int, image int, mask int, filtered_image int")
    files.save_project(px, f"{tmp_path}/whole")
    assert sorted(map(tuple, files.open_project(spark, f"{tmp_path}/whole").collect())) == [(1, 0, x, x, 0, 9) for x in range(3)]
    lines = spark.createDataFrame([(1, 0, [0, 1], [5, 5], "image"), (1, 0, [0, 1], [1, 1], "mask"), (1, 0, [0, 2], [9, 9], "filtered_image")], files._SAVED)
    lines.write.partitionBy("part").parquet(f"{tmp_path}/torn")
    with pytest.raises(Exception, match="different pixels"):
        files.open_project(spark, f"{tmp_path}/torn").collect()
