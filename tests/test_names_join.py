"""Boxes meet the names of files; contents and pixels are read behind the join, in the tasks that use them."""

import __spark_entry__ as e
from docflow.plans import queries

TABLES = "/root/testdata/sf0.001"


def behind_the_join(df):
    """Whether files are read above a plan's lowest join, and nothing is dealt out or joined between that and the result."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "MapInArrow read" in plan and not any(word in plan.split("MapInArrow read")[0] for word in ("Join", "Repartition", "Aggregate"))


def test_overlay_pixels_sends_no_pixels(spark):
    assert behind_the_join(e.queries()["overlay_pixels"](spark, TABLES))


def test_crop_files_sends_no_contents(spark, monkeypatch):
    written, write = [], queries.file_sink.write_files
    monkeypatch.setattr(queries.file_sink, "write_files", lambda rows, folder: (written.append(rows), write(rows, folder)))
    queries.crop_files(spark, TABLES).count()
    assert len(written) == 2 and behind_the_join(written[1])


def test_names_are_not_broadcast(spark):
    """Spark takes listed names for as small as the folder's own list."""
    df = queries.overlay_pixels(spark, TABLES)
    assert df.count()
    df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
