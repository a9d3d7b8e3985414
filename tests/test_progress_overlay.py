"""Counters of batch stages and streams; outlines in painter's order."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import overlay
from docflow.operators.progress import Progress, StreamProgress, counters


def test_counters_are_those_of_the_rows(spark):
    run = Progress()
    df = spark.range(100).select("id", F.when(F.col("id") % 7 == 0, "late").alias("status"))
    seen = run.observed(df, "ocr")
    with run.timed("ocr") as stage:
        rows = seen.collect()
    assert stage.counts == {"completed": 100, "succeeded": sum(r.status is None for r in rows), "failed": 15}
    assert stage.seconds > 0 and stage.per_second == pytest.approx(100 / stage.seconds)
    assert run.log().startswith("ocr: 100 done, 15 failed, ")


def test_streams_are_summed_over_batches_and_failures_told(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", F.when(F.col("id") % 4 == 0, "late").alias("status")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = StreamProgress()
    spark.streams.addListener(listener)
    try:
        read = spark.readStream.schema("id long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = read.observe("pages", *counters()).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start()
        query.awaitTermination()
        bad = read.select(F.raise_error(F.lit("bad page"))).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).start()
        with pytest.raises(Exception):  # noqa: B017
            bad.awaitTermination()
        for _ in range(100):
            if not listener.running and listener.failures:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert dict(listener.counts["pages"]) == {"completed": 30, "succeeded": 22, "failed": 8}
    assert sum(listener.rows.values()) == 30 and any("bad page" in f for f in listener.failures.values())


def test_later_outlines_cover_earlier_ones():
    image = np.zeros((30, 40, 3), np.uint8)
    out = overlay.outlined(image, [(5, 5, 20, 20), (18, 2, 60, 12), (3, 3, 2, 9), (0, 25, 1, 26)], ["red", "green", "blue", "yellow"])
    assert out[5, 5].tolist() == out[7, 7].tolist() == out[20, 20].tolist() == [255, 0, 0] and out[8, 8].tolist() == [0, 0, 0]
    assert out[6, 19].tolist() == [0, 128, 0] and out[2, 39].tolist() == [0, 128, 0] and out[3, 3].tolist() == [0, 0, 0]
    assert out[25, 0].tolist() == out[26, 1].tolist() == [255, 255, 0] and (image == 0).all()


def test_pages_without_boxes_stay(spark):
    pages = spark.createDataFrame([("d", 0, 4, 3, 3, bytearray(b"\x07" * 36)), ("d", 1, 4, 3, 3, bytearray(36))], "doc_id string, page_idx int, width int, height int, nChannels int, data binary")
    draw = spark.createDataFrame([("d", 0, 0, 0, 0, 9, 9, "red"), ("x", 0, 0, 0, 0, 9, 9, "red")], "doc_id string, page_idx int, det_idx int, x1 int, y1 int, x2 int, y2 int, color string")
    found = overlay.overlay_images(pages, draw, "det_idx")
    assert sorted((r.doc_id, r.page_idx) for r in found.collect()) == [("d", 0), ("d", 1)]
    assert sorted(r.path for r in overlay.overlay_rows(found, F.lit("p")).collect()) == ["d/diagnostics/p_diagnostic.png"] * 2
