"""Requests against a local server, order and attempts, and models that fail."""

import base64
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from docflow.operators import boxes, infer, pixels
from docflow.operators.infer import Policy

TASK = "doc_id string, page_idx int, block_idx int, label string, image binary"


@pytest.fixture
def server():
    """Answers with the picture's text; those that say fail, slow or empty do so."""
    seen, open_now, most = [], [0], [0]
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            request = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "mode" in request:
                text, answer = base64.b64decode(request["image_base64"]).decode(), None
            else:
                assert [p["type"] for p in request["messages"][0]["content"]] == ["image_url", "text"] and request["temperature"] == 0.0
                text = base64.b64decode(request["messages"][0]["content"][0]["image_url"]["url"].partition(",")[2]).decode("latin-1")
            with lock:
                seen.append((time.monotonic(), text))
                open_now[0] += 1
                most[0] = max(most[0], open_now[0])
            time.sleep(0.3 if text.startswith("slow") else 0.01)
            with lock:
                open_now[0] -= 1
            if "mode" in request:
                answer = {"status": "error", "message": "no"} if text.startswith("fail") else {"status": "success", "result": f"{request['mode']} {text}"}
            else:
                answer = {"choices": [{"message": {"content": None if text.startswith("empty") else f"{request['max_tokens']} {text[:20]}"}}]}
            body = json.dumps(answer).encode()
            self.send_response(500 if text.startswith("fail") and "mode" not in request else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/chat/completions", seen, most
    server.shutdown()


def tasks(spark, texts, label="text"):
    return spark.createDataFrame([("d", 0, k, label if k % 2 else "Table", bytearray(t.encode())) for k, t in enumerate(texts)], TASK).coalesce(1)


def test_answers_are_in_order_and_failures_are_rows(spark, server):
    url, seen, most = server
    texts = ["slow 0", "one", "fail 2", "slow 3", "empty 4", *(f"t{k}" for k in range(5, 60))]
    found = infer.recognise(tasks(spark, texts), lambda: infer.HttpRecognizer(url), policy=Policy(wait=0.01, window=16)).collect()
    assert [r.block_idx for r in found] == list(range(60))
    assert [r.content for r in found if r.status is None] == [f"{1024 if k % 2 else 4096} {t}" for k, t in enumerate(texts) if k not in (2, 4)]
    assert (found[2].content, found[2].status, found[2].attempts) == ("\n\n[OCR识别失败：此区域识别超时或服务端异常，标签为: Table]\n\n", "ConnectionError: status 500", 3)
    assert (found[4].content, found[4].attempts) == ("[OCR识别失败: an answer without text]", 1)
    counts = Counter(t for _, t in seen)
    assert counts["fail 2"] == 3 and all(counts[t] == 1 for t in texts if t != "fail 2")
    assert most[0] == 4


def test_late_answers_fail_and_inner_results_leave_failures_out(spark, server):
    url, seen, _ = server
    found = infer.recognise(tasks(spark, ["slow", "a", "fail", "b"]), lambda: infer.HttpRecognizer(url), policy=Policy(attempts=1, timeout=0.15, keep="inner")).collect()
    assert [(r.block_idx, r.content) for r in found] == [(1, "1024 a"), (3, "1024 b")]
    assert len(seen) == 4


def test_a_rate_is_kept(spark, server):
    url, seen, _ = server
    infer.recognise(tasks(spark, [f"t{k}" for k in range(12)]), lambda: infer.HttpRecognizer(url), policy=Policy(rate=20.0, burst=2)).collect()
    assert seen[-1][0] - seen[0][0] >= 10 / 20 * 0.9


def test_bucket():
    now = [0.0]
    bucket = infer.Bucket(10.0, 3, lambda: now[0])
    assert [round(bucket.delay(), 3) for _ in range(5)] == [0, 0, 0, 0.1, 0.2]
    now[0] = 1.0
    assert [round(bucket.delay(), 3) for _ in range(4)] == [0, 0, 0, 0.1]
    assert infer.Bucket(0.0, 1).delay() == 0


def test_whole_pages_in_either_protocol(spark, server):
    url, seen, _ = server
    image = np.full((4, 6, 3), 9, np.uint8)
    pages = spark.createDataFrame([("d", k, 6, 4, 3, bytearray(image.tobytes())) for k in range(3)], "doc_id string, page_idx int, width int, height int, nChannels int, data binary").coalesce(1)
    from pyspark.sql import functions as F

    found = infer.recognise_pages(pages, infer.EchoRecognizer, F.lit("table"), policy=infer.PAGES).collect()
    assert [(r.page_idx, r.content) for r in found] == [(k, "Table Recognition: 1536 6x4") for k in range(3)]
    small = pages.select("doc_id", "page_idx", F.when(F.col("page_idx") == 1, "fail").otherwise("good").cast("binary").alias("image"))
    ready = small.withColumn("payload", infer.older_payload(F.col("image"), F.lit("text")))
    found = infer.requests(ready, lambda: infer.OlderRecognizer(url), ["doc_id", "page_idx"], infer.OLDER).collect()
    assert [(r.page_idx, r.content) for r in found] == [(0, "text good"), (2, "text good")]


def test_missing_pictures_are_blank(spark):
    df = spark.createDataFrame([("d", 0, 0, "Formula", None)], TASK)
    assert infer.recognise(df, infer.EchoRecognizer).first().content == "Formula Recognition: 256 100x100"


def test_only_the_picture_at_fault_fails(spark):
    class Model:
        def __init__(self):
            self.calls = 0

        def detect(self, images):
            if any(i == b"bad" for i in images):
                raise ValueError("no picture")
            return [([0.9], [0], [[1.0, 2.0, float(len(images)), 4.0]]) for _ in images]

    pages = spark.createDataFrame([("d", k, bytearray(b"bad" if k == 5 else b"good")) for k in range(20)], "doc_id string, page_idx int, content binary").coalesce(1)
    found = infer.detect(pages, Model, images=8).cache()
    assert {r.page_idx: r.status for r in found.collect() if r.status} == {5: "ValueError: no picture"}
    assert {r.boxes[0][2] for r in found.collect() if r.boxes} == {1.0, 8.0, 4.0}
    block = infer.error_pages(found).first()
    assert (block.page_idx, block.block_idx, block.label, block.content) == (5, 0, "paragraph", "[Layout分析异常: no picture]")
    assert boxes.detections(found, {0: "text"}).count() == 19


def test_no_model_is_a_status(spark):
    def factory():
        raise FileNotFoundError("models/layout")

    pages = spark.createDataFrame([("d", 0, bytearray(b"x"))], "doc_id string, page_idx int, content binary")
    assert infer.detect(pages, factory).first().status == "FileNotFoundError: models/layout"


def test_models_are_told_apart_and_made_once():
    make = lambda name: lambda: [name]
    one, two = make("a"), make("b")
    first = infer.model_of(infer.key_of(one), one)
    assert (first, infer.model_of(infer.key_of(two), two)) == (["a"], ["b"]) and infer.model_of(infer.key_of(make("a")), make("a")) is first
    assert pixels.to_png(np.zeros((1, 1, 3), np.uint8)) and infer.blank_image()[16:24] == b"\x00\x00\x00\x64" * 2


def test_a_worker_forgets_what_failed_in_earlier_tasks(spark):
    """The same rows in the same worker again, after a run that gave up on some of them."""
    rows = tasks(spark, [f"{k % 5}:{k}" for k in range(2500)])

    def failed(policy):
        return sorted(r.block_idx for r in infer.recognise(rows, infer.FlakyRecognizer, policy=policy).collect() if r.status is not None)

    for attempts in (3, 2, 3):
        assert failed(Policy(attempts=attempts, wait=0.0)) == [k for k in range(2500) if k % 5 >= attempts]


def test_a_request_that_is_cancelled_ends_the_task(spark):
    class Cancelled:
        async def recognize(self, payload, timeout):
            import asyncio

            raise asyncio.CancelledError

    with pytest.raises(Exception, match="requests ended"):
        infer.recognise(tasks(spark, ["a", "b"]), Cancelled).collect()
