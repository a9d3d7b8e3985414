"""Models as plug-ins: layout detection and text recognition over iterators of Arrow batches.

A factory makes the model once for each worker process; failures become a status next to the row, never a lost row.
Requests run on an event loop of the task: a window of rows is under way, answers are given in the order of rows.
"""

from __future__ import annotations

import asyncio
import base64
import hashlib
import inspect
import json
import struct
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any, Protocol
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import base64_of
from docflow.operators import pixels
from docflow.operators.boxes import PAGE_PROMPTS, PAGE_TOKENS, mapped, prompts

#: What stands in a document where something failed (fixed values): all attempts of a request, an answer that can't be
#: used, a block beyond the answers, a page whose layout failed.
MARKERS = {
    "request": "\n\n[OCR识别失败：此区域识别超时或服务端异常，标签为: {}]\n\n",
    "answer": "[OCR识别失败: {}]",
    "place": "[OCR识别失败：索引溢出，标签为: {}]",
    "layout": "[Layout分析异常: {}]",
}


def marker(name: str, what: Column) -> Column:
    before, after = MARKERS[name].split("{}")
    return F.concat(F.lit(before), F.coalesce(what, F.lit("")), F.lit(after))


class LayoutModel(Protocol):
    """Finds boxes: for each image (bytes) the scores, label ids and corners."""

    def detect(self, images: list[bytes]) -> list[tuple[list[float], list[int], list[list[float]]]]: ...


class TextRecognizer(Protocol):
    """Sends one request and returns the text; raises on failure. May be a coroutine."""

    def recognize(self, payload: str, timeout: float) -> str: ...


@dataclass(frozen=True)
class Policy:
    """How requests are made. ``attempts`` in all, after each failure a wait of ``wait`` times its number; ``concurrency``
    requests at a time within a window of ``window`` rows; ``rate`` requests a second of each task (0: any), ``burst`` of
    them at once; every other row waits ``stagger`` seconds first. ``keep`` left: a failed row gets a failure text; inner:
    it is left out."""

    attempts: int = 3
    timeout: float = 15.0
    wait: float = 0.5
    concurrency: int = 4
    window: int = 64
    rate: float = 0.0
    burst: int = 1
    stagger: float = 0.0
    keep: str = "left"


#: Policies of blocks, of whole pages, and of the older protocol.
BLOCKS = Policy()
PAGES = Policy(attempts=1, timeout=300.0, stagger=0.2, keep="inner")
OLDER = Policy(attempts=1, timeout=180.0, concurrency=1, keep="inner")


# ---- models of a worker

_models: dict[str, object] = {}
_locks: dict[str, threading.Lock] = {}
_lock = threading.Lock()


def key_of(factory: Callable[[], object]) -> str:
    """Tells factories apart by all that they hold. Worked out once, on the driver."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def model_of(key: str, factory: Callable[[], object]) -> Any:
    """The worker's model of a factory, made once; models of other keys don't wait for it."""
    with _lock:
        own = _locks.setdefault(key, threading.Lock())
    with own:
        if key not in _models:
            _models[key] = factory()
        return _models[key]


# ---- layout

def detect(pages: DataFrame, factory: Callable[[], LayoutModel], keys: str = "doc_id string, page_idx int", images: int = 16) -> DataFrame:
    """keys, scores, labels, boxes, status: raw detections of column content; status is null or what went wrong.

    The model gets up to ``images`` pictures a call; where a call fails, its pictures go one by one, so that only the one
    at fault fails."""
    names, key = [k.split()[0] for k in keys.split(", ")], key_of(factory)

    def told(found: tuple) -> tuple:
        scores, labels, boxes = found
        return [float(s) for s in scores], [int(x) for x in labels], [[float(v) for v in b] for b in boxes], None

    def of(model: LayoutModel, contents: list[bytes]) -> list[tuple]:
        try:
            found = [told(f) for f in model.detect(contents)]
            if len(found) != len(contents):
                raise ValueError(f"{len(found)} answers for {len(contents)} pictures")
            return found
        except Exception as e:
            if len(contents) > 1:
                return [x for c in contents for x in of(model, [c])]
            return [(None, None, None, f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            contents = list(pdf["content"])
            try:
                model = model_of(key, factory)
                rows = [x for k in range(0, len(contents), images) for x in of(model, contents[k : k + images])]
            except Exception as e:  # no model
                rows = [(None, None, None, f"{type(e).__name__}: {e}")] * len(contents)
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(rows, columns=["scores", "labels", "boxes", "status"])], axis=1)

    return pages.select(*names, "content").mapInPandas(run, f"{keys}, scores array<double>, labels array<int>, boxes array<array<double>>, status string")


def error_pages(found: DataFrame) -> DataFrame:
    """Blocks that stand for pages of ``detect`` whose layout failed: one of label paragraph with the failure text."""
    message = F.regexp_replace("status", r"\A\w+: ", "")
    return found.where("status IS NOT NULL").select(
        "doc_id", "page_idx", F.lit(0).alias("block_idx"), F.lit("ocr").alias("kind"), F.lit("paragraph").alias("label"), F.array(*map(F.lit, (0, 0, 10, 10))).alias("bbox"),
        marker("layout", message).alias("content"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("width_str"),
    )


# ---- requests

#: A white picture of 100 by 100, sent where an image is missing.
def blank_image() -> bytes:
    return pixels.to_png(np.full((100, 100, 3), 255, np.uint8))


def chat_payload(prompt: Column, image: Column, max_tokens: Column, model: str) -> Column:
    """The JSON of a chat request with one picture and one text, in this order."""
    url = F.struct(F.concat(F.lit("data:image/png;base64,"), base64_of(image)).alias("url"))
    parts = F.array(F.to_json(F.struct(F.lit("image_url").alias("type"), url.alias("image_url"))), F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text"))))
    head = F.concat(F.lit('{"model":"' + model + '","messages":[{"role":"user","content":['), F.array_join(parts, ","), F.lit(']}],"temperature":0.0,"max_tokens":'))
    return F.concat(head, max_tokens.cast("string"), F.lit("}"))


def older_payload(image: Column, mode: Column) -> Column:
    """The JSON of a request in the older protocol."""
    return F.to_json(F.struct(base64_of(image).alias("image_base64"), mode.alias("mode")))


def response_text(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].message.content")


class Bucket:
    """Tokens that come at ``rate`` a second, ``burst`` of them kept; a request takes one."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic):
        self.rate, self.burst, self.clock = rate, max(burst, 1), clock
        self.level, self.at = float(self.burst), clock()

    def delay(self) -> float:
        """Takes a token; how long to wait for it. Later callers wait longer."""
        if self.rate <= 0:
            return 0.0
        now = self.clock()
        self.level, self.at = min(self.burst, self.level + (now - self.at) * self.rate) - 1, now
        return max(0.0, -self.level / self.rate)


async def answered(client: TextRecognizer, payload: str, policy: Policy, bucket: Bucket, own_loop: bool) -> tuple[str | None, str | None, int]:
    """The answer, or what went wrong last, and the number of attempts. own_loop: the client's requests are coroutines."""
    error = None
    for k in range(policy.attempts):
        if late := bucket.delay():
            await asyncio.sleep(late)
        try:
            async with asyncio.timeout(policy.timeout):
                content = await (client.recognize(payload, policy.timeout) if own_loop else asyncio.to_thread(client.recognize, payload, policy.timeout))
            return content, None if content is not None else "ValueError: an answer without text", k + 1
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if k + 1 < policy.attempts and policy.wait:
                await asyncio.sleep(policy.wait * (k + 1))
    return None, error, policy.attempts


class Window:
    """Requests under way: at most ``policy.window`` payloads are held, the first of them is waited for while the others go
    on. ``policy.concurrency`` coroutines take payloads in their order; with a stagger there is one for each place of the
    window, so that those that wait first hold up no other."""

    def __init__(self, client: TextRecognizer, payloads: Iterator[str], policy: Policy):
        self.client, self.payloads, self.policy = client, enumerate(payloads), policy
        self.own_loop, self.bucket = inspect.iscoroutinefunction(client.recognize), Bucket(policy.rate, policy.burst)
        self.gate = asyncio.Semaphore(policy.concurrency) if policy.stagger else None
        self.held: deque[list] = deque()  # answers in the order of rows: empty lists until they come
        self.ready: deque[tuple[list, int, str]] = deque()
        self.idle: deque[asyncio.Future] = deque()
        self.first: asyncio.Future | None = None  # done when the first answer held has come
        self.workers: list[asyncio.Task] = []
        self.broken: str | None = None

    async def work(self) -> None:
        try:
            await self.take()
        except BaseException as e:  # a client's failures are answers, so this is no request's
            self.broken = f"{type(e).__name__}: {e}"
            if self.first is not None and not self.first.done():
                self.first.set_result(None)
            raise

    async def take(self) -> None:
        loop = asyncio.get_running_loop()
        while True:
            while not self.ready:
                self.idle.append(more := loop.create_future())
                await more
            answer, nth, payload = self.ready.popleft()
            if self.gate is None:
                answer.append(await answered(self.client, payload, self.policy, self.bucket, self.own_loop))
            else:
                if nth % 2:
                    await asyncio.sleep(self.policy.stagger)
                async with self.gate:
                    answer.append(await answered(self.client, payload, self.policy, self.bucket, self.own_loop))
            if self.first is not None and self.held[0] and not self.first.done():
                self.first.set_result(None)

    async def answers(self, n: int) -> list[tuple[str | None, str | None, int]]:
        """The next n answers, or all that are left; the window is filled up before each."""
        loop = asyncio.get_running_loop()
        if not self.workers:
            self.workers = [loop.create_task(self.work()) for _ in range(self.policy.window if self.gate else self.policy.concurrency)]
        out: list[tuple] = []
        while len(out) < n:
            while len(self.held) < self.policy.window and (row := next(self.payloads, None)):
                self.held.append(answer := [])
                self.ready.append((answer, *row))
                if self.idle:
                    self.idle.popleft().set_result(None)
            if not self.held:
                break
            if not self.held[0]:
                self.first = loop.create_future()
                if self.broken is None:
                    await self.first
                self.first = None
            if self.broken:
                raise RuntimeError(f"requests ended: {self.broken}")
            out.append(self.held.popleft()[0])
        return out

    async def close(self) -> None:
        for worker in self.workers:
            worker.cancel()
        await asyncio.gather(*self.workers, return_exceptions=True)


def requests(tasks: DataFrame, factory: Callable[[], TextRecognizer], keys: list[str], policy: Policy = BLOCKS) -> DataFrame:
    """keys, content, status, attempts for rows of keys and payload, in the order of a task's rows.

    At most ``policy.window`` rows are held, whatever the number of a partition's rows: the first of them is waited for
    while the others go on."""
    names, key = keys, key_of(factory)
    schema = tasks.select(*names).schema.add("content", "string").add("status", "string").add("attempts", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        loop = asyncio.new_event_loop()
        parts: deque[pa.RecordBatch] = deque()  # whose keys wait for answers
        window = None
        try:
            window = Window(model_of(key, factory), _payloads(batches, parts), policy)
            held: list[tuple] = []
            while answers := loop.run_until_complete(window.answers(parts[0].num_rows - len(held) if parts else 1)):
                held += answers
                while parts and len(held) >= parts[0].num_rows:
                    part = parts.popleft()
                    told, held = held[: part.num_rows], held[part.num_rows :]
                    columns = [part.column(n) for n in names] + [pa.array(x, arrow.field(f).type) for x, f in zip(zip(*told, strict=True), ("content", "status", "attempts"), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            if window:
                loop.run_until_complete(window.close())
            loop.run_until_complete(loop.shutdown_asyncgens())
            loop.run_until_complete(loop.shutdown_default_executor())
            loop.close()

    found = tasks.select(*names, "payload").mapInArrow(run, schema)
    return found.where("status IS NULL") if policy.keep == "inner" else found


def _payloads(batches: Iterator[pa.RecordBatch], parts: deque[pa.RecordBatch]) -> Iterator[str]:
    """Payloads one by one; what they come from is put down in parts of up to 1000 rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            parts.append(part.drop_columns("payload"))
            yield from part.column("payload").to_pylist()


def recognise(tasks: DataFrame, factory: Callable[[], TextRecognizer], model: str = "recogniser", policy: Policy = BLOCKS) -> DataFrame:
    """doc_id, page_idx, block_idx, content, status, attempts of blocks with a label and an image (null: a blank one is
    sent). With ``policy.keep`` left, a block whose attempts all fail gets the failure text with its label, one whose
    answer has no text the other failure text."""
    ready = prompts(tasks).select("doc_id", "page_idx", "block_idx", "label", chat_payload(F.col("prompt"), F.coalesce("image", F.lit(blank_image())), F.col("max_tokens"), model).alias("payload"))
    found = requests(ready, factory, ["doc_id", "page_idx", "block_idx", "label"], policy)
    no_text = F.col("status").startswith("ValueError: an answer")
    failed = F.when(no_text, marker("answer", F.regexp_replace("status", r"\A\w+: ", ""))).otherwise(marker("request", F.col("label")))
    return found.select("doc_id", "page_idx", "block_idx", F.when(F.col("status").isNull(), F.col("content")).otherwise(failed).alias("content"), "status", "attempts")


def recognise_pages(pages: DataFrame, factory: Callable[[], TextRecognizer], mode: Column, model: str = "recogniser", policy: Policy = PAGES, older: bool = False) -> DataFrame:
    """doc_id, page_idx, content, status, attempts of whole pages with decoded pictures, or with PNG files in column content:
    scaled down to 1536, asked with the prompt of their mode (text, table or formula; unknown modes are text), in either
    protocol. Failed pages are left out, if the policy doesn't say otherwise.

    Files within 1536 go as they are, so that no pixels are made or sent for them."""
    image = F.pandas_udf(_small_files, "binary")("content") if "content" in pages.columns else _small("data", "width", "height", "nChannels")
    small = pages.select("doc_id", "page_idx", mode.alias("mode"), image.alias("image"))
    if older:
        payload = older_payload(F.col("image"), F.col("mode"))
    else:
        payload = chat_payload(mapped(F.col("mode"), PAGE_PROMPTS, PAGE_PROMPTS["text"]), F.col("image"), F.lit(PAGE_TOKENS), model)
    return requests(small.withColumn("payload", payload), factory, ["doc_id", "page_idx"], policy)


def _small_pictures(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([pixels.to_png(pixels.thumbnail(pixels.from_source(*row))) for row in zip(data, width, height, channels, strict=True)])


def _small_files(content: pd.Series) -> pd.Series:
    return pd.Series([pixels.to_png(pixels.thumbnail(pixels.from_png(c))) if max(pixels.png_size(c)) > pixels.MOST else c for c in content], dtype=object)


def _small(*columns: str) -> Column:
    return F.pandas_udf(_small_pictures, "binary")(*columns)


# ---- clients

async def post(url: str, body: bytes) -> tuple[int, bytes]:
    """Status and body of a POST of JSON, over a connection of its own."""
    to = urlsplit(url)
    secure = to.scheme == "https"
    reader, writer = await asyncio.open_connection(to.hostname, to.port or (443 if secure else 80), ssl=secure or None)
    try:
        path = (to.path or "/") + (f"?{to.query}" if to.query else "")
        writer.write(f"POST {path} HTTP/1.0\r\nHost: {to.netloc}\r\nContent-Type: application/json\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body)
        await writer.drain()
        answer = await reader.read()  # to the end: HTTP/1.0 closes
        head, _, rest = answer.partition(b"\r\n\r\n")
        return int(head.split(b" ", 2)[1]), rest
    finally:
        writer.close()


@dataclass(frozen=True)
class HttpRecognizer:
    """Chat requests over HTTP. Anything but status 200 is a failure."""

    url: str

    async def recognize(self, payload: str, timeout: float) -> str | None:
        status, body = await post(self.url, payload.encode())
        if status != 200:
            raise ConnectionError(f"status {status}")
        return json.loads(body)["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class OlderRecognizer:
    """The older protocol: status, result and message."""

    url: str

    async def recognize(self, payload: str, timeout: float) -> str | None:
        status, body = await post(self.url, payload.encode())
        answer = json.loads(body) if status == 200 else {}
        if answer.get("status") != "success":
            raise ConnectionError(answer.get("message") or f"status {status}")
        return answer.get("result")


def asked(payload: str) -> tuple[str, bytes, int]:
    """Prompt, picture and budget of a chat request."""
    request = json.loads(payload)
    parts = {p["type"]: p for p in request["messages"][0]["content"]}
    return parts["text"]["text"], base64.b64decode(parts["image_url"]["image_url"]["url"].partition(",")[2]), request["max_tokens"]


class EchoRecognizer:
    """A stand-in for tests and dry runs: answers with the prompt, the budget and the picture's size."""

    def recognize(self, payload: str, timeout: float) -> str:
        prompt, image, budget = asked(payload)
        width, height = struct.unpack(">II", image[16:24])
        return f"{prompt} {budget} {width}x{height}"


class FlakyRecognizer:
    """A stand-in whose pictures say how often they fail first in a task: digits, then anything. A worker's model outlives
    its tasks, so what failed in one of them is forgotten in the next."""

    def __init__(self) -> None:
        self.failed: dict[bytes, int] = {}
        self.task: int | None = None
        self.asked = lru_cache(256)(asked)

    async def recognize(self, payload: str, timeout: float) -> str:
        prompt, image, _ = self.asked(payload)
        await asyncio.sleep(0)
        context = TaskContext.get()
        task = context.taskAttemptId() if context else None
        if task != self.task:
            self.failed, self.task = {}, task
        if self.failed.get(image, 0) < int(image.split(b":")[0]):
            self.failed[image] = self.failed.get(image, 0) + 1
            raise ConnectionError(f"failure {self.failed[image]}")
        self.failed.pop(image, None)
        return f"{prompt} {image.decode()}"


#: The policy of dry runs: no waiting.
DRY = replace(BLOCKS, wait=0.0)
