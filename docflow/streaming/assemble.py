"""Assembly of out-of-order recognition results as a stream: pages leave a document's state when they are written.

State is kept by page: one entry for each open page, and a queue of pages in the order of their registration. A batch
loads the pages that its events touch, works on them in memory and puts back those that are still open, so its cost
follows its events, not the open pages. With a deadline, a timer for the head of the queue turns pages that wait for
answers too long into pages with failure texts, so a lost answer can't hold up a document.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docflow.operators.infer import MARKERS

#: kind is register (with the page's ocr blocks), fill, or error (a page whose layout failed; content says why).
EVENTS = "doc_id STRING, seq BIGINT, kind STRING, page_idx INT, ocr_blocks ARRAY<INT>, block_idx INT, content STRING"
WRITTEN = "doc_id STRING, page_idx INT, flush_seq BIGINT, contents STRING"
#: Fills as they wait for registrations of their batch.
FILL = pa.schema([("seq", pa.int64()), ("nth", pa.int64()), ("page_idx", pa.int32()), ("block_idx", pa.int32()), ("content", pa.string())])
LATE = MARKERS["answer"].format("no answer in time")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Page:
    """An open page: its blocks' contents (None: to come), and when it is written without them."""

    due: int
    contents: dict[int, str | None] = field(default_factory=dict)

    @property
    def pending(self) -> int:
        return sum(c is None for c in self.contents.values())


class Assembler(StatefulProcessor):
    """Registers pages, takes the first fill of each of their ocr blocks, and writes pages in order.

    Fills of pages that aren't registered or are written already, of unknown blocks and of filled ones are left out. A
    page is written without what hasn't come ``deadline`` after its registration (seq counts milliseconds then).
    """

    def __init__(self, deadline: int | None = None):
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getValueState("places", "next_page INT, head INT, tail INT")
        self.stored = handle.getMapState("pages", "page INT", "due BIGINT, blocks ARRAY<INT>, contents ARRAY<STRING>")
        self.queue = handle.getMapState("queue", "place INT", "page INT")

    def begin(self) -> None:
        self.next_page, self.head, self.tail = self.places.get() if self.places.exists() else (0, 0, 0)
        self.pages: dict[int, Page | None] = {}
        self.in_state: set[int] = set()
        self.out: list[tuple[int, int, str]] = []

    def page(self, number: int) -> Page | None:
        if number not in self.pages:
            found = self.stored.getValue((number,)) if self.stored.containsKey((number,)) else None
            self.pages[number] = Page(found[0], dict(zip(found[1], found[2], strict=True))) if found else None
            if found:
                self.in_state.add(number)
        return self.pages[number]

    def open_page(self, number: int, seq: int, contents: dict[int, str | None]) -> None:
        if number < self.next_page or self.page(number):
            return
        self.pages[number] = Page(seq + (self.deadline or 0), contents)
        if self.deadline is not None:
            self.queue.updateValue((self.tail,), (number,))
            self.tail += 1

    def flush(self, seq: int) -> None:
        while (page := self.page(self.next_page)) and not page.pending:
            self.out.append((self.next_page, seq, "|".join(page.contents[b] or "" for b in sorted(page.contents))))
            self.pages[self.next_page] = None
            self.next_page += 1

    def first_due(self) -> Page | None:
        """The page at the head of the queue; pages that need no deadline any more leave it."""
        while self.head < self.tail:
            number = self.queue.getValue((self.head,))[0]
            page = self.page(number) if number >= self.next_page else None
            if page and page.pending:
                return page
            self.queue.removeKey((self.head,))
            self.head += 1
        return None

    def expire(self, now: int) -> None:
        """Fills up pages that were due before ``now``."""
        while self.deadline is not None and (page := self.first_due()) and page.due < now:
            page.contents = {b: LATE if c is None else c for b, c in page.contents.items()}
            self.flush(page.due)

    def end(self, key) -> Iterator[pd.DataFrame]:
        for number, page in self.pages.items():
            if page:
                blocks = sorted(page.contents)
                self.stored.updateValue((number,), (page.due, blocks, [page.contents[b] for b in blocks]))
            elif number in self.in_state:
                self.stored.removeKey((number,))
        if self.deadline is not None and (first := self.first_due()):
            self.handle.registerTimer(first.due + 1)
        self.places.update((self.next_page, self.head, self.tail))
        yield pd.DataFrame([(key[0], *x) for x in self.out], columns=["doc_id", "page_idx", "flush_seq", "contents"]).astype({"page_idx": "int32", "flush_seq": "int64"})

    def wanted(self, rows: Iterator[pd.DataFrame]) -> tuple[int, list[tuple]]:
        """The time of a batch's last event, and in order what can change a page: its first registration or error, and for
        each of its blocks the first fill after that. Fills wait in a file for the registrations, so memory follows the pages
        and blocks, not the events."""
        now, n, opened = 0, 0, {}
        with tempfile.TemporaryFile() as file:
            writer = None
            for pdf in rows:
                now = max(now, int(pdf["seq"].max()))
                pdf = pdf.assign(nth=np.arange(n, n + len(pdf)))
                n += len(pdf)
                opens = pdf["kind"].isin(["register", "error"])
                for e in pdf[opens].sort_values(["seq", "nth"]).drop_duplicates("page_idx").itertuples(index=False):
                    at = (int(e.seq), int(e.nth))
                    if int(e.page_idx) not in opened or at < opened[int(e.page_idx)][0]:
                        opened[int(e.page_idx)] = at, e
                fills = pa.RecordBatch.from_pandas(pdf.loc[~opens, ["seq", "nth", "page_idx", "block_idx", "content"]], FILL, preserve_index=False)
                writer = writer or pa.ipc.new_stream(file, FILL)
                writer.write_batch(fills)
            if writer:
                writer.close()
            file.seek(0)
            first: dict[tuple[int, int], tuple] = {}
            for batch in pa.ipc.open_stream(file) if writer else ():
                pdf = batch.to_pandas()
                # of pages open before the batch all fills count, of others those after their registration
                after = {p: (-1, -1) if self.page(p) else opened[p][0] for p in pdf["page_idx"].unique().tolist() if p in opened or self.page(p)}
                pdf = pdf[pdf["page_idx"].isin(list(after))]
                seq, nth = (pdf["page_idx"].map({p: a[k] for p, a in after.items()}) for k in (0, 1))
                late = (pdf["seq"] > seq) | ((pdf["seq"] == seq) & (pdf["nth"] > nth))
                for e in pdf[late].sort_values(["seq", "nth"]).drop_duplicates(["page_idx", "block_idx"]).assign(kind="fill").itertuples(index=False):
                    key, at = (int(e.page_idx), int(e.block_idx)), (int(e.seq), int(e.nth))
                    if key not in first or at < first[key][0]:
                        first[key] = at, e
        return now, [e for _, e in sorted([*opened.values(), *first.values()], key=lambda x: x[0])]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.begin()
        now, events = self.wanted(rows)
        for e in events:
            number, seq = int(e.page_idx), int(e.seq)
            self.expire(seq)
            if e.kind == "register":
                self.open_page(number, seq, {int(b): None for b in e.ocr_blocks})
            elif e.kind == "error":
                self.open_page(number, seq, {0: MARKERS["layout"].format(e.content or "")})
            elif page := self.page(number):
                block = int(e.block_idx)
                if block in page.contents and page.contents[block] is None:
                    page.contents[block] = (e.content or "").replace("```", "")
            self.flush(seq)
        self.expire(now)
        yield from self.end(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.begin()
        self.expire(expiredTimerInfo.getExpiryTimeInMs())
        yield from self.end(key)

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, deadline: int | None = None) -> DataFrame:
    """The written pages of a stream of EVENTS; needs the RocksDB state store. With a deadline, seq counts milliseconds
    and is the time of an event, which the watermark follows: events have to come in its order."""
    if deadline is not None:
        events = events.withColumn("at", F.timestamp_millis("seq")).withWatermark("at", "0 seconds")
    mode = "None" if deadline is None else "EventTime"
    return events.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Assembler(deadline), outputStructType=WRITTEN, outputMode="Append", timeMode=mode)


def run_to_end(spark: SparkSession, folder: str, deadline: int | None = None, **options: str) -> DataFrame:
    """Assembles all events below ``folder``/events and waits; the written pages. The state store is that of a session of
    its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = assemble_stream(own.readStream.schema(EVENTS).options(**options).parquet(f"{folder}/events"), deadline)
    query = out.writeStream.format("parquet").option("path", f"{folder}/written").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(WRITTEN).parquet(f"{folder}/written")
