"""The assembler against a plain replay, cut into batches anywhere; its cost; and as a stream over many triggers."""

import random

import pandas as pd
import pytest

from docflow.streaming import assemble as stream
from docflow.streaming.assemble import EVENTS, LATE, Assembler

COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    calls = 0

    def containsKey(self, key):
        Map.calls += 1
        return key in self

    def getValue(self, key):
        Map.calls += 1
        return self[key]

    def updateValue(self, key, value):
        Map.calls += 1
        self[key] = value

    def removeKey(self, key):
        Map.calls += 1
        del self[key]


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def assembled(batches, deadline=None):
    """What the assembler writes of batches of events, timers firing after each batch as the watermark says."""
    handle, made = Handle(), Assembler(deadline)
    made.init(handle)
    out = []
    for events in batches:
        for pdf in made.handleInputRows(("d",), iter([pd.DataFrame(events, columns=COLUMNS)]), None):
            out += [tuple(r)[1:] for r in pdf.itertuples(index=False)]
        now = max(e[1] for e in events)
        while due := sorted(t for t in handle.timers if t <= now):
            handle.timers.remove(due[0])
            for pdf in made.handleExpiredTimer(("d",), None, Expired(due[0])):
                out += [tuple(r)[1:] for r in pdf.itertuples(index=False)]
    return out, handle


def replay(events, deadline):
    """One event after the other, all pages looked at each time."""
    pages, out, current = {}, [], 0
    for _, seq, kind, page, blocks, block, content in [*sorted(events, key=lambda e: e[1]), (None, max(e[1] for e in events), "end", None, None, None, None)]:
        for p in sorted(pages.values(), key=lambda p: p["due"]):
            if deadline is not None and p["due"] < seq and None in p["got"].values():
                p["got"] = {b: LATE if c is None else c for b, c in p["got"].items()}
                while current in pages and None not in pages[current]["got"].values():
                    out.append((current, p["due"], "|".join(c for _, c in sorted(pages.pop(current)["got"].items()))))
                    current += 1
        if kind == "register" and page >= current and page not in pages:
            pages[page] = {"due": seq + (deadline or 0), "got": dict.fromkeys(blocks)}
        elif kind == "error" and page >= current and page not in pages:
            pages[page] = {"due": seq + (deadline or 0), "got": {0: f"[Layout分析异常: {content}]"}}
        elif kind == "fill" and page in pages and block in pages[page]["got"] and pages[page]["got"][block] is None:
            pages[page]["got"][block] = content.replace("```", "")
        while current in pages and None not in pages[current]["got"].values():
            out.append((current, seq, "|".join(c for _, c in sorted(pages.pop(current)["got"].items()))))
            current += 1
    return out


def log(seed, pages=30):
    r = random.Random(seed)
    early, seqs = iter(r.sample(range(0, 3000, 2), pages * 4)), iter(r.sample(range(1, 10_000, 2), pages * 10))
    events = []
    for p in range(pages):
        blocks = sorted(r.sample(range(6), r.randint(0, 4)))
        if r.random() < 0.1:
            events.append(("d", next(early), "error", p, None, None, "bad page"))
        for _ in range(r.choice([1, 1, 1, 2])):
            events.append(("d", next(early), "register", p, blocks, None, None))
        for b in blocks:
            for _ in range(r.choice([0, 1, 1, 2])):
                events.append(("d", next(seqs), "fill", p, None, b, f"{p}.{b}```"))
        events.append(("d", next(seqs), "fill", p, None, 9, "no such block"))
    return events


@pytest.mark.parametrize("deadline", [None, 700, 4000])
@pytest.mark.parametrize("seed", range(6))
def test_any_cut_gives_the_same(seed, deadline):
    r, events = random.Random(seed), sorted(log(seed), key=lambda e: e[1])
    cuts = sorted(r.sample(range(1, len(events)), 9))
    batches = [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True)]
    for one in batches:
        r.shuffle(one)
    expected = replay(events, deadline)
    found, handle = assembled(batches, deadline)
    assert found == expected == assembled([events], deadline)[0] and (deadline is None or len(expected) > 5)
    assert len(handle.maps["pages"]) <= 30 - len(found)  # what is written has left the state


def test_cost_is_linear_in_pages():
    def calls(pages):
        Map.calls = 0
        events = [("d", 10 * p + k, kind, p, [0, 1], b, "x") for p in reversed(range(pages)) for k, (kind, b) in enumerate([("register", None), ("fill", 0), ("fill", 1)])]
        r = random.Random(1)
        r.shuffle(events)
        events = [(d, k, *rest) for k, (d, _, *rest) in enumerate(sorted(events, key=lambda e: e[2] == "fill"))]
        found, _ = assembled([events[k : k + 500] for k in range(0, len(events), 500)], 10**9)
        assert len(found) == pages
        return Map.calls

    assert calls(10_000) < 12 * calls(1_000)


def test_a_stream_of_many_triggers(spark, tmp_path):
    events = sorted(log(11), key=lambda e: e[1])
    events = [(f"d{k}", s * 1000, *rest) for k in range(3) for _, s, *rest in events]
    events.sort(key=lambda e: e[1])
    for k in range(0, len(events), 60):
        part = spark.createDataFrame(events[k : k + 60], EVENTS).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events")
    found = stream.run_to_end(spark, str(tmp_path), 900_000, maxFilesPerTrigger="4")
    expected = replay([("d", s * 1000, *rest) for _, s, *rest in log(11)], 900_000)
    for k in range(3):
        assert sorted((r.page_idx, r.flush_seq, r.contents) for r in found.where(f"doc_id = 'd{k}'").collect()) == sorted(expected)
    assert any(LATE in c for _, _, c in expected)
