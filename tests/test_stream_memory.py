"""A batch's memory doesn't grow with its events."""

import tracemalloc

import pandas as pd
from test_stream import Handle

from docflow.streaming.assemble import Assembler


def events(n):
    """Registrations among very many fills of few blocks, in no order."""
    seq = [2 * ((k * 7919) % n) for k in range(n)]
    pdf = pd.DataFrame({"doc_id": "d", "seq": seq, "kind": "fill", "page_idx": [k % 6 for k in range(n)], "ocr_blocks": None, "block_idx": [k // 6 % 4 for k in range(n)], "content": [f"{s}" * 20 for s in seq]}).astype(object)
    return pd.concat([pdf[: n // 2], pd.DataFrame({"doc_id": "d", "seq": [2 * (n // 3 + p) + 1 for p in range(6)], "kind": "register", "page_idx": range(6), "ocr_blocks": [[0, 1, 2, 3]] * 6, "block_idx": None, "content": None}).astype(object), pdf[n // 2 :]], ignore_index=True)


def chunks(pdf):
    for k in range(0, len(pdf), 1000):
        yield pdf.iloc[k : k + 1000].astype({"seq": "int64", "page_idx": "int32"}).copy()


def peak_of(n, found):
    assembler, pdf = Assembler(10 * n), events(n)
    assembler.init(Handle())
    tracemalloc.start()
    found += [tuple(x) for out in assembler.handleInputRows(("d",), chunks(pdf), None) for x in out.itertuples(index=False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_memory_of_a_batch_follows_its_blocks():
    few, found = [], []
    peak_of(1003, few)  # modules are loaded
    small, large = peak_of(9001, []), peak_of(90001, found)
    pdf = events(90001)
    fills, opened = pdf[pdf["kind"] == "fill"], pdf[pdf["kind"] == "register"].set_index("page_idx")["seq"]
    first = fills[fills["seq"].astype(int) > fills["page_idx"].map(opened).astype(int)].sort_values("seq").drop_duplicates(["page_idx", "block_idx"])
    assert [x[3] for x in found] == ["|".join(g.sort_values("block_idx")["content"]) for _, g in first.groupby("page_idx")] and len(found) == 6
    assert large < 3 * small  # ten times the events
