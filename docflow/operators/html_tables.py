"""HTML tables in text: where they are, and their Markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A table from its opening to its first closing tag (fixed value).
TABLE = r"(?is)<table.*?>.*?</table>"


def tables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TABLE), F.lit(0))


#: Cells that a span reaches at most; longer spans are cut there.
MOST_SPAN = 1000


class _Table:
    """A table being read: rows of cells, each a text with its spans."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((" ".join("".join(self.cell).split()).replace("|", r"\|"), *self.spans))
            self.cell = None

    def grid(self) -> list[list[str]]:
        """Every row with a text for each place. A cell stands where its span begins, the rest of it is empty; places that
        spans from above hold are passed over. A span of 0 rows goes on to the last row; spans never make a row or a
        column that no cell begins in."""
        taken: dict[tuple[int, int], str] = {}
        width = 0
        for y, row in enumerate(self.rows):
            x = 0
            for text, across, down in row:
                while (y, x) in taken:
                    x += 1
                width = max(width, x + 1)
                below = len(self.rows) - y if down == 0 else min(down, len(self.rows) - y)
                for i in range(below):
                    for j in range(across):
                        taken.setdefault((y + i, x + j), "")
                taken[y, x] = text
        return [[taken.get((y, x), "") for x in range(width)] for y in range(len(self.rows))]


def _span(attrs: list[tuple[str, str | None]], name: str, least: int) -> int:
    value = (dict(attrs).get(name) or "").strip()
    return min(max(int(value), least), MOST_SPAN) if value.isascii() and value.isdigit() else 1


class _Tables(HTMLParser):
    """Tables by a stack: one within a cell is read by itself, and its texts become part of the cell's."""

    def __init__(self):
        super().__init__()
        self.first: _Table | None = None
        self.open: list[_Table] = []

    def handle_starttag(self, tag, attrs):
        if tag.startswith("table"):  # as the tables' pattern has it
            self.open.append(_Table())
            self.first = self.first or self.open[0]
        elif not self.open:
            return
        elif tag == "tr":
            self.open[-1].end_cell()
            self.open[-1].rows.append([])
        elif tag in ("td", "th"):
            own = self.open[-1]
            own.end_cell()
            if not own.rows:
                own.rows.append([])
            own.cell, own.spans = [], (_span(attrs, "colspan", 1), _span(attrs, "rowspan", 0))
        elif self.open[-1].cell is not None:
            self.open[-1].cell.append(" ")

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th", "tr"):
            self.open[-1].end_cell()
        elif tag == "table":
            self.end_table()
        elif self.open[-1].cell is not None:
            self.open[-1].cell.append(" ")

    def end_table(self) -> None:
        inner = self.open.pop()
        inner.end_cell()
        if self.open and self.open[-1].cell is not None:
            texts = [text for row in inner.rows for text, _, _ in row if text]
            self.open[-1].cell.append(" " + " ".join(texts).replace(r"\|", "|") + " ")

    def handle_data(self, data):
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell.append(data)


def table_markdown(html: str) -> str:
    """The first table: rows with bars, a rule under the first. A table without cells is empty; tables that aren't closed
    end with the text."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    while parser.open:
        parser.end_table()
    rows = [r for r in (parser.first.grid() if parser.first else []) if r]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * len(rows[0]), *lines[1:]]) if rows else ""


@F.pandas_udf(ArrayType(StringType()))
def _markdowns(html: pd.Series) -> pd.Series:
    return html.map(lambda found: None if found is None else [table_markdown(h) for h in found])


def rewrite_tables(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text: each HTML table as Markdown between blank lines; null texts stay null. Rows stay where they are, and only
    tables go through Python."""
    pieces, found = F.split(text, TABLE, -1), tables(F.col(text))
    between = F.transform(F.col("_md"), lambda x: F.concat(F.lit("\n\n"), x, F.lit("\n\n")))
    joined = F.zip_with("_pieces", between, lambda piece, md: F.concat(piece, F.coalesce(md, F.lit(""))))
    met = df.select(*keys, pieces.alias("_pieces"), _markdowns(found).alias("_md"))
    return met.select(*keys, F.array_join(joined, "").alias("text"))
