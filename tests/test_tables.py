"""HTML tables: spans, tables within, broken ones."""

import pytest

from docflow.operators.html_tables import rewrite_tables, table_markdown

RULE = {n: "|" + " --- |" * n for n in range(1, 9)}


@pytest.mark.parametrize(
    "html, lines",
    [
        ("<table></table>", []),
        ("<table><tr></tr><tr><td>a<td>b<tr><td>c</table>", ["|  |  |", 2, "| a | b |", "| c |  |"]),
        ("<table><tr><td colspan=2>a</td><td>b</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>", ["| a |  | b |", 3, "| 1 | 2 | 3 |"]),
        ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>", ["| a | b |", 2, "|  | c |", "| d |  |"]),
        ("<table><tr><td>a</td><td rowspan=3 colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>", ["| a | b |  |  |", 4, "| c |  |  | d |"]),
        ("<table><tr><td rowspan=0>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>", ["| a | b |", 2, "|  | c |", "|  | d |"]),
        ("<table><tr><td colspan=99999999 rowspan=-1>a</td></tr><tr><td colspan=x>b</td></tr></table>", ["| a |", 1, "| b |"]),
        ("<table><tr><td>a<table><tr><td>x|y</td><td rowspan=2>z</td></tr><tr><td>w</td></tr></table>b</td><td>c</td></tr></table>", [r"| a x\|y z w b | c |", 2]),
        ("<table><tr><td>a<table><tr><td>x</td></tr></table>", ["| a x |", 1]),  # the pattern ends at the first closing tag
        ("<tablefoo><tr><td>a<br>b</td></tr></table>", ["| a b |", 1]),
    ],
)
def test_markdown(html, lines):
    assert table_markdown(html) == "\n".join(RULE[x] if isinstance(x, int) else x for x in lines)


def test_spans_agree_with_a_plain_grid():
    import random

    r = random.Random(2)
    for _ in range(60):
        rows = [[(f"t{r.randrange(999)}", r.randint(1, 3), r.randint(1, 3)) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 5))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}</td>" for t, c, d in row) + "</tr>" for row in rows) + "</table>"
        lines = table_markdown(html).split("\n")
        cells = [[c.strip() for c in line[1:-1].split("|")] for k, line in enumerate(lines) if k != 1]
        assert len(cells) == len(rows) and len({len(c) for c in cells}) == 1
        assert [[c for c in row if c] for row in cells] == [[t for t, _, _ in row] for row in rows]  # each text once, in its row, in order


def test_rows_stay_where_they_are(spark):
    df = spark.createDataFrame([(1, "a<table><tr><td>x</td></tr></table>b<TABLE></TABLE>c"), (2, "none"), (3, ""), (4, None)], "id int, text string")
    out = rewrite_tables(df, ["id"])
    assert {r.id: r.text for r in out.collect()} == {1: "a\n\n| x |\n| --- |\n\nb\n\n\n\nc", 2: "none", 3: "", 4: None}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
