"""Tables made from a grid with spans, written as HTML and as LaTeX, come back equal."""

import html
import random

import pytest

from sparkloom.functions import grids
from sparkloom.functions.similarity import table_similarity


def random_table(rng):
    """(rows of (text, columns, rows) in reading order, the grid they make)."""
    height, width = rng.randint(1, 5), rng.randint(1, 5)
    grid, rows = [[None] * width for _ in range(height)], [[] for _ in range(height)]
    for r in range(height):
        for c in range(width):
            if grid[r][c] is not None:
                continue
            wide = high = 1
            if rng.random() < 0.3:
                while c + wide < width and wide < 3 and grid[r][c + wide] is None:
                    wide += 1
            elif rng.random() < 0.3:
                high = rng.randint(1, height - r)
            text = f"{rng.choice(['a', 'b & c', 'x_1', '50%', 'é', '1.5'])} {r}{c}"
            for i in range(r, r + high):
                for j in range(c, c + wide):
                    grid[i][j] = text
            rows[r].append((c, text, wide, high))
    return rows, grid, width


def as_html(rows):
    out = []
    for row in rows:
        cells = []
        for _, text, wide, high in row:
            tag = "td" if len(text) % 2 else "th"
            spans = (f" colspan={wide}" if wide > 1 else "") + (f' rowspan="{high}" style="x"' if high > 1 else "")
            cells.append(f"<{tag}{spans}><span> {html.escape(text)}</span>\n</{tag}>")
        out.append(f"<tr class='r'>{''.join(cells)}</tr>")
    return f"<div>before</div><TABLE width=3><thead>{out[0]}</thead><tbody>{''.join(out[1:])}</tbody></TABLE> after"


def as_latex(rows, grid, width):
    out = []
    for r, row in enumerate(rows):
        starts, cells, c = {x[0]: x for x in row}, [], 0
        while c < width:
            if c in starts:
                _, text, wide, high = starts[c]
                for sign in "&%_":
                    text = text.replace(sign, "\\" + sign)
                text = rf"\textbf{{{text}}}" if len(text) % 2 else text
                text = rf"\multirow{{{high}}}{{*}}{{{text}}}" if high > 1 else text
                text = rf"\multicolumn{{{wide}}}{{|c|}}{{{text}}}" if wide > 1 else text
                cells.append(text)
                c += wide
            else:
                cells.append(" ")
                c += 1
        out.append(" & ".join(cells) + r" \\ \hline")
    return rf"\begin{{table}}[h] \centering \begin{{tabular}}{{{'l' * width}}} \toprule " + "\n".join(out) + r" \end{tabular}\end{table}"


def test_both_forms_are_equal():
    rng = random.Random(11)
    for _ in range(300):
        rows, grid, width = random_table(rng)
        a, b = as_html(rows), as_latex(rows, grid, width)
        # A row whose cells all start above is no row of its own in either form.
        if any(not row for row in rows):
            continue
        assert grids.grid_of(a) == grid
        assert grids.grid_of(b) == grid, b
        assert grids.normal_html(a) == grids.normal_html(b)
        assert table_similarity(grids.normal_html(a), grids.normal_html(b)) == 1.0


@pytest.mark.parametrize(
    "text, grid",
    [
        (None, []), ("", []), ("no table", []), ("<table></table>", []), ("<table><tr></tr></table>", []),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c", None]]),
        ("<table><tr><td colspan='x'>a</td><td rowspan=9>b</td></tr><tr><td>c</td></tr></table>", [["a", "b"], ["c", "b"]]),
        ("<table><tr><td>a<br>b <math alttext='y'><mi>z</mi></math></td></tr></table>", [["a b $y$"]]),
        ("<table><tr><td>a</td></tr></table> and <table><tr><td>b</td></tr></table>", [["a"], ["b"]]),
        ("<table><colgroup><col></colgroup><tr><td>ﬁ½&lt;</td></tr></table>", [["fi1⁄2<"]]),
        (r"\begin{tabular}{c} a \& b % note \end{tabular}", [["a & b"]]),
        (r"\begin{tabular}{l@{}p{2cm}} a & \multirow{2}{*}{b} \\[1pt] \cmidrule(lr){1-2} c & \\ \end{tabular}", [["a", "b"], ["c", "b"]]),
    ],
)
def test_odd_tables(text, grid):
    assert grids.grid_of(text) == grid


def test_columns(spark):
    df = spark.createDataFrame([("<table><tr><th>a</th></tr></table>",), (None,)], "t string")
    got = df.select(grids.table_html("t").alias("h"), grids.table_grid("t").alias("g")).collect()
    assert [tuple(r) for r in got] == [('<html><body><table border="1" ><tr><td>a</td></tr></table></body></html>', [["a"]]), ("", [])]
