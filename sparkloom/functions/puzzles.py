"""Rules of grid puzzles over solutions as arrays of rows, as column expressions.

Each function gives the names of the rules that a solution breaks, so an empty array
is a right solution.  A rule is some thousand steps for each grid, which Spark would
interpret one by one; here the grids of an Arrow batch are judged at once as one array.
A grid of another shape, or null, breaks the rule ``shape`` alone.  Arguments are columns
or expressions without lambdas: Spark 4.1 failed to plan some with lambdas here.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(lists, n: int):
    """Which arrays of a batch have n elements, these (0 for null, and in other arrays),
    and which of them are null."""
    sizes, values = np.asarray(lists.value_lengths().fill_null(0)), lists.flatten().cast("int64")
    fits = sizes == n
    taken = np.repeat(fits, sizes)
    cells, null = np.zeros((len(sizes), n), dtype=np.int64), np.zeros((len(sizes), n), dtype=bool)
    cells[fits] = np.asarray(values.fill_null(0))[taken].reshape(-1, n)
    null[fits] = np.asarray(values.is_null().to_numpy(zero_copy_only=False))[taken].reshape(-1, n)
    return fits, cells, null


def _cells(grids, n: int):
    """``_lines`` of n by n grids."""
    rows_fit, rows, null = _lines(grids.flatten(), n)
    sizes = np.asarray(grids.value_lengths().fill_null(0))
    of = np.repeat(np.arange(len(sizes)), sizes)
    fits = sizes == n
    fits &= np.bincount(of[~rows_fit], minlength=len(sizes)) == 0
    taken = fits[of]
    out, out_null = np.zeros((len(sizes), n, n), dtype=np.int64), np.zeros((len(sizes), n, n), dtype=bool)
    out[fits], out_null[fits] = rows[taken].reshape(-1, n, n), null[taken].reshape(-1, n, n)
    return fits, out, out_null


def _broken(n: int, names: list[str], judge, grid: Column, *others: Column) -> Column:
    """Names of broken rules of n by n grids: ``judge`` gives for each name which of the
    cells' grids break it."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def judged(grids, *rest):
        import pyarrow as pa

        fits, cells, null = _cells(grids, n)
        fits &= ~null.any(axis=(1, 2))
        found = np.stack([*(fits & bad for bad in judge(cells, *rest)), ~fits], axis=1)
        offsets = np.concatenate([[0], found.sum(axis=1).cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([*names, "shape"]).take(pa.array(np.nonzero(found)[1])))

    return judged(grid, *others)


def _turned(cells):
    """The columns of grids as rows."""
    return cells.transpose(0, 2, 1)


def _not_each_once(lines):
    """Which grids have a line that lacks one of 1 to n."""
    return (np.sort(lines, axis=2) != np.arange(1, lines.shape[2] + 1)).any(axis=(1, 2))


def sudoku(grid: Column, givens: Column, size: int = 3) -> Column:
    """``givens``: numbers that a grid must have, 0 for none; givens of another shape are
    not kept."""
    n = size * size

    def judge(cells, given):
        fits, g, null = _cells(given, n)
        blocks = cells.reshape(-1, size, size, size, size).transpose(0, 1, 3, 2, 4).reshape(-1, n, n)
        kept = fits & (~null & ((g == 0) | (g == cells))).all(axis=(1, 2))
        return _not_each_once(cells), _not_each_once(_turned(cells)), _not_each_once(blocks), ~kept

    return _broken(n, ["rows", "columns", "blocks", "givens"], judge, grid, givens)


def futoshiki(grid: Column, less: Column, n: int) -> Column:
    """``less``: an array of (r1, c1, r2, c2), the first cell smaller than the second."""

    def judge(cells, signs):
        sizes, places = np.asarray(signs.value_lengths().fill_null(0)), signs.flatten()
        at = np.stack([np.asarray(places.field(k).fill_null(-1), dtype=np.int64) for k in ("r1", "c1", "r2", "c2")], axis=1)
        at[places.is_null().to_numpy(zero_copy_only=False)] = -1
        of = np.repeat(np.arange(len(sizes)), sizes)
        there = ((at >= 0) & (at < n)).all(axis=1)
        r1, c1, r2, c2 = np.where(there[:, None], at, 0).T
        held = there & (cells[of, r1, c1] < cells[of, r2, c2])
        bad = (np.bincount(of[~held], minlength=len(sizes)) > 0) | signs.is_null().to_numpy(zero_copy_only=False)
        return _not_each_once(cells), _not_each_once(_turned(cells)), bad

    return _broken(n, ["rows", "columns", "less"], judge, grid, less)


def _seen(lines):
    """How many numbers of each line are larger than all before them."""
    before = np.maximum.accumulate(lines, axis=2)[:, :, :-1]
    return (lines[:, :, 1:] > np.maximum(before, 0)).sum(axis=2) + (lines[:, :, 0] > 0)


def skyscrapers(grid: Column, left: Column, right: Column, top: Column, bottom: Column, n: int) -> Column:
    """Clues are how many towers are seen from a side; 0 is no clue.  A side with more or
    fewer clues than lines is broken."""

    def judge(cells, *sides):
        bad = np.zeros(len(cells), dtype=bool)
        down = _turned(cells)
        for side, lines in zip(sides, (cells, cells[:, :, ::-1], down, down[:, :, ::-1]), strict=True):
            fits, clues, null = _lines(side, n)
            bad |= ~fits | (null | ((clues != 0) & (clues != _seen(lines)))).any(axis=1)
        return _not_each_once(cells), _not_each_once(down), bad

    return _broken(n, ["rows", "columns", "clues"], judge, grid, left, right, top, bottom)


def binairo(grid: Column, n: int) -> Column:
    """Zeros and ones: as many of each in every line, never three alike in a row, no two
    rows and no two columns the same."""

    def judge(cells):
        both = (cells, _turned(cells))
        digits = ((cells != 0) & (cells != 1)).any(axis=(1, 2))
        uneven, three, alike = (np.zeros(len(cells), dtype=bool) for _ in range(3))
        for lines in both:
            uneven |= (lines.sum(axis=2) * 2 != n).any(axis=1)
            three |= ((lines[:, :, 2:] == lines[:, :, 1:-1]) & (lines[:, :, 1:-1] == lines[:, :, :-2])).any(axis=(1, 2))
            for i, j in combinations(range(n), 2):
                alike |= (lines[:, i] == lines[:, j]).all(axis=1)
        return digits, uneven, three, alike

    return _broken(n, ["digits", "halves", "three", "alike"], judge, grid)


def kakurasu(grid: Column, rows: Column, columns: Column, n: int) -> Column:
    """Marks 0 or 1: a mark weighs its place, 1 to n, in its row's and its column's sum.
    More or fewer sums than lines are broken."""

    def judge(cells, *sums):
        out = [((cells != 0) & (cells != 1)).any(axis=(1, 2))]
        for side, lines in zip(sums, (cells, _turned(cells)), strict=True):
            fits, wanted, null = _lines(side, n)
            out.append(~fits | (null | (lines @ np.arange(1, n + 1) != wanted)).any(axis=1))
        return out

    return _broken(n, ["digits", "rows", "columns"], judge, grid, rows, columns)


def _hang_together(free):
    """Which grids' true cells hang together: the reached cells grow by their neighbours
    until none is new."""
    n = free.shape[1]
    flat = free.reshape(-1, n * n)
    reached = np.zeros((len(free), n + 2, n + 2), dtype=bool)
    inner = reached[:, 1:-1, 1:-1]
    first = flat.argmax(axis=1)
    inner[np.arange(len(free)), first // n, first % n] = flat.any(axis=1)
    before, now = -1, int(reached.sum())
    while before != now:
        inner |= (reached[:, :-2, 1:-1] | reached[:, 2:, 1:-1] | reached[:, 1:-1, :-2] | reached[:, 1:-1, 2:]) & free
        before, now = now, int(reached.sum())
    return (inner == free).all(axis=(1, 2))


def connected(open_cells: Column, n: int) -> Column:
    """Whether the true cells of an n by n grid hang together over sides; without a true
    cell they do.  Null cells are not open; a grid of another shape does not hang together."""

    @F.arrow_udf(T.BooleanType())
    def judged(grids):
        import pyarrow as pa

        fits, cells, _ = _cells(grids, n)
        return pa.array(fits & _hang_together(cells == 1))

    return judged(open_cells)


def hitori(numbers: Column, black: Column, n: int) -> Column:
    """Black cells (1): numbers left in a line differ, no two black cells share a side, the
    others hang together."""

    def judge(marks, given):
        fits, values, null = _cells(given, n)
        left = (marks == 0) & ~null & fits[:, None, None]
        same, beside = (np.zeros(len(marks), dtype=bool) for _ in range(2))
        for v, w, x in ((values, left, marks == 1), (_turned(values), _turned(left), _turned(marks == 1))):
            for i, j in combinations(range(n), 2):
                same |= ((v[:, :, i] == v[:, :, j]) & w[:, :, i] & w[:, :, j]).any(axis=1)
            beside |= (x[:, :, 1:] & x[:, :, :-1]).any(axis=(1, 2))
        return same, beside, ~_hang_together(marks == 0)

    return _broken(n, ["differ", "beside", "connected"], judge, black, numbers)
