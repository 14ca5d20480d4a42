"""Puzzle rules on known solutions, wrong shapes and nulls."""

from pyspark.sql import functions as F

from sparkloom.functions import puzzles


def broken(spark, rule, *grids):
    df = spark.createDataFrame([grids], ", ".join(f"g{i} array<array<int>>" for i in range(len(grids))))
    return df.select(rule(*[F.col(f"g{i}") for i in range(len(grids))]).alias("b")).first().b


SOLVED = [[(r % 3 * 3 + r // 3 + c) % 9 + 1 for c in range(9)] for r in range(9)]
NONE = [[0] * 9 for _ in range(9)]


def test_sudoku(spark):
    assert broken(spark, puzzles.sudoku, SOLVED, NONE) == []
    assert broken(spark, puzzles.sudoku, SOLVED, SOLVED) == []
    other = [row[:] for row in SOLVED]
    other[0], other[3] = other[3], other[0]  # rows and columns stay right
    assert broken(spark, puzzles.sudoku, other, NONE) == ["blocks"]
    assert broken(spark, puzzles.sudoku, other, SOLVED) == ["blocks", "givens"]
    for bad in (None, SOLVED[:8], [r[:8] for r in SOLVED], [*SOLVED[:8], [None] * 9]):
        assert broken(spark, puzzles.sudoku, bad, NONE) == ["shape"]


def test_connected_cells(spark):
    cases = [([[1, 1, 1], [0, 0, 1], [1, 1, 1]], True), ([[1, 0, 1], [1, 0, 1], [1, 0, 1]], False), ([[0] * 3] * 3, True), ([[1, 0, 0], [0, 1, 0], [0, 0, 1]], False), ([[0, 0, 0], [0, 1, 0], [0, 0, 0]], True)]
    for grid, want in cases:
        df = spark.createDataFrame([([[bool(v) for v in r] for r in grid],)], "g array<array<boolean>>")
        assert df.select(puzzles.connected(F.col("g"), 3)).first()[0] is want


def test_a_spiral_is_followed_to_its_end(spark):
    n = 7
    grid, r, c, dr, dc = [[False] * n for _ in range(n)], 0, 0, 0, 1
    for _ in range(24):
        grid[r][c] = True
        ahead, beyond = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
        free = 0 <= ahead[0] < n and 0 <= ahead[1] < n and not (0 <= beyond[0] < n and 0 <= beyond[1] < n and grid[beyond[0]][beyond[1]])
        if not free:
            dr, dc = dc, -dr
        r, c = r + dr, c + dc
    df = spark.createDataFrame([(grid,)], "g array<array<boolean>>")
    assert df.select(puzzles.connected(F.col("g"), n)).first()[0] is True


def test_binairo_and_hitori(spark):
    good = [[int(x) for x in row] for row in ["010011", "101100", "010101", "101010", "110010", "001101"]]
    rule = lambda g: puzzles.binairo(g, 6)
    assert broken(spark, rule, good) == []
    assert broken(spark, rule, [good[0], good[0], *good[2:]]) != []
    assert "digits" in broken(spark, rule, [[2] * 6, *good[1:]])
    numbers = [[1, 2, 1], [2, 3, 1], [3, 1, 2]]
    hitori = lambda n, b: puzzles.hitori(n, b, 3)
    assert broken(spark, hitori, numbers, [[0] * 3] * 3) == ["differ"]
    assert broken(spark, hitori, numbers, [[0, 0, 1], [0, 0, 0], [0, 0, 0]]) == []
    assert broken(spark, hitori, numbers, [[0, 0, 1], [0, 0, 1], [0, 0, 0]]) == ["beside"]
    assert broken(spark, hitori, [[1, 2, 3], [2, 3, 1], [3, 1, 2]], [[0, 1, 0], [1, 0, 0], [0, 0, 0]]) == ["connected"]
