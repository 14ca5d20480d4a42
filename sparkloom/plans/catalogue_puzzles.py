"""Checkers of puzzle solutions.  Grids are made from an event's number, some of them
wrong; the twins judge them cell by cell."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import puzzles
from .common import query

QUERIES: dict = {}


def _grid(n: int, cell: str):
    """An n by n grid of a Spark expression of id, r and c, a cell at a time: Spark compiles
    what stands in no lambda."""
    at = lambda r, c: re.sub(r"\bc\b", str(c), re.sub(r"\br\b", str(r), cell))
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"cast({at(r, c)} as int)" for c in range(n)) + ")" for r in range(n)) + ")")


def _cells(n: int, cell: str) -> str:
    return f"c AS (SELECT event_id AS id, r, c, CAST({cell.replace('id', 'event_id')} AS INTEGER) AS v FROM events, range({n}) a(r), range({n}) b(c))"


def _ids(read):
    return read("events").select(F.col("event_id").alias("id"))


def _names(rules: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in rules.items())
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',')"


def _shown(column):
    return F.array_join(column, ",").alias("broken")


# Right for most numbers; of every fourth a cell is overwritten.
_SUDOKU = "CASE WHEN id % 4 = 0 AND r = id % 9 AND c = floor(id / 9) % 9 THEN id % 9 + 1 ELSE (r % 3 * 3 + floor(r / 3) + c + id) % 9 + 1 END"
_GIVENS = "CASE WHEN (r * 9 + c + id) % 5 = 0 THEN (r % 3 * 3 + floor(r / 3) + c + id) % 9 + 1 ELSE 0 END"


@query(QUERIES, f"""WITH {_cells(9, _SUDOKU)}, g AS (SELECT id, r, c, CAST({_GIVENS} AS INTEGER) AS g FROM c),
 rr AS (SELECT id, min(n) AS n FROM (SELECT id, r, count(DISTINCT v) AS n FROM c GROUP BY ALL) GROUP BY id), cc AS (SELECT id, min(n) AS n FROM (SELECT id, c, count(DISTINCT v) AS n FROM c GROUP BY ALL) GROUP BY id),
 bb AS (SELECT id, min(n) AS n FROM (SELECT id, r // 3 AS a, c // 3 AS b, count(DISTINCT v) AS n FROM c GROUP BY ALL) GROUP BY id), gg AS (SELECT c.id, bool_and(g = 0 OR g = v) AS ok FROM c JOIN g ON c.id = g.id AND c.r = g.r AND c.c = g.c GROUP BY c.id)
 SELECT rr.id, {_names({"rows": "rr.n = 9", "columns": "cc.n = 9", "blocks": "bb.n = 9", "givens": "gg.ok"})} AS broken FROM rr JOIN cc USING (id) JOIN bb USING (id) JOIN gg USING (id)""")
def sudoku_rules(read):
    df = _ids(read).select("id", _grid(9, _SUDOKU).alias("g"), _grid(9, _GIVENS).alias("k"))
    return df.select("id", _shown(puzzles.sudoku(F.col("g"), F.col("k"))))


# Latin squares of five; of every third a row is turned, of every seventh a sign is wrong.
_LATIN = "CASE WHEN id % 3 = 0 AND r = id % 5 THEN (r * (1 + id % 4) + 4 - c + id) % 5 + 1 ELSE (r * (1 + id % 4) + c + id) % 5 + 1 END"
_LATIN_LINES = "rr AS (SELECT id, min(n) AS n FROM (SELECT id, r, count(DISTINCT v) AS n FROM c GROUP BY ALL) GROUP BY id), cc AS (SELECT id, min(n) AS n FROM (SELECT id, c, count(DISTINCT v) AS n FROM c GROUP BY ALL) GROUP BY id)"


@query(QUERIES, f"""WITH {_cells(5, _LATIN)}, {_LATIN_LINES},
 s AS (SELECT a.id, bool_and(CASE WHEN (a.v < b.v) = (a.id % 7 > 0 OR a.r <> a.id % 5) THEN a.v < b.v ELSE b.v < a.v END) AS ok FROM c a JOIN c b ON a.id = b.id AND a.r = b.r AND b.c = a.c + 1 WHERE (a.r + a.c + a.id) % 3 = 0 GROUP BY a.id)
 SELECT rr.id, {_names({"rows": "rr.n = 5", "columns": "cc.n = 5", "less": "coalesce(s.ok, true)"})} AS broken FROM rr JOIN cc USING (id) LEFT JOIN s USING (id)""")
def futoshiki_rules(read):
    """Signs between neighbours as the square has them, or, of every seventh, one row's
    the other way round."""
    df = _ids(read).select("id", _grid(5, _LATIN).alias("g"))
    place = "named_struct('r1', {}, 'c1', {}, 'r2', {}, 'c2', {})"
    none = "cast(array() as array<struct<r1: int, c1: int, r2: int, c2: int>>)"
    sign = lambda r, c: f"if(({r} + {c} + id) % 3 = 0, array(if((g[{r}][{c}] < g[{r}][{c + 1}]) = (id % 7 > 0 or {r} <> id % 5), {place.format(r, c, r, c + 1)}, {place.format(r, c + 1, r, c)})), {none})"
    signs = F.expr("concat(" + ", ".join(sign(r, c) for r in range(5) for c in range(4)) + ")")
    return df.select("id", _shown(puzzles.futoshiki(F.col("g"), signs, 5)))


_CLUE = "CASE WHEN (id + {0}) % 11 = 0 THEN 1 + (id + {0}) % 5 ELSE 0 END"


def _side(name: str, order: str, k: str) -> str:
    clue = _CLUE.format(k)
    line = "r" if name in ("lft", "rgt") else "c"
    return f"""{name} AS (SELECT id, bool_and(clue = 0 OR clue = seen) AS ok FROM (SELECT id, {line} AS k, any_value(CAST({clue.replace('{line}', line)} AS INTEGER)) AS clue, count(*) FILTER (v > before) AS seen
   FROM (SELECT *, coalesce(max(v) OVER (PARTITION BY id, {line} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) GROUP BY id, {line}) GROUP BY id)"""


@query(QUERIES, f"""WITH {_cells(5, _LATIN)}, {_LATIN_LINES}, {_side("lft", "c", "r")}, {_side("rgt", "c DESC", "(r + 1)")}, {_side("tp", "r", "(c + 2)")}, {_side("btm", "r DESC", "(c + 3)")}
 SELECT rr.id, {_names({"rows": "rr.n = 5", "columns": "cc.n = 5", "clues": "lft.ok AND rgt.ok AND tp.ok AND btm.ok"})} AS broken FROM rr JOIN cc USING (id) JOIN lft USING (id) JOIN rgt USING (id) JOIN tp USING (id) JOIN btm USING (id)""")
def skyscraper_rules(read):
    clues = [F.expr("array(" + ", ".join(f"cast({_CLUE.format(i + k)} as int)" for i in range(5)) + ")") for k in range(4)]
    df = _ids(read).select("id", _grid(5, _LATIN).alias("g"), *[x.alias(f"k{i}") for i, x in enumerate(clues)])
    return df.select("id", _shown(puzzles.skyscrapers(*[F.col(c) for c in ("g", "k0", "k1", "k2", "k3")], 5)))


# A right square, mirrored or inverted; of every third a cell is flipped, of every fifth
# a row is the one above.
_BITS = ["010011", "101100", "010101", "101010", "110010", "001101"]
_BIT = "(CAST(substr(CASE {row} " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BITS)) + " END, CAST({column} AS INT) + 1, 1) AS INT))"
_BINAIRO = "(" + _BIT.format(row="CASE WHEN id % 5 = 0 AND r = 3 THEN 2 ELSE r END", column="CASE WHEN id % 2 = 0 THEN c ELSE 5 - c END") + " + CASE WHEN id % 3 = 0 AND r = id % 6 AND c = floor(id / 6) % 6 THEN 1 ELSE 0 END + floor(id / 2)) % 2"


@query(QUERIES, f"""WITH {_cells(6, _BINAIRO)}, l AS (SELECT id, 'r' || r AS line, string_agg(v, '' ORDER BY c) AS s FROM c GROUP BY id, r UNION ALL SELECT id, 'c' || c, string_agg(v, '' ORDER BY r) FROM c GROUP BY id, c)
 SELECT id, {_names({"digits": "true", "halves": "bool_and(length(replace(s, '0', '')) = 3)", "three": "NOT bool_or(contains(s, '000') OR contains(s, '111'))", "alike": "count(DISTINCT s) FILTER (line[1] = 'r') = 6 AND count(DISTINCT s) FILTER (line[1] = 'c') = 6"})} AS broken FROM l GROUP BY id""")
def binairo_rules(read):
    return _ids(read).select("id", _grid(6, _BINAIRO).alias("g")).select("id", _shown(puzzles.binairo(F.col("g"), 6)))


_MARKS = "floor((id * 7 + r * 13 + c * 29 + r * c) / 3) % 2"


@query(QUERIES, f"""WITH {_cells(5, _MARKS)}, rr AS (SELECT id, bool_and(s = s + CASE WHEN id % 5 = r THEN id % 2 ELSE 0 END) AS ok FROM (SELECT id, r, sum(v * (c + 1)) AS s FROM c GROUP BY ALL) GROUP BY id),
 cc AS (SELECT id, bool_and(s = s + CASE WHEN id % 7 = c THEN 1 ELSE 0 END) AS ok FROM (SELECT id, c, sum(v * (r + 1)) AS s FROM c GROUP BY ALL) GROUP BY id)
 SELECT rr.id, {_names({"digits": "true", "rows": "rr.ok", "columns": "cc.ok"})} AS broken FROM rr JOIN cc USING (id)""")
def kakurasu_rules(read):
    """Sums that are right but for some rows and columns."""
    df = _ids(read).select("id", _grid(5, _MARKS).alias("g"))
    total = lambda terms: " + ".join(terms)
    rows = F.expr("array(" + ", ".join(total(f"g[{i}][{j}] * {j + 1}" for j in range(5)) + f" + if(id % 5 = {i}, cast(id % 2 as int), 0)" for i in range(5)) + ")")
    columns = F.expr("array(" + ", ".join(total(f"g[{i}][{j}] * {i + 1}" for i in range(5)) + f" + if(id % 7 = {j}, 1, 0)" for j in range(5)) + ")")
    return df.select("id", _shown(puzzles.kakurasu(F.col("g"), rows, columns, 5)))


_NUMBERED = "CASE WHEN (r * 5 + c + id) % 11 = 0 THEN (r + id) % 5 + 1 ELSE (r * 2 + c) % 5 + 1 END"
_BLACK = "CASE WHEN ((r * 5 + c + id) % 11 = 0 AND id % 5 > 0) OR (id % 4 = 0 AND r + c = 1) OR (id % 9 = 0 AND r = 2 AND c > 2) THEN 1 ELSE 0 END"


@query(QUERIES, f"""WITH RECURSIVE {_cells(5, _NUMBERED)}, b AS (SELECT id, r, c, v, CAST({_BLACK} AS INTEGER) AS x FROM c),
 reach(id, r, c) AS (SELECT id, min(r * 5 + c) // 5, min(r * 5 + c) % 5 FROM b WHERE x = 0 GROUP BY id UNION SELECT b.id, b.r, b.c FROM reach a JOIN b ON b.id = a.id AND abs(b.r - a.r) + abs(b.c - a.c) = 1 AND b.x = 0),
 n AS (SELECT id, count(*) AS n FROM reach GROUP BY id), w AS (SELECT id, count(*) FILTER (x = 0) AS n FROM b GROUP BY id),
 d AS (SELECT id, bool_and(ok) AS ok FROM (SELECT id, count(DISTINCT v) FILTER (x = 0) = count(*) FILTER (x = 0) AS ok FROM b GROUP BY id, r UNION ALL SELECT id, count(DISTINCT v) FILTER (x = 0) = count(*) FILTER (x = 0) FROM b GROUP BY id, c) GROUP BY id),
 s AS (SELECT DISTINCT a.id FROM b a JOIN b q ON a.id = q.id AND a.x = 1 AND q.x = 1 AND abs(q.r - a.r) + abs(q.c - a.c) = 1)
 SELECT w.id, {_names({"differ": "d.ok", "beside": "w.id NOT IN (SELECT id FROM s)", "connected": "w.n = coalesce(n.n, 0)"})} AS broken FROM w JOIN d USING (id) LEFT JOIN n USING (id)""")
def hitori_rules(read):
    df = _ids(read).select("id", _grid(5, _NUMBERED).alias("g"), _grid(5, _BLACK).alias("b"))
    return df.select("id", _shown(puzzles.hitori(F.col("g"), F.col("b"), 5)))
