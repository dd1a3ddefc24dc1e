"""SQL that states the differences of two lists of lines independently of the operator."""

from __future__ import annotations


def aligned_sql(name: str, pairs: str) -> str:
    """CTEs ending in ``name``: pairs (k, block, i, j) of the longest chains, by the number each could still reach."""
    same = "n.k = s.k AND n.block = s.block"
    return f"""
    {name}_n AS (SELECT *, row_number() OVER (PARTITION BY k, block ORDER BY i) AS up,
                        row_number() OVER (PARTITION BY k, block ORDER BY i DESC) AS down FROM ({pairs})),
    {name}_s AS (
      SELECT k, block, i, j, up, down, 1 AS reach, [struct_pack(j := j, reach := 1)] AS later FROM {name}_n WHERE down = 1
      UNION ALL
      SELECT k, block, i, j, up, down, reach, list_append(later, struct_pack(j := j, reach := reach)) FROM (
        SELECT n.*, s.later, 1 + coalesce(list_max(list_transform(list_filter(s.later, lambda x: x.j > n.j), lambda x: x.reach)), 0) AS reach
        FROM {name}_s s JOIN {name}_n n ON {same} AND n.down = s.down + 1)),
    {name}_g AS (
      SELECT k, block, 0::BIGINT AS up, -1::BIGINT AS i, -1::BIGINT AS j, max(reach) AS need, -1::BIGINT AS last, false AS taken
      FROM {name}_s GROUP BY k, block
      UNION ALL
      SELECT k, block, up, i, j, CASE WHEN fits THEN need - 1 ELSE need END, CASE WHEN fits THEN j ELSE last END, fits FROM (
        SELECT n.k, n.block, n.up, n.i, n.j, s.need, s.last, n.reach = s.need AND n.j > s.last AS fits
        FROM {name}_g s JOIN {name}_s n ON {same} AND n.up = s.up + 1)),
    {name} AS (SELECT k, i, j FROM {name}_g WHERE taken)"""


def stretches_sql(kept: str) -> str:
    return f"""
      SELECT * FROM (
        SELECT k, i + 1 AS i1, lead(i) OVER w AS i2, j + 1 AS j1, lead(j) OVER w AS j2 FROM (
          {kept} UNION ALL SELECT k, head - 1, head - 1 FROM d UNION ALL SELECT k, nb - tail, na - tail FROM d)
        WINDOW w AS (PARTITION BY k ORDER BY i, j))
      WHERE i2 > i1 OR j2 > j1"""


def lines_sql(side: str, at: str) -> str:
    """Lines of one side in the stretches with lines on both, with the number of their copy."""
    return f"""
      SELECT l.k, c.i1 AS block, line, l.{at}, row_number() OVER (PARTITION BY l.k, c.i1, line ORDER BY l.{at}) AS copy
      FROM {side} l JOIN once_c c ON l.k = c.k AND l.{at} >= c.{at}1 AND l.{at} < c.{at}2 AND c.i2 > c.i1 AND c.j2 > c.j1"""


_RANGE = "CASE WHEN {1} = 1 THEN CAST({0} + 1 AS VARCHAR) WHEN {1} = 0 THEN {0} || ',0' ELSE ({0} + 1) || ',' || {1} END"


def without_last_blank(lines: str) -> str:
    """A final line end opens no further line."""
    return f"CASE WHEN {lines}[-1] = '' THEN {lines}[:-2] ELSE {lines} END"


def diff_sql(texts: str) -> str:
    """(k, seq, hunk, pos, rule, line) for texts (k, b, a), lists of lines before and after."""
    return f"""
    WITH RECURSIVE y AS (SELECT *, len(b) AS nb, len(a) AS na, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda m: a[1:m] = b[1:m])) AS head FROM ({texts})),
    d AS (SELECT *, len(list_filter(range(1, least(na, nb) - head + 1), lambda m: a[na - m + 1:] = b[nb - m + 1:])) AS tail FROM y),
    o AS (SELECT k, i, b[i + 1] AS line FROM (SELECT *, unnest(range(head, nb - tail)) AS i FROM d)),
    n AS (SELECT k, j, a[j + 1] AS line FROM (SELECT *, unnest(range(head, na - tail)) AS j FROM d)),
    one AS (
      SELECT k, 0 AS block, i, j FROM (SELECT k, line, min(i) AS i FROM o GROUP BY 1, 2 HAVING count(*) = 1)
      JOIN (SELECT k, line, min(j) AS j FROM n GROUP BY 1, 2 HAVING count(*) = 1) USING (k, line)),
    {aligned_sql("once", "SELECT * FROM one")},
    once_c AS ({stretches_sql("SELECT k, i, j FROM once")}),
    two AS (SELECT k, block, i, j FROM ({lines_sql("o", "i")}) JOIN ({lines_sql("n", "j")}) USING (k, block, line, copy)),
    {aligned_sql("copies", "SELECT * FROM two")},
    c AS ({stretches_sql("SELECT k, i, j FROM once UNION ALL SELECT k, i, j FROM copies")}),
    h AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY i1, j1) AS hunk FROM (
      SELECT *, CASE WHEN i1 - lag(i2) OVER (PARTITION BY k ORDER BY i1, j1) <= 6 THEN 0 ELSE 1 END AS opens FROM c)),
    g AS (SELECT *, greatest(i1 - 3, 0) AS p, greatest(j1 - 3, 0) AS q, least(3, nb - i2) AS rest FROM (
      SELECT k, hunk, min(i1) AS i1, min(j1) AS j1, max(i2) AS i2, max(j2) AS j2 FROM h GROUP BY 1, 2) JOIN d USING (k)),
    r AS (
      SELECT k, p + q - 1 AS seq, hunk, p AS pos, 'HUNK' AS rule,
             '@@ -' || {_RANGE.format("p", "(i2 + rest - p)")} || ' +' || {_RANGE.format("q", "(j2 + rest - q)")} || ' @@' AS line FROM g
      UNION ALL
      SELECT k, i + j1, hunk, i, 'DIFF_DELETE', b[i + 1] FROM (SELECT *, unnest(range(i1, i2)) AS i FROM h) JOIN d USING (k)
      UNION ALL
      SELECT k, i2 + j, hunk, j, 'DIFF_INSERT', a[j + 1] FROM (SELECT *, unnest(range(j1, j2)) AS j FROM h) JOIN d USING (k))
    SELECT k, CAST(seq AS INTEGER) AS seq, CAST(hunk AS INTEGER) AS hunk, CAST(pos AS INTEGER) AS pos, rule, line FROM r
"""
