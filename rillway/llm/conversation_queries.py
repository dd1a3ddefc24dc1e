"""Query of the operator on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.conversation_repair import no_summary, repair, summarise
from rillway.llm.registry import query
from rillway.sources.tables import read_folder_table as table


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn; nulls are one space.

    0 in 20 drops a row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes
    it the user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text")).withColumn(
        "how", F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    )
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("how <> 0").select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


_CRC_BYTE = "list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b))"


def _state(q: int, moves: list[str]) -> str:
    kept = ", ".join(moves)
    return f"list_sort(list_filter([{kept}], lambda m: m.cost IS NOT NULL))[1] AS s{q}"


def _move(p: int, edits: str, cost: str, out: str, when: str = "true") -> str:
    """The survivor of state p with more edits; no cost where there is none or it does not apply."""
    return (
        f"struct_pack(cost := CASE WHEN {when} THEN s{p}.cost + {cost} END, audit := s{p}.audit || '{edits}', "
        f"out := s{p}.out || {out})"
    )


def _oracle() -> str:
    """The same search by a recursive query that carries four whole survivors per conversation."""
    keep, user, assistant = "[r.role || ':' || r.text]", "['user:' || r.text]", "['assistant:' || r.text]"
    free, t = "NOT r.gone", "r.cut"
    i = {"u": "'user:'", "a": "'assistant:'"}
    moves: dict[int, list[str]] = {q: [_move(q, "D", "3", "[]::VARCHAR[]")] for q in range(4)}
    moves[1].append(_move(0, "K", t, keep, f"{free} AND r.i = 's'"))
    for p, q, letter, role in ((0, 2, "u", user), (1, 2, "u", user), (2, 3, "a", assistant), (3, 2, "u", user)):
        moves[q].append(_move(p, "K", t, keep, f"{free} AND r.i = '{letter}'"))
        moves[q].append(_move(p, "R", f"2 + {t}", role, free))
        # An inserted turn goes before: the row then takes the role after it.
        other, then, at = ("a", assistant, 3) if q == 2 else ("u", user, 2)
        moves[at].append(_move(p, "IK", f"2 + {t}", f"list_concat([{i[letter]}], {keep})", f"{free} AND r.i = '{other}'"))
        moves[at].append(_move(p, "IR", f"4 + {t}", f"list_concat([{i[letter]}], {then})", free))
    none = "NULL::STRUCT(cost BIGINT, audit VARCHAR, out VARCHAR[])"
    first = "struct_pack(cost := 0::BIGINT, audit := '', out := []::VARCHAR[])"
    closed = (
        "[s0, struct_pack(cost := s1.cost + 4, audit := s1.audit || 'II', out := s1.out || ['user:', 'assistant:']), "
        "struct_pack(cost := s2.cost + 2, audit := s2.audit || 'I', out := s2.out || ['assistant:']), s3]"
    )
    step = ", ".join(_state(q, moves[q]) for q in range(4))
    return rf"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {_CRC_BYTE}, 4294967295), 4294967295) % 20 AS how
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE how <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, left(role, 1) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM d),
f AS (
  SELECT *, body = '' AS blank, body <> '' AND seen AS duplicate, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    coalesce((lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM o),
r AS (SELECT conv_id, n, role, text, i, blank OR duplicate AS gone, CAST(truncated AS BIGINT) AS cut FROM f),
v AS (
  SELECT conv_id, 0::BIGINT AS done, {first} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT r.conv_id, r.n, {step} FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.n = v.done + 1),
e AS (
  SELECT conv_id, list_sort(list_filter({closed}, lambda m: m.cost IS NOT NULL))[1] AS s
  FROM v WHERE done = (SELECT max(n) FROM r WHERE r.conv_id IS NOT DISTINCT FROM v.conv_id)),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.cost, 0) AS BIGINT) AS cost,
  coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query(_oracle())
def op11_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = summarise(repair(damage(turns)))
    every = turns.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *no_summary(found))
