"""Query op13: damaged conversations and their cheapest repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read, stored
from tidemark.llm.repair import audited, damaged


def op13_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(stored(damaged(read(spark, sf_dir, "conversations")), "damaged"))


def _node(cost: str, audit: str, out: str) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'a': {audit}, 'o': {out}}}"


FAR = _node("1000000000", "''", "''")


def _delete(s: str) -> str:
    return _node(f"{s}.c + 4", f"{s}.a || 'D'", f"{s}.o")


def _insert(s: str, role: str) -> str:
    return _node(f"{s}.c + 3", f"{s}.a || 'I'", f"{s}.o || chr(10) || '{role}:'")


def _stay(s: str, role: str) -> str:
    same = f"x.ini = '{role[0]}'"
    return _node(f"{s}.c + CASE WHEN {same} THEN 0 ELSE 3 END + CASE WHEN x.cut THEN 3 ELSE 0 END", f"{s}.a || CASE WHEN {same} THEN 'K' ELSE 'R' END", f"{s}.o || chr(10) || CASE WHEN {same} THEN x.role ELSE '{role}' END || ':' || x.text")


def _closed(n: str) -> str:
    """Nodes after inserts, from the nodes behind a row."""
    user = f"least({n}.n2, {_insert(f'{n}.n0', 'user')}, {_insert(f'{n}.n1', 'user')}, {_insert(f'{n}.n3', 'user')})"
    return f"list_transform([{{'u': {user}}}], lambda e: {{'n0': {n}.n0, 'n1': {n}.n1, 'n2': e.u, 'n3': least({n}.n3, {_insert('e.u', 'assistant')})}})[1]"


def _if_kept(value: str, more: str = "") -> str:
    return f"CASE WHEN NOT x.gone {more} THEN {value} ELSE {FAR} END"


_FIRST = f"list_transform([{{'n0': {_node('0', chr(39) * 2, chr(39) * 2)}, 'n1': {FAR}, 'n2': {FAR}, 'n3': {FAR}}}], lambda m: {_closed('m')})[1]"
_BEST = "list_transform([least(s.n0, s.n1, s.n3)], lambda b: " + _stay("b", "user") + ")[1]"
_STEP = (
    f"list_transform([{{'n0': {_delete('s.n0')}, 'n1': least({_delete('s.n1')}, {_if_kept(_stay('s.n0', 'system'), 'AND x.ini = ' + chr(39) + 's' + chr(39))}), "
    f"'n2': least({_delete('s.n2')}, {_if_kept(_BEST)}), 'n3': least({_delete('s.n3')}, {_if_kept(_stay('s.n2', 'assistant'))})}}], lambda m: {_closed('m')})[1]"
)

#: The lattice row by row: the best (cost, audit, text so far) of each state of the grammar, folded over a conversation's rows.
SQL = rf"""
WITH k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda d, i: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END, xor(c, b)), CAST(4294967295 AS BIGINT))) % 20 AS f
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE f <> 0
), o AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy)
), p AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair, NOT blank AND again AS repeated, NOT blank AND NOT again AND open_end AS cut FROM o
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (repeated) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list_reduce(list({{'ini': ini, 'gone': blank OR repeated, 'cut': cut, 'role': role, 'text': text}} ORDER BY i), lambda s, x: {_STEP}, {_FIRST}) AS s
  FROM p GROUP BY conv_id
), e AS (
  SELECT *, least(s.n0, s.n3) AS best FROM g
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
