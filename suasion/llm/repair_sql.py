"""The repair of damaged conversations in DuckDB SQL: the same contract by a recursive query that carries
every state's cheapest (cost, audit, repaired text) as a value."""


def _edit(state: str, cost: str, initial: str, line: str | None, when: str = "true") -> str:
    """The value of ``state`` after one more edit, null where it can't be."""
    text = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
    return (f"CASE WHEN {state} IS NOT NULL AND {when} THEN "
            f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{initial}', r := {text}) END")


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _step() -> str:
    stays = "NOT gone"
    cost = "CASE WHEN cut THEN 1 ELSE 0 END"
    gone = {s: _edit(s, "3", "D", None) for s in ("q0", "q1", "q2", "q3")}

    def kept(state: str, initial: str) -> str:
        return _edit(state, cost, "K", "role || ':' || text", f"{stays} AND left(role, 1) = '{initial}'")

    def given(state: str, role: str) -> str:
        return _edit(state, f"2 + {cost}", "R", f"'{role}:' || text", stays)
    return f"""SELECT g, i, {gone['q0']} AS b0, {_least(gone['q1'], kept('q0', 's'))} AS b1,
       {_least(gone['q2'], *[f(s, x) for s in ('q0', 'q1', 'q3') for f, x in ((kept, 'u'), (given, 'user'))])} AS b2,
       {_least(gone['q3'], kept('q2', 'a'), given('q2', 'assistant'))} AS b3"""


def _inserted(table: str) -> str:
    user, assistant = "'user:'", "'assistant:'"
    reached = _least("b2", _edit("b0", "2", "I", user), _edit("b1", "2", "I", user))
    return f"""SELECT g, i, b0 AS q0, b1 AS q1, {_least('reached', _edit('b3', '2', 'I', user))} AS q2,
       {_least('b3', _edit('reached', '2', 'I', assistant))} AS q3
FROM (SELECT *, {reached} AS reached FROM {table})"""


_START = "struct_pack(c := 0, a := '', r := '')"
_VALUE = "STRUCT(c INTEGER, a VARCHAR, r VARCHAR)"

REPAIR_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda p:
           [ascii(k[p])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS code FROM keyed),
convs AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
damaged AS (
  SELECT g, c.conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM coded c JOIN convs v ON c.conv_id IS NOT DISTINCT FROM v.conv_id,
       LATERAL (SELECT unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy)
  WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS repeated,
                lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM placed),
faults AS (SELECT *, t = '' AS blank, t <> '' AND repeated AS duplicate, t = '' OR repeated AS gone,
                  t <> '' AND NOT repeated AND right(t, 1) NOT IN ('.', '!', '?') AS cut FROM seen),
walk AS (
  SELECT * FROM ({_inserted(f"(SELECT g, 0::BIGINT AS i, {_START}::{_VALUE} AS b0, NULL::{_VALUE} AS b1, NULL::{_VALUE} AS b2, NULL::{_VALUE} AS b3 FROM convs)")})
  UNION ALL
  SELECT * FROM ({_inserted(f"({_step()} FROM (SELECT f.*, q0, q1, q2, q3 FROM walk w JOIN faults f ON f.g = w.g AND f.i = w.i + 1))")})),
finished AS (SELECT g, CASE WHEN q0 IS NOT NULL AND struct_pack(c := q0.c, a := q0.a) < struct_pack(c := q3.c, a := q3.a) THEN q0 ELSE q3 END AS best
             FROM walk QUALIFY i = max(i) OVER (PARTITION BY g)),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
                  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
       sha256(substr(best.r, 2)) AS repaired_sha256
FROM convs JOIN finished USING (g) LEFT JOIN counts USING (g)"""
