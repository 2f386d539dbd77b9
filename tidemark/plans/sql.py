"""Common table expressions of the SQL twins."""

SIG = """
sig AS (SELECT vec_id AS signal_id, CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS role, label,
               list_transform(embedding, lambda v: v::DOUBLE) AS x,
               row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS idx FROM embeddings)
"""
S = SIG + ", s AS (SELECT signal_id, role, idx, unnest(range(len(x)))::BIGINT AS t, unnest(x) AS v FROM sig)"
LONG = """
parts AS (SELECT vec_id // 8 AS signal_id, list(list_transform(embedding, lambda v: v::DOUBLE) ORDER BY vec_id) AS p FROM embeddings GROUP BY 1),
lng AS (SELECT signal_id, CASE WHEN signal_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS role, list_concat(flatten(p), list_resize([]::DOUBLE[], (8 - len(p)) * len(p[1]), 0.0)) AS x,
               row_number() OVER (PARTITION BY signal_id % 2 ORDER BY signal_id) - 1 AS idx FROM parts),
l AS (SELECT signal_id, role, idx, unnest(range(len(x)))::BIGINT AS t, unnest(x) AS v FROM lng)
"""
CHAN = """
ch AS (SELECT vec_id // 4 AS sample_id, (vec_id % 4)::INTEGER AS channel, CASE WHEN (vec_id // 4) % 2 = 0 THEN 'real' ELSE 'synthetic' END AS role,
              list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
c AS (SELECT sample_id, channel, role, unnest(range(len(x)))::BIGINT AS t, unnest(x) AS v FROM ch)
"""


def r(expression: str, name: str | None = None) -> str:
    """A result to six digits: no NaN, no negative zero."""
    return f"round(CASE WHEN isfinite({expression}) THEN {expression} END, 6) + 0.0" + (f" AS {name}" if name else "")


def w1(values: str, keys: str) -> str:
    """Tables cmp_* with Wasserstein-1, Cliff's delta and U by keys, from values (keys, role, value)."""
    return f"""
cmp_v AS (SELECT {keys}, value AS v, count(*) FILTER (role = 'real') AS a, count(*) FILTER (role = 'synthetic') AS b FROM {values} WHERE isfinite(value) GROUP BY ALL),
cmp_r AS (SELECT *, sum(a) OVER w AS ra, sum(b) OVER w AS rb, lead(v) OVER w AS nv, sum(a) OVER k AS n1, sum(b) OVER k AS n2 FROM cmp_v
          WINDOW w AS (PARTITION BY {keys} ORDER BY v), k AS (PARTITION BY {keys})),
cmp AS (SELECT {keys}, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, sum(abs(ra / n1 - rb / n2) * (nv - v)) AS w1,
               sum(a * ((rb - b) - (n2 - rb))) / (max(n1) * max(n2)) AS delta, sum(a * ((rb - b) + b / 2)) AS u,
               sum((a + b)::DOUBLE * (a + b) * (a + b) - (a + b)) AS ties FROM cmp_r GROUP BY ALL)
"""
