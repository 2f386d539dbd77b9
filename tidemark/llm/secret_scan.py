"""Secret scans, in DataFrame functions only.

Three base patterns find what looks like a secret by its form. Two first-order Markov models of characters find the rest:
one of random strings, one of ordinary identifiers, trained from labelled samples. A run of token characters is reported
where its log-likelihood ratio, summed over its transitions in thousandths of a nat, reaches a threshold.

Labels come from the documents themselves: what the base patterns find is random, other tokens in which no letter stands next
to a digit are ordinary; the rest has no label. Both models count all documents; only the table of 128 x 128 ratios goes through the driver, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: The base patterns of the contract, with their least lengths put in. Classes instead of a flag for either case: all engines agree.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 8

#: Tokens that train the ordinary model, and those that are judged.
TRAINED = r"[A-Za-z0-9_+/=-]{8,}"
UNLABELLED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
JUDGED = r"[A-Za-z0-9_+/=-]{16,}"
SYMBOLS = 66
#: Weights of the uniform distribution in the random and in the ordinary model; they bound what one transition can say at any size.
RANDOM_UNIFORM, ORDINARY_UNIFORM = 0.5, 0.02
#: Thousandths of a nat: random strings have to be e^20 times as likely.
THRESHOLD = 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    """Sums of all values before each, and of all at the end."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))


def _offsets(lengths: Column) -> Column:
    """Sums of all lengths before each, in chunks of about the root of their number, so that no long array is copied at every step."""

    def chunked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))

        def placed(c: Column) -> Column:
            totals = _running(F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)))
            return _let(totals, lambda t: F.flatten(F.transform(c, lambda x, k: F.transform(F.slice(_running(x), 1, F.size(x)), lambda s: s + F.get(t, k)))))

        return _let(chunks, placed)

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_let(lengths, chunked))


def _matches(text: Column, pattern: str, least: int = 0) -> Column:
    """All matches, leftmost first and apart: pieces between them, and for each start and end in code points, and whether it counts
    (second group of `least` characters or more)."""

    def placed(pieces: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        valid = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole

        def spans(found: Column) -> Column:
            lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))
            starts = F.zip_with(_offsets(lengths), pieces, lambda o, p: F.when(o.isNotNull(), o + F.char_length(p)))
            kept = F.transform(valid, lambda v: F.char_length(v) >= least)
            return F.zip_with(F.arrays_zip(starts.alias("s"), kept.alias("k")), found, lambda s, m: F.struct(s["s"].alias("start"), (s["s"] + F.char_length(m)).alias("end"), m.alias("token"), s["k"].alias("counts")))

        return F.filter(_let(whole, spans), lambda s: s["start"].isNotNull())

    none = F.array().cast("array<struct<start:int,end:int,token:string,counts:boolean>>")
    return F.when(text.rlike(pattern), _let(F.split(text, pattern, -1), placed)).otherwise(none)


def _masked(text: Column, pattern: str, least: int = 0) -> Column:
    """text with a space for each character of a match that counts."""

    def joined(pieces: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        valid = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
        hidden = F.zip_with(whole, valid, lambda m, v: F.when(F.char_length(v) >= least, F.repeat(F.lit(" "), F.char_length(m))).otherwise(m))
        return F.array_join(F.zip_with(pieces, hidden, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return F.when(text.rlike(pattern), _let(F.split(text, pattern, -1), joined)).otherwise(text)


BASE = (("assign", ASSIGN, LEAST_VALUE), ("access", ACCESS, 0), ("hex", HEX, 0))


def _staged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, one column of matches a base kind, rest: the text with those matches blanked)."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({kind: F.filter(_matches(F.col("text"), pattern, least), lambda s: s["counts"]) for kind, pattern, least in BASE})
    for _, pattern, least in BASE:
        source = F.col("rest") if "rest" in out.columns else F.col("text")
        out = out.withColumn("rest", _masked(source, pattern, least))
    return out


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, secret, n) over all documents: values that the base patterns find, and outside them the tokens of eight characters
    and more in which no letter stands next to a digit; n is their number."""
    staged = _staged(docs, id_col, text_col)
    value = F.transform("assign", lambda s: F.regexp_extract(s["token"], ASSIGN, 2))
    others = F.concat(*(F.transform(kind, lambda s: s["token"]) for kind in ("access", "hex")))
    ordinary = F.filter(F.regexp_extract_all("rest", F.lit(TRAINED), F.lit(0)), lambda t: ~t.rlike(UNLABELLED))
    as_label = lambda tokens, label: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(label).alias("secret")))
    labelled = F.concat(as_label(F.concat(value, others), True), as_label(ordinary, False))
    return staged.select(F.inline(labelled)).groupBy("token", "secret").agg(F.count(F.lit(1)).alias("n"))


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _steps(token: Column) -> Column:
    """Transitions of a token: 128 times one code plus the next."""
    return _let(_codes(token), lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * 128 + b))


def train(samples: DataFrame) -> DataFrame:
    """(step, llr) from samples (token, secret, n): for each transition that either label has seen, the log of its probability among
    random strings over that among ordinary identifiers, in thousandths, rounded down; 128 x 128 rows at most. Each model is mixed
    with the uniform distribution over its symbols; a character that a label has never seen leaves only that. A row without a
    second character (step % 128 = 0) has the ratio of transitions that neither label has seen after its first."""
    counted = samples.select(F.explode(_steps(F.col("token"))).alias("step"), "secret", "n")
    r, o = (F.coalesce(F.sum(F.when(F.col("secret") == label, F.col("n"))), F.lit(0)) for label in (True, False))
    seen = materialize(counted.groupBy("step").agg(r.alias("r"), o.alias("o")).withColumn("a", F.expr("step div 128")), "secret-steps")
    totals = seen.groupBy("a").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    unseen = totals.select((F.col("a") * 128).alias("step"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("o"), "a")
    rows = seen.unionByName(unseen.select(seen.columns)).join(totals, "a")

    def share(count: str, total: str, uniform: float) -> Column:
        return F.when(F.col(total) > 0, F.lit(1 - uniform) * F.col(count).cast("double") / F.col(total) + uniform / SYMBOLS).otherwise(1 / SYMBOLS)

    return rows.select("step", F.floor(1000 * F.ln(share("r", "rs", RANDOM_UNIFORM) / share("o", "os", ORDINARY_UNIFORM))).cast("int").alias("llr"))


def table_of(model: DataFrame) -> list[int]:
    """train()'s ratios by step, 128 x 128; 0 after characters that neither label has seen."""
    seen = {row["step"]: row["llr"] for row in model.collect()}  # 128 x 128 at most
    return [seen.get(step, seen.get(step - step % 128, 0)) for step in range(128 * 128)]


def scan(docs: DataFrame, ratios: list[int], threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found: array of (start, kind, end, token, llr)) for every row, sorted by start, then kind (its place in KINDS).

    A null text is empty and has none; texts of any length are scanned whole; repeated rows are scanned as often as they occur;
    an empty table gives an empty result; other columns are not read. Spans of the Markov models are runs of sixteen or more
    token characters with a letter among them, in what the base spans leave of the text.
    """
    literal = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def entry(kind: str, llr: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["token"].alias("token"), llr(s["token"]).alias("llr"))

    score = lambda token: F.aggregate(F.transform(_steps(token), lambda s: F.get(literal, s)), F.lit(0), lambda a, x: a + x)
    staged = _staged(docs, id_col, text_col)
    judged = F.filter(_matches(F.col("rest"), JUDGED), lambda s: s["token"].rlike("[A-Za-z]"))
    scored = F.filter(F.transform(judged, entry("markov", score)), lambda e: e["llr"] >= threshold)
    base = [F.transform(kind, entry(kind, lambda _: F.lit(None).cast("int"))) for kind, _, _ in BASE]
    return staged.select("doc_id", F.array_sort(F.concat(*base, scored)).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda e: F.concat_ws(":", F.get(names, e["kind"]), e["start"].cast("string"), e["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the secrets in every document; both models are trained on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs, table_of(train(labelled_samples(docs))))
    of = lambda kind: F.size(F.filter("found", lambda e: e["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda e: e["kind"] < KINDS.index("markov"))
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql_matches(source: str, text: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT *, regexp_split_to_array({text}, '{p}') AS p, regexp_extract_all({text}, '{p}') AS m, regexp_extract_all({text}, '{p}', {2 if pattern == ASSIGN else 0}) AS v FROM {source}"


def _sql_spans(source: str, kind: int, least: int) -> str:
    """One row a match; starts are sums of the lengths before."""
    return f"""SELECT rid, {kind} AS kind, m[i] AS token, v[i] AS value, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {source}) WHERE length(v[i]) >= {least}"""


def _sql_masked(source: str, least: int, to: str) -> str:
    return f"SELECT rid, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(m) THEN '' WHEN length(v[i]) >= {least} THEN repeat(' ', length(m[i])) ELSE m[i] END), '') AS {to} FROM {source}"


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f0 AS ({_sql_matches("d", "t", ASSIGN)}), f1 AS ({_sql_matches("d", "t", ACCESS)}), f2 AS ({_sql_matches("d", "t", HEX)}),
m0 AS ({_sql_masked("f0", LEAST_VALUE, "t1")}), g1 AS ({_sql_matches("m0", "t1", ACCESS)}),
m1 AS ({_sql_masked("g1", 0, "t2")}), g2 AS ({_sql_matches("m1", "t2", HEX)}),
rest AS MATERIALIZED ({_sql_masked("g2", 0, "t3")}),
base AS MATERIALIZED ({_sql_spans("f0", 0, LEAST_VALUE)} UNION ALL {_sql_spans("f1", 1, 0)} UNION ALL {_sql_spans("f2", 2, 0)}),
tokens AS (SELECT value AS w, true AS secret FROM base UNION ALL SELECT w, false FROM (SELECT unnest(regexp_extract_all(t3, '{TRAINED}')) AS w FROM rest) WHERE NOT regexp_matches(w, '{UNLABELLED}')),
steps AS (SELECT secret, ascii(w[i]) AS a, ascii(w[i + 1]) AS b FROM (SELECT *, unnest(range(1, length(w))) AS i FROM tokens)),
seen AS (SELECT a, b, count(*) FILTER (secret) AS r, count(*) FILTER (NOT secret) AS o FROM steps GROUP BY a, b),
totals AS (SELECT a, sum(r) AS rs, sum(o) AS os FROM seen GROUP BY a),
every AS (SELECT a, b, coalesce(r, 0) AS r, coalesce(o, 0) AS o, rs, os FROM (SELECT *, unnest(range(128)) AS b FROM totals) LEFT JOIN seen USING (a, b)),
model AS (
  SELECT a, b, floor(1000 * ln(CASE WHEN rs > 0 THEN {1 - RANDOM_UNIFORM}::DOUBLE * r::DOUBLE / rs::DOUBLE + {RANDOM_UNIFORM / SYMBOLS!r}::DOUBLE ELSE {1 / SYMBOLS!r}::DOUBLE END
    / CASE WHEN os > 0 THEN {1 - ORDINARY_UNIFORM}::DOUBLE * o::DOUBLE / os::DOUBLE + {ORDINARY_UNIFORM / SYMBOLS!r}::DOUBLE ELSE {1 / SYMBOLS!r}::DOUBLE END))::BIGINT AS llr
  FROM every
), f3 AS ({_sql_matches("rest", "t3", JUDGED)}),
judged AS (SELECT * FROM ({_sql_spans("f3", 3, 0)}) WHERE regexp_matches(token, '[A-Za-z]')),
scored AS (
  SELECT rid, kind, token, value, s FROM (SELECT *, unnest(range(1, length(token))) AS i FROM judged) LEFT JOIN model ON a = ascii(token[i]) AND b = ascii(token[i + 1])
  GROUP BY ALL HAVING sum(coalesce(llr, 0)) >= {THRESHOLD}
), spans AS (SELECT rid, s, kind, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || s || ':' || (s + length(token)) AS said FROM (SELECT * FROM base UNION ALL SELECT * FROM scored)),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(said, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""
