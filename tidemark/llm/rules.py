"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps one bit a rule and the measurements behind it.
Policies are versioned masks over the ledger, so that applying another policy, or asking what each rule
removes alone, reads the ledger and never the texts again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

SPACE_CLASS = r"[ \t\n\x0B\f\r]"
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and not copied into body's loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeated(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that occur twice or more in the text.

    Window hashes are sorted, so equal ones are neighbours; only for a text that has any are they sorted again
    with their positions. Covered words are counted as steps from each such window to the next, `size` at most.
    """

    def doubled(h: Column, by: int) -> Column:
        """Hashes of stretches from those of half the length, `by` words."""
        return _let(h, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - by), F.slice(x, 1 + by, F.size(x) - by), lambda a, b: F.xxhash64(a, b)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        hashes = doubled(hashes, by)

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def steps(s: Column) -> Column:
            at = lambda k: F.get(s, k)["h"]
            twice = F.filter(s, lambda e, k: F.coalesce(at(k - 1) == e["h"], F.lit(False)) | F.coalesce(at(k + 1) == e["h"], F.lit(False)))
            positions = F.array_sort(F.transform(twice, lambda e: e["i"]))
            return _let(positions, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x))

        return _let(placed, steps)

    def gathered(h: Column) -> Column:
        ordered = F.sort_array(h)
        same = _let(ordered, lambda s: F.exists(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: x == y), lambda x: x))
        return F.when(F.size(h) < 2, 0).otherwise(F.when(same, covered(h)).otherwise(0))

    return F.when(F.size(words) <= size, 0).otherwise(_let(hashes, gathered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measured: a struct of the measurements) for every row of docs. A null text has none of anything; very long texts
    are measured whole. Other columns are not read and may have any name."""
    staged = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    staged = staged.withColumns({"__words": _words(F.col("__text")), "__lines": F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))})
    n_chars = F.char_length("__text")
    count = lambda pattern: n_chars - F.char_length(F.regexp_replace("__text", pattern, ""))
    fields = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(F.array_join("__words", "")),
        "n_symbols": count(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeated(F.col("__words")),
        "n_lines": F.size("__lines"),
        "n_exclaim": count(r"!+"),
        "n_distinct_words": F.size(F.array_distinct("__words")),
    }
    return staged.select("doc_id", F.struct(*(c.cast("long").alias(k) for k, c in fields.items())).alias("measured"))


#: Rules by bit: (name, true where the rule fails, given the measurements). Bits are never used again for another rule.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("exclamations", lambda m: 100 * m["n_exclaim"] > 30 * m["n_words"]),
    ("many_words", lambda m: m["n_words"] > 1_000_000),
    ("few_distinct_words", lambda m: (m["n_words"] >= 100) & (100 * m["n_distinct_words"] < 10 * m["n_words"])),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policies: a document is kept if none of the policy's bits is set.
POLICIES = {
    "base-1": BASE,
    "strict-1": sum(BIT.values()),
    "standard-1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["long_words"] | BIT["short_words"] | BIT["exclamations"],
}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measured, failed: a long with one bit per rule), stored once in the shared folder: policies and ablations read it
    and never the texts.

    Null texts and texts without words fail `few_words`; repeated rows and rows with null ids have an entry each; ties do not
    arise; an empty table gives an empty ledger.
    """
    measured = measure(docs, id_col, text_col)
    bits = [F.when(fails(F.col("measured")), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES)]
    return materialize(measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")), "rule-ledger")


def apply_policy(entries: DataFrame, policy: str = "standard-1") -> DataFrame:
    """The ledger with `kept` and `policy`."""
    return entries.withColumns({"kept": F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0, "policy": F.lit(policy)})


def ablate(entries: DataFrame, policy: str = "standard-1") -> DataFrame:
    """(rule, n_failed, n_only): how many documents fail each rule of the policy, and how many fail only that one.

    One pass with a fixed number of counters; no text and no row leaves its task.
    """
    mask = POLICIES[policy]
    own = F.col("failed").bitwiseAND(F.lit(mask))
    names = [n for n, _ in RULES if BIT[n] & mask]
    counts = [F.count_if(own.bitwiseAND(F.lit(BIT[n])) != 0).alias(f"f_{n}") for n in names] + [F.count_if(own == BIT[n]).alias(f"o_{n}") for n in names]
    listed = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names))
    return entries.agg(*counts).select(F.inline(listed))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the base measurements of every document, its failed rules and the verdict of the policy standard-1."""
    out = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    columns = (f"measured.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return out.select("doc_id", *columns, (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "failed", "policy")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM d
), u AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (
  SELECT r, i, CASE WHEN count(*) OVER eight = 8 THEN list(word) OVER eight END AS win FROM u
  WINDOW eight AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), t AS (SELECT r, i, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM g),
c AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM t),
n AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words FROM c GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclaim, len(list_distinct(words)) AS n_distinct
  FROM w LEFT JOIN n USING (r)
), f AS (
  SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 100 * n_symbols > 30 * n_words AS r2, 100 * n_dup_lines > 30 * n_lines AS r3,
         word_chars > 20 * n_words AS r4, word_chars < 2 * n_words AS r5, 100 * n_exclaim > 30 * n_words AS r6, n_words > 1000000 AS r7,
         n_words >= 100 AND 100 * n_distinct < 10 * n_words AS r8
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept,
       (r0::BIGINT + 2 * r1::BIGINT + 4 * r2::BIGINT + 8 * r3::BIGINT + 16 * r4::BIGINT + 32 * r5::BIGINT + 64 * r6::BIGINT + 128 * r7::BIGINT + 256 * r8::BIGINT)::BIGINT AS failed,
       'standard-1' AS policy
FROM f
"""


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """How many documents each rule of the policy standard-1 fails, and how many it alone."""
    return ablate(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_STANDARD = [name for name, _ in RULES if BIT[name] & POLICIES["standard-1"]]
ABLATION_SQL = (
    ORACLE_SQL.rpartition("SELECT doc_id, n_words")[0]
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (r{i}) AS n_failed, count(*) FILTER (r{i} AND {' + '.join(f'r{k}::INTEGER' for k in range(len(_STANDARD)))} = 1) AS n_only FROM f"
        for i, name in enumerate(_STANDARD)
    )
)
