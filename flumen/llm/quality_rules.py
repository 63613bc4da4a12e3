"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one failure
bit a rule; policies are named sets of rules (bitmasks) and are applied by a bitwise and. Ablations
(what each rule alone removes, what would be kept without it) are one aggregation over the bits.

All of it is built-in expressions without an exchange: words and windows are arrays of their row. Words
are ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty: they have no words, so the rule on the number of
words fails. Texts are read whole, however long; a text is one row's arrays. A measurement that is exactly at
a rule's bound passes. Repeated rows give repeated results, an empty table an empty one, and other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: With so many repeated windows or fewer their places are looked up one by one, else by sorting.
FEW = 16

#: Rules by bit: name and the condition of failure over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "duplicate_lines": "n_lines >= 10 AND 2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "2 * n_upper > word_chars",
}

#: Policies by version: the rules that count. Every version has the base rules.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements.

    ``n_repeat_words`` counts the words that stand in 3-word windows found twice or more in the text.
    Sorting the window hashes shows which are found again; most texts end there. Where some are, the
    places of these windows follow, ascending, and each covers the words that the one before did not.
    """
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr("*", r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '') AS words")
    rows = rows.selectExpr(
        "*",
        "IF(size(words) < 3, CAST(array() AS array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))) AS windows",
        r"filter(split(text, '\n'), line -> line RLIKE '[^\\x20\\x09-\\x0D]') AS lines",
    )
    rows = rows.selectExpr("*", "sort_array(windows) AS ordered")
    rows = rows.selectExpr("*", "filter(ordered, (h, i) -> i > 0 AND h = ordered[greatest(i, 1) - 1]) AS later")
    rows = rows.selectExpr("*", f"IF(size(later) > 0 AND size(later) <= {FEW}, array_distinct(later), NULL) AS few")
    rows = rows.selectExpr("*", f"IF(size(later) > {FEW}, sort_array(transform(windows, (h, i) -> struct(h, i))), NULL) AS pairs")
    rows = rows.selectExpr(
        "*",
        """CASE WHEN few IS NOT NULL AND size(few) > 0 THEN filter(transform(windows, (h, i) -> IF(array_contains(few, h), i, -1)), i -> i >= 0)
                WHEN pairs IS NOT NULL THEN sort_array(transform(filter(pairs, (x, k) -> (k > 0 AND pairs[greatest(k, 1) - 1].h = x.h)
                     OR (k + 1 < size(pairs) AND pairs[least(k + 1, size(pairs) - 1)].h = x.h)), x -> x.i))
                ELSE CAST(array() AS array<int>) END AS places""",
    )
    return rows.selectExpr(
        "doc_id",
        "CAST(size(words) AS BIGINT) AS n_words",
        "CAST(length(array_join(words, '')) AS BIGINT) AS word_chars",
        "CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT) AS n_symbols",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        "IF(size(places) = 0, 0L, aggregate(transform(places, (p, k) -> IF(k = 0, 3, least(3, p - places[greatest(k, 1) - 1]))), 0L, (a, x) -> a + x)) AS n_repeat_words",
        "CAST(regexp_count(text, '[A-Z]') AS BIGINT) AS n_upper",
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``bits`` (bit k set: rule k fails)."""
    bits = " + ".join(f"IF({condition}, {1 << k}, 0)" for k, condition in enumerate(RULES.values()))
    return measure(docs).withColumn("bits", F.expr(bits))


def judge(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return (
        ledger(docs)
        .withColumn("base_failed", F.col("bits").bitwiseAND(mask_of(POLICIES["base"])) != 0)
        .withColumn("kept", F.col("bits").bitwiseAND(mask_of(POLICIES[policy]) | mask_of(POLICIES["base"])) == 0)
    )


def ablations(judged: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row for each rule of a policy: documents failing it, failing it alone, and kept without it.

    One aggregation over the failure bits of a ledger; at most 2**rules partial rows leave each task.
    """
    full = mask_of(POLICIES[policy])
    counts = judged.groupBy(F.col("bits").bitwiseAND(full).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).alias("bit")) for r in POLICIES[policy]])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda condition, name: F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0)).alias(name)
    return each.groupBy("rule").agg(total("bits & bit != 0", "n_failed"), total("bits = bit", "n_only"), total("bits & ~bit = 0", "n_kept_without"))


#: The same by DuckDB.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
p AS (SELECT *, CASE WHEN len(words) < 3 THEN [] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END AS windows FROM w),
u AS (SELECT doc_id, unnest(windows) AS win, unnest(range(len(windows))) AS pos FROM p),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM u) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT p.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper FROM p LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 2 * n_words OR (n_lines >= 10 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_upper > word_chars) AS kept
FROM m"""
