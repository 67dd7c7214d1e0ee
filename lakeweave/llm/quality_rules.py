"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import BREAK_CLASS, WORD_BREAKS, pick


class Rule(NamedTuple):
    """A document fails when `metric` lies outside low..high (None: no bound)."""

    name: str
    metric: str
    low: float | None
    high: float | None


# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "be", "on", "by", "at", "this", "are", "or", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "est", "dans", "pour", "par", "sur", "au", "avec",
    "der", "die", "das", "und", "den", "dem", "von", "mit", "sich", "nicht", "ein", "eine", "ist", "auf", "im", "zu",
    "el", "los", "las", "y", "se", "con", "una", "del", "al", "lo", "es", "su", "por", "para",
)

#: Production thresholds. Ratios are per word, but for dup_line_ratio, which is per line with a word.
RULES = (
    Rule("too_long", "n_words", None, 1_000_000),
    Rule("word_length", "mean_word_chars", 1.5, 25.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without space or U+0009 to U+000D."""
    trimmed = F.btrim(text, F.lit(WORD_BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BREAK_CLASS}+"))


def _repeated_words(hashes: Column) -> Column:
    """Words inside three-word windows whose hash occurs again in the same text.

    Sorted (hash, place) pairs put equal windows side by side; the places of those
    with an equal neighbour cover three words each, and each word counts once.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of_equals(pairs: Column) -> Column:
        n = F.greatest(F.size(pairs) - 1, F.lit(0))
        ahead = F.zip_with(F.slice(pairs, 1, n), F.slice(pairs, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.flatten(F.filter(ahead, lambda x: x.isNotNull()))

    # as the one element of an array, so that the pairs are sorted once and not wherever they are named
    equals = F.get(F.transform(F.array(placed), of_equals), F.lit(0))
    return F.size(F.array_distinct(F.flatten(F.transform(equals, lambda i: F.array(i, i + 1, i + 2)))))


def metrics(docs: DataFrame) -> DataFrame:
    """Counts for each row of docs (doc_id, text); a null text counts as empty.

    Each word is hashed once, and windows of three words are compared by a 64-bit hash of
    those hashes within one text, so the work stays in the row: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"), words(text).alias("words"))
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    some = F.greatest(n - 2, F.lit(0))
    base = base.select("doc_id", "text", "words", lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    joined = lambda a, b: F.xxhash64(a, b)
    windows = F.zip_with(F.zip_with(F.slice("hashes", 1, some), F.slice("hashes", 2, some), joined), F.slice("hashes", 3, some), joined)
    base = base.select("doc_id", "text", "words", "lines", windows.alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    return base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _repeated_words(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where no rule of the table fails; ratios of nothing count as zero."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    known = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }
    bounds = [known[r.metric] >= F.lit(float(r.low)) for r in rules if r.low is not None] + [known[r.metric] <= F.lit(float(r.high)) for r in rules if r.high is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Counts, base_failed and kept for each row of docs (doc_id, text).

    base_failed: under least_words words, or over most_repeated per cent of them in
    repeated windows. kept: false if base_failed, else whether all rules hold. Null
    and empty texts have no words and fail. Each input row gives one row; equal rows
    give equal results; an empty table gives an empty result; further columns are ignored.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    told = metrics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL over the view documents."""
    ratios = {"n_words": "n_words", "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)", "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)", "stop_word_ratio": "coalesce(n_stop_words / nullif(n_words, 0), 0)", "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)"}
    tests = [f"{ratios[r.metric]} >= {r.low}" for r in rules if r.low is not None] + [f"{ratios[r.metric]} <= {r.high}" for r in rules if r.high is not None]
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
w3 AS (SELECT doc_id, i, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, b, c) > 1 AND c IS NOT NULL AS r FROM w3),
cov AS (SELECT doc_id, (r OR coalesce(lag(r, 1) OVER (PARTITION BY doc_id ORDER BY i), false) OR coalesce(lag(r, 2) OVER (PARTITION BY doc_id ORDER BY i), false)) AS hit FROM rep),
c AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM cov GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
 len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_lines_distinct,
 len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
f AS (SELECT *, n_lines - n_lines_distinct AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_stop_words AS BIGINT) AS n_stop_words,
 base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f"""
