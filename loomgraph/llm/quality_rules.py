"""Quality rules, line first: every line is held against punctuation, navigation and boilerplate rules,
failing lines go, and a document that loses too much of its text is rejected.

DataFrame functions only; all work is inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import let, put_back, set_aside, words_of

SYMBOLS = "#*$%&|<>"
SYMBOL = f"[{SYMBOLS}]"
SEPARATOR = "(?<![^\\x20\\x09-\\x0D])[|>»·•/](?![^\\x20\\x09-\\x0D])"
SHOUT = "!!(?![^\\x20\\x09-\\x0D])"
SENTENCE_MARK = "[.!?…。！？؟।]"
BOILERPLATE = (
    "(?i)^[\\x20\\x09-\\x0D]*(all rights reserved|licensed under|copyright (\\(c\\)|©|[0-9])|© ?[0-9]|"
    "(please )?(enable|turn on) javascript|(we|this (web)?site) uses? cookies|accept (all )?cookies|"
    "terms of (use|service)|privacy policy|skip to (main )?content|subscribe to our newsletter|"
    "click here to|sign in|log in|follow us on|share (this|on))"
)
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def line_fails(line: Column) -> Column:
    """True if a line breaks a rule. Lines without words pass; they carry no text.

    punctuation: 30 % of the words hold a symbol or end in doubled exclamation marks, or 20 words and
    more go without any sentence mark; navigation: two separators that are 20 % of the words;
    boilerplate: it opens with a stock phrase; repetition: of 10 words and more, under 40 % differ.
    """

    def judged(words: Column) -> Column:
        n = F.size(words)
        share = lambda count, part: count >= F.greatest(F.lit(1.0), n * part)
        has_symbol = line.rlike(SYMBOL)
        return (
            F.when(n == 0, False)
            .when(has_symbol & share(F.size(F.filter(words, lambda w: w.rlike(SYMBOL))), 0.3), True)
            .when(F.contains(line, F.lit("!!")) & share(F.regexp_count(line, F.lit(SHOUT)), 0.3), True)
            .when((n >= 20) & ~line.rlike(SENTENCE_MARK), True)
            .when((n >= 10) & (F.size(F.array_distinct(words)) < n * 0.4), True)
            .when(line.rlike(SEPARATOR) & share(F.regexp_count(line, F.lit(SEPARATOR)), 0.2) & (n > 2), True)
            .otherwise(line.rlike(BOILERPLATE))
        )

    return let(words_of(line), judged)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in a window of ``window`` words that occurs twice or more.

    Windows are hashed first; only where two hashes agree are they compared as text, sorted in the row.
    """
    last = F.size(words) - window
    hashes = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, window)))

    def counted(rows: Column) -> Column:
        def same(k: Column) -> Column:
            return F.get(rows, k)["w"]

        found = F.filter(rows, lambda r, k: F.coalesce((r["w"] == same(k - 1)) | (r["w"] == same(k + 1)), F.lit(False)))
        # the filter's second operand is null at either end: null | true is true, null | false is not found
        at = F.array_sort(F.transform(found, lambda r: r["i"]))

        def covered(starts: Column) -> Column:
            reach = F.transform(
                starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window)))
            )
            return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

        return let(at, covered)

    exact = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), last + 1),
            lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("w"), i.alias("i")),
        )
    )
    return F.when(last < 1, F.lit(0)).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(exact, counted)))
    )


def apply_quality_rules(docs: DataFrame, text_col: str = "text", *, min_kept: float = 0.5) -> DataFrame:
    """Measure every document, clean it line by line and judge it.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``base_failed``, ``n_lines_removed`` (long), ``clean_text`` (the lines that pass) and ``kept``: not
    ``base_failed`` and at least ``min_kept`` of the code points left by ``line_fails``. Columns of these
    names in the input are replaced.

    Null and empty texts: no words, all counts 0, ``clean_text`` '', rejected. Every row is judged alone,
    so ties and repeated rows need no rule; an empty table gives an empty table. The whole text counts,
    however long.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "n_lines_removed", "clean_text", "kept"]
    columns = docs.drop(*added).columns
    plain = set_aside(docs.drop(*added), text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda lines: F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        F.split(text, "\n"),
        lambda lines: F.struct(
            let(has_word(lines), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            F.size(lines).alias("_n_lines"),
            F.filter(lines, lambda x: ~line_fails(x)).alias("_left"),
        ),
    )
    # inline() of one struct: a generator, below which a filter on its columns isn't pushed, so that
    # everything is computed once
    once = plain.select(
        *[F.col(f"`{c}`") for c in plain.columns], F.inline(F.array(F.struct(of_words.alias("_w"), of_lines.alias("_l"))))
    )
    measured = once.select(
        *[F.col(f"`{c}`") for c in plain.columns],
        "_w.*",
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        "_l.*",
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    judged = measured.withColumns(
        {
            "base_failed": base_failed,
            "n_lines_removed": (F.col("_n_lines") - F.size("_left")).cast("long"),
            "clean_text": F.when(F.size("_left") == F.col("_n_lines"), text).otherwise(F.array_join("_left", "\n")),
        }
    )
    enough = F.char_length("clean_text") >= min_kept * F.char_length(text)
    return judged.withColumn("kept", ~F.col("base_failed") & enough).select(
        *put_back(columns, text_col), *added
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_SQL_SPACE = "[\\x20\\x09-\\x0D]"
_SQL_SEP = "(^|[\\x20\\x09-\\x0D])[|>»·•/]($|[\\x20\\x09-\\x0D])"
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SQL_SPACE}+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id
), ln AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(line, '{_SQL_SPACE}+'), lambda x: x <> '') AS w, pos
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d)
), lt AS (
  SELECT doc_id, line, pos, len(w) AS n, len(list_distinct(w)) AS u,
         len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS sym,
         len(list_filter(w, lambda x: x IN ('|', '>', '»', '·', '•', '/'))) AS sep,
         len(list_filter(w, lambda x: suffix(x, '!!'))) AS shout
  FROM ln
), lf AS (
  SELECT doc_id, line, pos, n > 0 AND (
           (sym >= greatest(1, n * 0.3)) OR (shout >= greatest(1, n * 0.3))
           OR (n >= 20 AND NOT regexp_matches(line, '{SENTENCE_MARK}')) OR (n >= 10 AND u < n * 0.4)
           OR (n > 2 AND sep >= greatest(1, n * 0.2)) OR regexp_matches(line, '{BOILERPLATE}')) AS bad
  FROM lt
), kept AS (
  SELECT doc_id, coalesce(length(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad)), 0) AS left_chars
  FROM lf GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lt WHERE n > 0 GROUP BY doc_id
)
SELECT *, NOT base_failed AND left_chars >= 0.5 * n_chars AS kept FROM (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(w) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(w) AS base_failed,
         kept.left_chars, length(text) AS n_chars
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN kept USING (doc_id))
"""
OP1_SQL = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({OP1_SQL})"
