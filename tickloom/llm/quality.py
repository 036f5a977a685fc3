"""Line-first quality rules (operator 3), in DataFrame functions only.

Each line is judged by itself: punctuation (too much of it, or none in many words), symbol load, shouting, navigation
separators, boilerplate phrases of four languages. Failing lines are removed; a document that loses more than half of its line text is rejected, as is one that fails the base rules
(fewer than 20 words, or over 30 % of words in repeated 8-word windows).

Nothing is shuffled: a document's repeated windows are found inside its own row by sorting window hashes, so cost is
n log n in its words and does not depend on other documents.

Nulls: a null text counts as empty (no words, so base_failed). Empty tables give empty results, repeated rows are
judged one by one, other columns are ignored. Equal windows are told by 64-bit hashes of their word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, texts, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line fails if it has over this share of marks.
MAX_MARK_PERCENT = 10
MARKS = "#*$%&<>!^~{}\\="
#: A line is navigation if it has this many separators, and one in so many characters is one.
NAV_SEPARATORS = "|»›•·"
MIN_SEPARATORS, SEPARATOR_EACH = 3, 25
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_CAPITAL_PERCENT, MIN_CAPITAL_CHARS = 60, 20
#: A line fails if it has over this share of punctuation, or none of it in so many words (blank runs) or more.
PUNCTUATION = ".,;:!?-_…"
MAX_PUNCTUATION_PERCENT, BARE_WORDS = 30, 30
BOILERPLATE = "all rights reserved|cookie polic|privacy polic|terms of (use|service)|sign up for|click here|enable javascript|skip to (main )?content|alle rechte vorbehalten|datenschutzerkl|cookie-richtlinie|hier klicken|zum inhalt springen|tous droits r.serv.s|politique de confidentialit|cliquez ici|aller au contenu|todos los derechos reservados|pol.tica de (privacidad|cookies)|haga clic aqu|ir al contenido"
#: Kept line text has to be at least this share of all line text.
MIN_KEPT_PERCENT = 50


def _of(line: Column, chars: str) -> Column:
    """How many characters of a line are among chars."""
    return F.char_length(line) - F.char_length(F.translate(line, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether the punctuation, navigation or boilerplate rules reject a line."""
    n = F.char_length(line)
    bars = _of(line, NAV_SEPARATORS)
    points = _of(line, PUNCTUATION)
    return (
        (points * 100 > n * MAX_PUNCTUATION_PERCENT)
        | ((points == 0) & (_of(line, " ") >= BARE_WORDS))
        | (_of(line, MARKS) * 100 > n * MAX_MARK_PERCENT)
        | ((bars >= MIN_SEPARATORS) & (bars * SEPARATOR_EACH > n))
        | ((n >= MIN_CAPITAL_CHARS) & (_of(line, CAPITALS) * 100 > n * MAX_CAPITAL_PERCENT))
        | F.lower(line).rlike(BOILERPLATE)
    )


def repeated_words(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add out: how many words of the array in column lie in WINDOW-word windows found twice or more in it."""
    n = F.size(column)
    step = lambda h, d: F.zip_with(h, F.slice(h, d + 1, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_h1", F.when(n > WINDOW, F.transform(column, lambda w: F.xxhash64(w))))
    df = df.withColumn("_h2", step(F.col("_h1"), 1)).withColumn("_h4", step(F.col("_h2"), 2)).withColumn("_h8", F.slice(step(F.col("_h4"), 4), 1, n - WINDOW + 1))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_next", F.zip_with("_s", F.slice("_s", 2, n), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    df = df.withColumn("_twice", F.zip_with("_next", F.concat(F.array(F.lit(False)), "_next"), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))))
    df = df.withColumn("_at", F.sort_array(F.filter(F.zip_with("_s", "_twice", lambda s, t: F.when(t, s["i"])), lambda i: i.isNotNull())))
    cover = F.zip_with("_at", F.slice("_at", 2, n), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    df = df.withColumn(out, F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")))
    return df.drop("_h1", "_h2", "_h4", "_h8", "_s", "_next", "_twice", "_at")


def clean_lines(docs: DataFrame, *more: str) -> DataFrame:
    """The operator: doc_id, the columns named in more, the counts, base_failed, kept, and clean_text, the text without failed lines."""
    df = texts(docs, *more)
    df = df.withColumn("_words", words(F.col("text"))).withColumn("n_words", F.size("_words").cast("long"))
    df = repeated_words(df, "_words", "n_repeat_words").drop("_words")
    df = df.withColumn("_bare", F.translate("text", BLANKS, "")).withColumn("word_chars", F.char_length("_bare").cast("long"))
    df = df.withColumn("n_symbols", _of(F.col("_bare"), "#*$%&|<>").cast("long")).drop("_bare")
    has_word = lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    df = df.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_full", F.filter("_lines", has_word))
    df = df.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    df = df.withColumn("_good", F.filter("_lines", lambda line: ~line_fails(line)))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.char_length(x))
    df = df.withColumn("n_lines", F.size("_full").cast("long")).withColumn("line_chars", chars("_lines")).withColumn("good_chars", chars("_good"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("good_chars") * 100 >= F.col("line_chars") * MIN_KEPT_PERCENT))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "good_chars", "base_failed", "kept")
    return df.select("doc_id", *more, *names, F.array_join("_good", "\n").alias("clean_text"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


def _sql_of(line: str, chars: str) -> str:
    return f"(length({line}) - length(translate({line}, '{chars}', '')))"


#: DuckDB SQL for op3_quality_rules.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
e AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w WHERE len(words) > {WINDOW}),
g AS (SELECT rid, i, concat_ws(' ', word, {', '.join(f'lead(word, {k}) OVER s' for k in range(1, WINDOW))}) AS gram, lead(word, {WINDOW - 1}) OVER s AS last FROM e WINDOW s AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, range({WINDOW}) AS o(k) GROUP BY rid),
l AS (SELECT rid, doc_id, text, len(words)::BIGINT AS n_words, lines, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
  list_filter(lines, lambda x: NOT ({_sql_of('x', PUNCTUATION)} * 100 > length(x) * {MAX_PUNCTUATION_PERCENT} OR ({_sql_of('x', PUNCTUATION)} = 0 AND {_sql_of('x', ' ')} >= {BARE_WORDS}) OR {_sql_of('x', MARKS)} * 100 > length(x) * {MAX_MARK_PERCENT}
    OR ({_sql_of('x', NAV_SEPARATORS)} >= {MIN_SEPARATORS} AND {_sql_of('x', NAV_SEPARATORS)} * {SEPARATOR_EACH} > length(x))
    OR (length(x) >= {MIN_CAPITAL_CHARS} AND {_sql_of('x', CAPITALS)} * 100 > length(x) * {MAX_CAPITAL_PERCENT})
    OR regexp_matches(lower(x), '{BOILERPLATE}'))) AS good FROM w),
c AS (SELECT l.rid, doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(full_lines)::BIGINT AS n_lines,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS line_chars, coalesce(list_sum(list_transform(good, lambda x: length(x))), 0)::BIGINT AS good_chars FROM l LEFT JOIN r ON r.rid = l.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, line_chars, good_chars, base_failed, NOT base_failed AND good_chars * 100 >= line_chars * {MIN_KEPT_PERCENT} AS kept FROM b
"""
