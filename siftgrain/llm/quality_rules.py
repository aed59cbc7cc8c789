"""Line-first quality rules, in SQL expressions only.

Every line is judged on its own (punctuation, navigation, boilerplate, symbol
and repetition rules); failing lines are removed; a document that loses too
much of its text is rejected. Base metrics judge the whole text.

Edge cases: a null text counts as empty; an empty text has no words, fails the
base rule and is rejected with an empty cleaned text; repeated rows are judged
alike, each on its own; extra columns pass through untouched, and the columns
that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded, table

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of lines that come from a page's frame, not its text (English, German, French, Spanish).
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our",
    "click here",
    "sign up",
    "log in to",
    "login to",
    "powered by",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "cookies akzeptieren",
    "tous droits réservés",
    "politique de confidentialité",
    "accepter les cookies",
    "todos los derechos reservados",
    "política de privacidad",
    "aceptar cookies",
)
#: A text without any of these has no line that the mark rules remove.
SUSPECT = r"[#*$%&|<>»›•!]|\p{Lu}\P{L}*\p{Lu}"
#: Two capitals in a row among the letters: a line that has mostly capitals has them.
CAPITALS = r"\p{Lu}\P{L}*\p{Lu}"


#: Columns that stand for a while; those of the input that are called so keep their values.
INTERNAL = ("_w", "_l", "_h", "_o", "_h1", "_h2", "_h4", "_h8", "_left", "_phrases")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator of one row: what stands above reads it, and never works it out again by element."""
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def phrase(text: Column) -> Column:
    """Whether a lower-cased text holds a boilerplate phrase."""
    out = F.lit(False)
    for p in BOILERPLATE:
        out = out | F.contains(text, F.lit(p))
    return out


def base_metrics(df: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter (words equal to the one before) and base_failed.

    Windows of eight words are told apart by 64-bit hashes, built by doubling
    from the words' own; they are compared inside one text only.
    """
    if width != 8:
        raise ValueError("windows are of eight words")
    df, restored = shielded(df, INTERNAL)
    body = F.coalesce(F.col(text), F.lit(""))
    out = held(df, "_w", words_of(body)).withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    symbols = F.when(body.rlike(SYMBOLS), F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).otherwise(0)
    out = out.withColumn("n_symbols", symbols.cast("long"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = held(out, "_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    out = held(out, "_h1", F.transform("_w", lambda w: F.xxhash64(w)))
    out = out.withColumn("n_stutter", F.size(F.filter("_h1", lambda x, i: (i > 0) & (x == F.get("_h1", i - 1)))).cast("long"))
    for m in (1, 2, 4):
        after = lambda i, m=m: F.get(F.col(f"_h{m}"), i + m)
        out = held(out, f"_h{2 * m}", F.transform(f"_h{m}", lambda x, i: F.xxhash64(x, after(i))))
    out = held(out, "_h", F.slice("_h8", 1, F.greatest(F.size("_w") - (width - 1), F.lit(0))))
    ordered = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("w"), (i + 1).alias("p"))))
    out = held(out, "_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    same = lambda x, j: F.col("_o")[j]["w"] == x["w"]
    last = F.size("_o") - 1
    flags = F.transform("_o", lambda x, i: F.struct(x["p"].alias("p"), (((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(x, F.least(i + 1, last)))).alias("dup")))
    places = F.array_sort(F.transform(F.filter(flags, lambda y: y["dup"]), lambda y: y["p"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.when(F.col("_o").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return restored(out.drop("_w", "_l", "_h", "_o", "_h1", "_h2", "_h4", "_h8"))


def line_fails(line: Column, phrases: Column, repeats: Column) -> Column:
    """True for a line that the rules remove; a blank line never fails.

    Symbols: more than a tenth as many as words. Navigation: separators (|, »,
    ›, •) between a quarter of the words. Punctuation: an exclamation mark on a
    quarter of the words, or mostly capitals over more than eight letters.
    Repetition: one word eight times in a row, or more than half of the words
    are the word before again, three at least. Boilerplate: a known phrase.
    ``phrases`` and ``repeats`` say whether the text can fail the last two.
    """
    n = F.size(words_of(line))
    count = lambda pattern: F.length(line) - F.length(F.regexp_replace(line, pattern, ""))
    capitals, letters = count(r"\p{Lu}"), count(r"\p{L}")
    marks = (
        (10 * count(SYMBOLS) > n)
        | (4 * count(r"[|»›•]") >= n)
        | (4 * count("!") >= F.greatest(n, F.lit(8)))
        | (line.rlike(CAPITALS) & (letters > 8) & (10 * capitals > 6 * letters))
    )
    stutter = lambda ws: F.size(F.filter(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.get(ws, i) == F.get(ws, i - 1)))
    eight = lambda ws: F.exists(F.sequence(F.lit(1), F.size(ws) - 7), lambda i: F.size(F.array_distinct(F.slice(ws, i, 8))) == 1)
    often = lambda ws: (stutter(ws) >= 3) & (2 * stutter(ws) > F.size(ws)) | F.when(F.size(ws) >= 8, eight(ws)).otherwise(False)
    row = F.get(F.transform(F.array(words_of(line)), lambda ws: F.when(F.size(ws) > 3, often(ws)).otherwise(False)), 0)
    return (line.rlike(SUSPECT) & (n > 0) & marks) | (repeats & row) | (phrases & phrase(F.lower(line)))


def clean_lines(df: DataFrame, text: str = "text", least_left: float = 0.5) -> DataFrame:
    """Adds base metrics, clean_text (lines that pass), n_lines_removed and kept.

    kept: the base rule passes and at least ``least_left`` of the characters
    outside blanks are left. A text in which no line can fail isn't taken apart.
    """
    df, restored = shielded(df, INTERNAL)
    body = F.coalesce(F.col(text), F.lit(""))
    out = held(base_metrics(df, text), "_phrases", phrase(F.lower(body)))
    repeats = F.col("n_stutter") >= 3
    passed = F.filter(F.split(body, "\n"), lambda x: ~line_fails(x, F.col("_phrases"), repeats))
    out = held(out, "_left", F.when(F.col("_phrases") | repeats | body.rlike(SUSPECT), passed))
    out = held(out, "clean_text", F.when(F.col("_left").isNull(), body).otherwise(F.array_join("_left", "\n")))
    gone = F.when(F.col("_left").isNull(), 0).otherwise(F.size(F.split(body, "\n")) - F.size("_left"))
    out = out.withColumn("n_lines_removed", gone.cast("long"))
    left = F.when(F.col("n_lines_removed") == 0, F.col("word_chars")).otherwise(F.length(F.regexp_replace("clean_text", BLANKS, "")))
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= least_left * F.col("word_chars")) & (left > 0))
    return restored(out.drop("_left", "_phrases"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


_LINE_FAILS = r"""(nw > 0 AND (10 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > nw
  OR 4 * (length(line) - length(regexp_replace(line, '[|»›•]', '', 'g'))) >= nw
  OR 4 * (length(line) - length(replace(line, '!', ''))) >= greatest(nw, 8)
  OR (length(line) - length(regexp_replace(line, '\p{L}', '', 'g')) > 8
      AND 10 * (length(line) - length(regexp_replace(line, '\p{Lu}', '', 'g'))) > 6 * (length(line) - length(regexp_replace(line, '\p{L}', '', 'g'))))
  OR (len(list_filter(range(1, nw), lambda i: ws[i] = ws[i + 1])) >= 3 AND 2 * len(list_filter(range(1, nw), lambda i: ws[i] = ws[i + 1])) > nw)
  OR len(list_filter(range(1, nw - 6), lambda i: len(list_distinct(ws[i:i+7])) = 1)) > 0
  OR regexp_matches(lower(line), '""" + "|".join(BOILERPLATE) + r"""')))"""
SQL = (
    r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(least(8, i - p)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8) AS p FROM dup) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l0),
l2 AS (SELECT *, len(ws) AS nw FROM l1),
l AS (SELECT r, line, ws, nw, """
    + _LINE_FAILS
    + r""" AS bad FROM l2),
s AS (SELECT r, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dups, count(*) FILTER (bad) AS removed,
  coalesce(sum(length(array_to_string(ws, ''))) FILTER (NOT bad), 0) AS left_chars FROM l GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, removed::BIGINT AS n_lines_removed, left_chars
  FROM w JOIN s USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= 0.5 * word_chars AND left_chars > 0 AS kept, n_lines_removed
FROM m"""
)
