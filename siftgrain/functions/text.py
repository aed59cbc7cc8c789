"""Text cleaning and other scalar string functions, as column expressions (§2: T1-T17, S13 lemma form)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the cleaner.
LATEX = r"(?is)<\s*l\s*a\s*t\s*e\s*x\s*i\s*t(?:\s+[^>]*)?>.*?<\s*/\s*l\s*a\s*t\s*e\s*x\s*i\s*t\s*>"
ARXIV = r"(?i)arXiv:\d+\.\d+v\d+"
FIGURE = r"(?id)(Figure|Fig\.)\s*\d+[:].*"
BRACKETS = r"\([^)]*\)|\[[^\]]*\]"
PDF_NOISE = r"(?U)(?:\b[A-Za-z0-9]\b\s+){2,}\b[A-Za-z0-9]\b"
SENTENCE_GAP = r"([.!?])([A-Za-z])"
SPACE = r"(?U)[\s\x1c-\x1f]+"
# The same patterns where only ASCII makes words and blanks, as RE2 has it. Java's own \b knows more letters than that.
ASCII_PDF_NOISE = r"(?:(?<![A-Za-z0-9_])[A-Za-z0-9][ \t\n\f\r]+){2,}[A-Za-z0-9](?![A-Za-z0-9_])"
ASCII_SPACE = r"[ \t\n\f\r]+"


def collapse(c: Column, ascii: bool = False) -> Column:
    """§2: T7."""
    return F.trim(F.regexp_replace(c, ASCII_SPACE if ascii else SPACE, " "))


def clean(c: Column, *, latex: bool = False, arxiv: bool = False, figures: bool = False, brackets: bool = False, pdf_noise: bool = False, ascii: bool = False) -> Column:
    """§2: T1-T8. The flags drop what they name; gaps after sentences and blanks are always mended.

    ``ascii``: letters beyond ASCII end a word, and blanks beyond it stay, as in engines whose patterns know ASCII only.
    """
    for on, pattern in ((latex, LATEX), (arxiv, ARXIV), (figures, FIGURE), (brackets, BRACKETS), (pdf_noise, ASCII_PDF_NOISE if ascii else PDF_NOISE)):
        if on:
            c = F.regexp_replace(c, pattern, " ")
    return collapse(F.regexp_replace(c, SENTENCE_GAP, "$1 $2"), ascii)


def normalised(c: Column) -> Column:
    """§2: T9."""
    return F.lower(F.trim(c))


def word_count(c: Column) -> Column:
    """§2: T10."""
    text = collapse(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long")


def char_length(c: Column) -> Column:
    """§2: T11."""
    return F.char_length(c).cast("long")


def section(c: Column, name: str) -> Column:
    """§2: T13. The first section of that name, up to three line ends or the text's end; null if there is none."""
    pattern = rf"(?is){name}\n\n(.*?)(\n{{3,}}|$)"
    return F.when(c.rlike(pattern), F.trim(F.regexp_extract(c, pattern, 1)))


def english_entry(labels: Column, descriptions: Column, describe: bool = False) -> Column:
    """§2: T14. The English label, with its description after it if asked for; null unless both exist."""
    label, about = F.get_json_object(labels, "$.en.value"), F.get_json_object(descriptions, "$.en.value")
    both = label.isNotNull() & about.isNotNull()
    return F.when(both, F.concat_ws(". ", label, about) if describe else label)


def semicolon_list(c: Column) -> Column:
    """§2: T15."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def filled(template: str, **values: Column) -> Column:
    """§2: T16. A prompt template with its {names} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def lemma(c: Column) -> Column:
    """§2: S13. Underscores of a lexicon's lemma become blanks."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def fixed(c: Column, digits: int = 4) -> Column:
    """A double with so many decimals as C's printf has it: rounded by its exact binary value, where Java rounds its shortest decimal form; null stays null."""

    @F.arrow_udf("string")
    def shown(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in numbers.to_pylist()], pa.string())

    return shown(c.cast("double"))


# Abbreviations in names of configurations, applied in this order.
SHORT_NAMES = (
    ("scope_", ""),
    ("document", "doc"),
    ("sentence", "sent"),
    ("spooling_", ""),
    ("pooling", "pool"),
    ("doc_mean_", "doc_"),
    ("lower_quantile_mean", "lqm"),
    ("stailq", "stq"),
    ("tailq_", ""),
)


def short_name(c: Column) -> Column:
    """§2: T12. Abbreviates a configuration's name; a scope's tail share moves behind the scope's pool."""
    for long, short in SHORT_NAMES:
        c = F.replace(c, F.lit(long), F.lit(short))
    c = F.replace(c, F.lit("_"), F.lit("-"))
    share = F.regexp_extract(c, "stq-([^-]*)", 1)
    moved = F.replace(F.replace(c, F.lit("sent-lqm-"), F.concat(F.lit("sent-lqm-"), share, F.lit("-"))), F.concat(F.lit("-stq-"), share), F.lit(""))
    return F.when(F.contains(c, F.lit("stq-")), moved).otherwise(c)
