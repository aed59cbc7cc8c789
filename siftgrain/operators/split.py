"""Splitting texts into scopes and referential units (§2: U1-U10). One expression each, no UDF and no shuffle.

Units come from rules, not a parser: a token breaks a unit if it is a stop word
or has no letter or digit, and a unit is a longest run of other tokens. Any
``DataFrame -> DataFrame`` that adds the scopes column can take this one's place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.functions.text import clean, collapse

#: Ends a unit: whatever is neither letter, digit nor blank.
MARK = r"[^\p{L}\p{N}\s]"
# Stop words of the rule splitter (English, French, German, Spanish).
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or our she that the their them they this to was we were which will with you your "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou par pas pour que qui se son sur un une "
    "als auch auf aus das dem den der des die ein eine einer es für im ist mit nicht sich sie sind und von war wie zu zum "
    "como con del el ella entre era es esta fue las lo los más no o para pero por sin sobre su sus una y"
).split()


def sentences(text: Column) -> Column:
    """§2: U3. Sentences of a text; a blank text is one scope by itself."""
    found = F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?]+) ", "$1\n"), "\n"), lambda x: F.trim(x)), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def scopes(text: Column, scope: str = "sentence") -> Column:
    """§2: U2-U4."""
    if scope not in ("sentence", "document"):
        raise ValueError(f"unknown scope: {scope}")
    return sentences(text) if scope == "sentence" else F.array(text)


def stop_pattern(stop_words: list[str]) -> str:
    """Stop words as whole tokens, by first letter, so that a token is compared with few of them."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(stop_words)):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    words = "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in by_letter.items())
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


def units(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """§2: U5-U7. Units in the text's order, repeats kept; 'Name et al' stays one token."""
    text = F.regexp_replace(text, r"(\p{Lu}\p{L}*) et al\b", "$1etal")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), MARK, "\n")
    if stop_words:
        text = F.regexp_replace(text, stop_pattern(stop_words), "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda u: u != "")


def without_repeats(found: Column) -> Column:
    """§2: U8. Units without repeats, first ones kept."""
    return F.array_distinct(found)


def split_scopes(docs: DataFrame, scope: str = "sentence", text: str = "text", **flags: bool) -> DataFrame:
    """§2: U1, U9, N11. A row for each scope of each row: scope_index, scope_text, units; other columns stay."""
    body = clean(F.coalesce(F.col(text), F.lit("")), **flags)
    out = docs.select("*", F.posexplode(scopes(body, scope)).alias("scope_index", "scope_text"))
    return out.withColumn("units", units(F.col("scope_text")))


def unit_rows(scoped: DataFrame) -> DataFrame:
    """The long table: a row for each unit, and one with a null unit for a scope without any."""
    return scoped.select("*", F.posexplode_outer("units").alias("unit_pos", "unit")).drop("units")


def paragraph(text: Column, least: int = 10, skip_first: bool = False) -> Column:
    """§2: U10. The first paragraph with enough units; with ``skip_first`` the very first comes last."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda x: F.trim(x)), lambda p: p != "")
    rich = lambda a: F.filter(a, lambda p: F.size(units(collapse(p))) >= least)
    found = rich(parts)
    if skip_first:
        n = F.size(parts)
        later = rich(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))))
        found = F.concat(later, rich(F.slice(parts, 1, 1)))
    return F.get(found, 0)
