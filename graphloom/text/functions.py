"""Scalar text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks that get a blank on both sides.
SPACED = r"([?!{;,}.:/=+()\[\]\"'\-…])"
# The function words of questions.
AND_WORDS, OR_WORDS = ("et",), ("ou",)
WH_WORDS = ("Qui", "Que", "Quel", "Quelle", "Quels", "Quelles", "Où", "qui", "quel", "quelle", "quels", "quelles", "où")
# Ids that name stop words and question words, and classes of humans.
STOP_IDS = "Q2865743 P585 Q397 Q744346 Q684 Q33350 Q1811 Q33947 Q188 P642 Q1801 Q27956604 Q131068 Q850088 Q2559220 Q1385 Q208141 Q897 Q66254 Q758379 Q506881 Q261494 Q279014 Q876 Q6452640 Q20085828 Q42614".split()
WH_IDS = "Q2304610 Q6125402 Q575953 Q380012".split()
HUMAN_CLASSES = "Q5 Q3658341 Q15773347 Q95074".split()


def normalize(text: Column) -> Column:
    """Quotes folded, marks spaced, blanks collapsed, apostrophes attached to the word before, œ written oe, one
    leading blank removed. Null stays null, the empty text empty."""
    t = F.translate(text, "“”»«`‘’", "\"\"\"\"\"''")
    t = F.regexp_replace(t, SPACED, " $1 ")
    t = F.replace(t, F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.replace(t, F.lit(" '"), F.lit("'"))
    t = F.replace(t, F.lit("œ"), F.lit("oe"))
    return F.regexp_replace(t, "^ ", "")


def words(text: Column) -> Column:
    """The tokens of a normalised text without a lexicon: its runs of non-blanks."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def function_word(form: Column) -> Column:
    """AND, OR, WHQ, or null."""
    return F.when(form.isin(*AND_WORDS), "AND").when(form.isin(*OR_WORDS), "OR").when(form.isin(*WH_WORDS), "WHQ")


def link_entity(ids: Column) -> Column:
    """Of ids in rank order the first property, else the first; null for none."""
    return F.coalesce(F.get(F.filter(ids, lambda x: x.startswith("P")), F.lit(0)), F.get(ids, F.lit(0)))


def macro(form: Column, ids: Column) -> Column:
    """What a token stands for: coordination words first, then its entity, then question words."""
    word = function_word(form)
    return F.coalesce(F.when(word.isin("AND", "OR"), word), link_entity(F.coalesce(ids, F.array().cast("array<string>"))), word)


def answers_description(target: Column) -> Column:
    """The items of '(list (description A) (description "B"))', without quotes."""
    return F.transform(F.regexp_extract_all(target, F.lit(r"\(description ([^()]*)\)"), 1), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))


def answers_comma(target: Column) -> Column:
    return F.split(F.trim(target), ",", -1)


def iri_tail(iri: Column) -> Column:
    return F.substring_index(iri, "/", -1)


def plural(word: Column) -> Column:
    """The English plural of one word."""
    return (
        F.when(word.endswith("y"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies")))
        .when(word.endswith("s") | word.endswith("x") | word.endswith("sh") | word.endswith("ch"), F.concat(word, F.lit("es")))
        .when(word.endswith("an"), F.concat(F.substr(word, F.lit(1), F.length(word) - 2), F.lit("en")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


@F.pandas_udf(StringType())
def title(s: pd.Series) -> pd.Series:
    """Title case with a capital after every non-letter, which no built-in function has."""
    return s.str.title()


def regular_label(label: Column) -> Column:
    """Whether a label can be a key: it has a letter or number and none of * + ( ) [ ] ? \\."""
    return label.rlike(r"[\p{L}\p{N}]") & ~label.rlike(r"[*+()\[\]?\\]")


def number_token(leaf: Column) -> Column:
    return F.when(leaf.rlike(r"^[0-9]+([,/.][0-9]+)*"), "<num>").otherwise(leaf)


def strip_decoration(label: Column) -> Column:
    return F.split_part(F.split_part(label, F.lit("-"), F.lit(1)), F.lit("="), F.lit(1))
