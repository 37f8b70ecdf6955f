"""Number and token extraction from document lines."""

import re

from pyspark.sql import Column, functions as F

from corrobora import rules


def money(text) -> Column:
    """Text with optional thousands separators as an exact amount."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def amounts(text, pattern=rules.GROUPED_AMOUNT) -> Column:
    """Every amount in the text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), money)


def from_end(items, position) -> Column:
    """Element counted from the end (1 = last); null when the array is shorter."""
    return F.try_element_at(items, F.lit(-position))


def first_match(text, pattern, group=1) -> Column:
    """First match of a group, null instead of an empty string."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def blank_out(text, pattern) -> Column:
    return F.regexp_replace(text, pattern, " ")


def strip(text) -> Column:
    """White space of any kind removed from both ends."""
    return F.btrim(text, F.lit(rules.BLANKS))


def holds(text, pattern) -> Column:
    """Does the pattern occur? As ``rlike``; each alternative is tried only on a text with its longest plain word.

    For patterns of plain words, ``\\s``, ``\\b``, character classes and one level of groups, where no word is optional.
    """
    found = F.lit(False)
    for branch in re.split(r"\|(?![^(]*\))", pattern):
        words = re.findall(r"[a-z0-9]+", re.sub(r"\\[a-z]|\([^)]*\)|\[[^]]*\]", " ", branch))
        word = text.contains(max(words, key=len))
        found = found | (word if branch in words else word & text.rlike(branch))
    return found
