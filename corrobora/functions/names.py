"""Expressions over organisation and person names."""

from pyspark.sql import Column, functions as F

from corrobora import rules


def _literals(words):
    return F.array([F.lit(w) for w in words])


def _lookup(table):
    return F.create_map([F.lit(x) for pair in table.items() for x in pair])


def employer_tokens(name) -> Column:
    """The words that identify an organisation, abbreviations written out."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9&\s]", " "), r"\s+")
    noise = _literals(rules.BANK_NOISE + rules.LEGAL_SUFFIXES)
    kept = F.filter(words, lambda w: (
        (w != "") & ~w.rlike(rules.IFSC_TOKEN) & ~w.rlike(rules.REFERENCE_TOKEN)
        & ~w.rlike(rules.MONTH_TOKEN) & ~F.array_contains(noise, w)))
    written_out = _lookup(rules.ABBREVIATIONS)
    return F.flatten(F.transform(
        kept, lambda w: F.split(F.coalesce(F.try_element_at(written_out, w), w), " ")))


def romanise(text) -> Column:
    """E5: Devanagari in Latin letters; text without Devanagari passes through unchanged."""
    text = F.col(text) if isinstance(text, str) else text
    consonants = "".join(rules.DEVANAGARI_CONSONANTS)
    signs = "".join(rules.DEVANAGARI_SIGNS)
    letters = {**rules.DEVANAGARI_VOWELS, **rules.DEVANAGARI_CONSONANTS, **rules.DEVANAGARI_SIGNS}

    out = F.regexp_replace(text, r"[^\u0900-\u097F\s]", "")
    out = F.regexp_replace(out, rules.NUKTA, "")
    # vowel signs count only right after a consonant
    out = F.regexp_replace(out, f"(?<![{consonants}])[{signs}]", "")
    # nasal signs take the place of articulation of the letter after them
    out = F.regexp_replace(out, f"[{rules.NASAL_SIGNS}](?=[{rules.NASAL_NG_BEFORE}])", "ng")
    out = F.regexp_replace(out, f"[{rules.NASAL_SIGNS}](?=[{rules.NASAL_M_BEFORE}])", "m")
    out = F.regexp_replace(out, f"[{rules.NASAL_SIGNS}]", "n")
    # a consonant carries its own vowel unless a sign or a halant follows
    out = F.regexp_replace(out, f"([{consonants}])(?![{signs}{rules.HALANT}])", "$1a")
    spelled = _lookup(letters)
    out = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(
        F.try_element_at(spelled, c), F.when(c.rlike(r"[a-z]"), c), F.when(c.rlike(r"\s"), F.lit(" ")),
        F.lit(""))), "")
    words = F.transform(
        F.filter(F.split(out, " "), lambda w: w != ""),
        lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "a$", "")).otherwise(w))
    return F.when(text.rlike(r"[\u0900-\u097F]"), F.array_join(words, " ")).otherwise(text)


def name_tokens(name) -> Column:
    """Upper-case name words without honorifics."""
    latin = F.upper(F.regexp_replace(romanise(name), r"[^A-Za-z\s.]", " "))
    words = F.transform(F.split(latin, r"\s+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    honorifics = _literals(rules.HONORIFICS)
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(honorifics, w))


def name_signature(word) -> Column:
    """Consonants, then vowels by class. Spellings of one name share it."""
    for letter, written in rules.LETTER_EQUIVALENTS:
        word = F.replace(word, F.lit(letter), F.lit(written))
    consonants = F.regexp_replace(word, "[AEIOU]|[^A-Z]", "")
    skeleton = F.when(consonants == "", word).otherwise(consonants)
    vowels = F.translate(F.regexp_replace(
        F.regexp_replace(word, r"([AEIOU])\1+", "$1"), "[^AEIOU]", ""), "EO", "IU")
    return F.concat(skeleton, F.lit("|"), vowels)
