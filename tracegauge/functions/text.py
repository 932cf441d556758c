"""Tokens, sentences and numbers of a text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
NUMBER = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
#: Digits of a number up to which its rounded forms are worked out; a longer one has to be quoted exactly.
ROUNDED_DIGITS = 37
# Openings of a statement that admits a gap in the data; callers may pass their own.
ABSTENTIONS = (
    "i don't have",
    "i do not have",
    "i don't know",
    "i do not know",
    "i cannot find",
    "i can't find",
    "no data available",
    "not enough information",
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def numbers(text: Column) -> Column:
    """Numbers in plain form: no thousands separators, no plus sign, no idle zeros. A minus behind a letter
    or digit is a hyphen, not a sign."""
    signed = F.regexp_replace(F.replace(text, F.lit("−"), F.lit("-")), r"([\p{L}\p{N}])-", "$1 ")
    return F.transform(F.regexp_extract_all(signed, F.lit(NUMBER), F.lit(0)), lambda x: _plain(x, _whole(x), _fraction(x)))


def _whole(number: Column) -> Column:
    return F.regexp_replace(F.split_part(number, F.lit("."), F.lit(1)), "[-+,]", "")


def _fraction(number: Column) -> Column:
    return F.split_part(number, F.lit("."), F.lit(2))


def _plain(number: Column, whole: Column, fraction: Column) -> Column:
    """The sign of ``number`` with these digits."""
    whole, fraction = F.regexp_replace(whole, "^0+", ""), F.regexp_replace(fraction, "0+$", "")
    size = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    return F.when(number.startswith("-") & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)


def rounded_forms(number: Column) -> Column:
    """A plain number, and itself rounded half up to every smaller number of decimals."""
    whole, fraction = _whole(number), _fraction(number)

    def form(decimals: Column) -> Column:
        kept = F.concat(whole, F.substring(fraction, F.lit(1), decimals)).cast("decimal(38,0)")
        up = (F.substring(fraction, decimals + 1, F.lit(1)) >= "5").cast("int")
        digits = (kept + up).cast("string")
        digits = F.lpad(digits, F.greatest(F.length(digits), decimals + 1), "0")
        return _plain(number, F.substring(digits, F.lit(1), F.length(digits) - decimals), F.right(digits, decimals))

    short = (F.length(whole) + F.length(fraction) <= ROUNDED_DIGITS) & (fraction != "")
    cuts = F.when(short, F.sequence(F.lit(0), F.length(fraction) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(number), F.transform(cuts, form))


def sentences(text: Column) -> Column:
    """Every sentence, trimmed: cut after . ! ? followed by blank space, and at line breaks."""
    cut = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    pieces = F.transform(F.split(cut, "\n"), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: F.length(s) > 0)


def is_abstention(sentence: Column, phrases: tuple[str, ...] = ABSTENTIONS) -> Column:
    text = F.replace(F.lower(sentence), F.lit("’"), F.lit("'"))
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def is_question(sentence: Column) -> Column:
    return F.rtrim(sentence).endswith("?")
