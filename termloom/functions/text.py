"""Column functions over strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"


def is_number(c: Column) -> Column:
    """True where the text reads as a floating-point number (ASCII digits; single underscores between digits)."""
    return c.rlike(_NUMBER)


def to_number(c: Column) -> Column:
    """The value of a text that :func:`is_number`, else null."""
    bare = F.regexp_replace(F.trim(c), "_", "")
    bare = F.when(bare.rlike("(?i)^[+-]nan$"), F.lit("nan")).otherwise(bare)
    return F.when(is_number(c), bare.try_cast("double"))


def words(c: Column) -> Column:
    """Words parted by single or repeated blanks, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


#: What sets words and punctuation apart, in turn, as treebanks part them: pattern and replacement.
WORD_STEPS = (
    (r"``|''|\"", ' " '),  # quotes of all kinds are one token
    (r"([:,])([^0-9])", r" $1 $2"),
    (r"\.{2,}", " $0 "),
    (r"[;@#$%&?!*]", " $0 "),
    (r"([^.])(\.)([\])}>\"' ]*)$", "$1 $2 $3 "),
    (r"[\[\](){}<>]", " $0 "),
    (r"--", " -- "),
    (r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|') ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gim|lem)(me)\b", "$1 $2"),
    (r"(?i)\b(gon|wan)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
    (r"(?i)\b(d)('ye)\b", "$1 $2"),
    (r"(?i)\b(more)('n)\b", "$1 $2"),
    (r"(?i) ('t)(is|was)\b", " $1 $2"),
)


def word_tokens(c: Column) -> Column:
    """Words with punctuation, quotes, dashes, ellipses and contractions set apart.

    ``blood (whole), 48h`` gives ``blood ( whole ) , 48h``; ``don't`` gives ``do n't``. A comma or colon stays before a
    digit. A stop is set apart at the text's end only, since no model of sentences is at hand.
    """
    out = F.concat(F.lit(" "), F.regexp_replace(c, r"\s", " "), F.lit(" "))
    for pattern, to in WORD_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return words(out)


def alnum_core(c: Column) -> Column:
    """The longest stretch from an ASCII letter or digit to another, or the empty text (two at least)."""
    return F.regexp_extract(c, "[0-9a-zA-Z]+.*[0-9a-zA-Z]+", 0)


def uncapitalize(c: Column) -> Column:
    """Words that have only their first letter in upper case get it in lower case; words of one letter stay; blanks collapse."""
    return F.array_join(
        F.transform(words(c), lambda w: F.when(w.rlike("^[A-Z][^A-Z]+$"), F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)),
        " ",
    )


def time_and_unit(c: Column) -> Column:
    """struct(number, unit, expanded): of texts like ``48h``; null where there is no known unit, number null if empty."""
    pattern = r"^([0-9]*)\s*(h|hr|mo|d|min)$"
    unit = F.regexp_extract(c, pattern, 2)
    full = F.create_map(*[F.lit(x) for kv in TIME_UNITS.items() for x in kv])
    number = F.regexp_extract(c, pattern, 1)
    return F.when(unit != "", F.struct(F.when(number != "", number).alias("number"), unit.alias("unit"), F.try_element_at(full, unit).alias("expanded")))


#: The units of time that are written out.
TIME_UNITS = {"h": "hour", "hr": "hour", "mo": "month", "d": "day", "min": "minute"}


def library_layout(c: Column) -> Column:
    """What stands before the first ``-``, trimmed."""
    return F.trim(F.split_part(c, F.lit("-"), F.lit(1)))


def char_counts_distance(a: Column, b: Column) -> Column:
    """Bag distance: the larger of the two one-sided differences of the texts' character multisets.

    It bounds the edit distance from below. Characters are counted by sorted arrays; no text is exploded.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    both = F.array_distinct(F.concat(chars(a), chars(b)))
    count = lambda c, x: F.size(F.filter(chars(c), lambda y: y == x))
    side = lambda p, q: F.aggregate(both, F.lit(0), lambda s, x: s + F.greatest(count(p, x) - count(q, x), F.lit(0)))
    return F.greatest(side(a, b), side(b, a))
