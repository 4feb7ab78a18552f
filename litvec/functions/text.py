"""Text rules as columns. None of them needs Python workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from litvec.functions.columns import col, let

# The characters that count as white space when a text is stripped or split into words.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a class that costs little to test: one table for the first 256, and one range check
# before the others are looked at.
_LOW = "".join(rf"\x{ord(c):02X}" for c in WHITESPACE_CHARS if c < "\u0100")
_HIGH = "".join(rf"\x{{{ord(c):X}}}" for c in WHITESPACE_CHARS if c >= "\u0100")
_SPACE = rf"{_LOW}[\x{{1680}}-\x{{3000}}&&[{_HIGH}]]"
# Holds all of them but blank, tab and line ends, and more: a text without any of these needs no pattern.
_PERHAPS_SPACE = re.sub(r"\\x(09|0A|0D|20)", "", _LOW) + r"\x{1680}-\x{3000}"
# The marks that may end a passage; any other ending gets a full stop.
END_MARKS = ("!", ",", ".", "?", '"', "'")

# A token is a run of letters, digits and underscores, or one other visible character.
MARK = r"[^\w\p{L}\p{N} ]"
TOKEN = rf"[\w\p{{L}}\p{{N}}]+|{MARK}"
# The same with the blank before it, so that joined pieces give the text back as it was spelled.
PIECE = rf" ?(?:{TOKEN})"


def strip(text: Column | str) -> Column:
    """Remove white space of every kind at both ends (``trim`` knows the blank only)."""
    return F.btrim(col(text), F.lit(WHITESPACE_CHARS))


def single_spaced(text: Column | str) -> Column:
    """White space of every kind and length as one blank. Most texts need no pattern for it."""
    plain = col(text)
    for c in "\n\t\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    spaced = let(
        plain,
        lambda t: F.when(
            t.contains("  ") | t.rlike(f"[{_PERHAPS_SPACE}]"), F.regexp_replace(t, f"[{_SPACE}]++", " ")
        ).otherwise(t),
    )
    return F.btrim(spaced, F.lit(" "))


def normalise_section(section: Column | str) -> Column:
    return strip(F.lower(col(section)))


def with_end_mark(text: Column | str) -> Column:
    """Append a full stop unless the text already ends in one of ``END_MARKS``."""
    text = col(text)
    return F.when(F.substring(text, -1, 1).isin(*END_MARKS), text).otherwise(F.concat(text, F.lit(".")))


def has_more_words_than(text: Column | str, n: int) -> Column:
    """True for more than ``n`` words separated by white space; reads no further than word n+1."""
    word, gap = f"[^{_SPACE}]++", f"[{_SPACE}]++"
    return col(text).rlike(rf"\A[{_SPACE}]*+{word}(?:{gap}{word}){{{n}}}")


def sentence_pieces(text: Column | str) -> Column:
    """Sentences with the blank before them kept: joined without separator they are the text again.

    A sentence ends at ``.``, ``!`` or ``?`` before white space. All white space is a blank by
    then, so a newline can mark the borders.
    """
    marked = single_spaced(text)
    for mark in ".!?":
        marked = F.replace(marked, F.lit(f"{mark} "), F.lit(f"{mark}\n "))
    return F.split(marked, "\n")


def sentences(text: Column | str) -> Column:
    trimmed = F.transform(sentence_pieces(text), lambda s: F.ltrim(s))
    return F.filter(trimmed, lambda s: s != "")


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(single_spaced(text), F.lit(TOKEN), F.lit(0))


def token_pieces(sentence: Column) -> Column:
    """Tokens of an already single-spaced sentence, each with the blank before it."""
    return F.regexp_extract_all(sentence, F.lit(PIECE), F.lit(0))


def joined_authors(authors: Column | str) -> Column:
    return F.array_join(col(authors), " and ")


def parse_date(text: Column | str, strict: bool = False) -> Column:
    """Timestamp of a date text; a bad value gives null, or raises when ``strict``."""
    return F.to_timestamp(col(text)) if strict else F.try_to_timestamp(col(text))
