"""Treebank tokens as columns, and back.

A single-spaced sentence is marked: a line end at every border between tokens that touch each other.
Nothing is changed or removed, so taking the line ends out gives the sentence again, and the
tokens are what lies between blanks and line ends. A few patterns set the marks; none needs Python.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from litvec.functions.columns import col, let

# The marks that are tokens of their own, and the clitics and words that treebanks cut in two.
MARKS = r",:;@#$%&?!()\[\]{}<>\"“”„«»…"
APOSTROPHES = "'’"
CLITICS = ("ll", "re", "ve", "s", "m", "d")
CUT_WORDS = (("can", "not"), ("gon", "na"), ("wan", "na"), ("got", "ta"), ("gim", "me"), ("lem", "me"))
OPENING, CLOSING = "``", "''"


def any_case(word: str) -> str:
    """A pattern for a word in small and capital letters, without the folding that regular expressions differ in."""
    return "".join(f"[{c}{c.upper()}]" for c in word)


_APOSTROPHE = f"[{APOSTROPHES}]"
_BEFORE, _AFTER = r"(\A|\n| )", r"(\n| |\z)"
_INSIDE = rf"([^{APOSTROPHES}\n ])"
_CLITIC = f"({any_case('n')}{_APOSTROPHE}{any_case('t')}|{_APOSTROPHE}(?:{'|'.join(map(any_case, CLITICS))}))"
# Fixed borders: patterns and what they become. A border that a match used up hides the next match, so some come twice.
_PUNCTUATION = (
    (rf"(--+|\.\.+|[{MARKS}])", "\n$1\n"),
    (r"\n([,:])\n([0-9])", "$1$2"),
    (rf"([^.\n ])\.([\n \])}}>\"”»{APOSTROPHES}]*)\z", "$1\n.$2"),
)
_QUOTED = (
    (rf"{_BEFORE}({_APOSTROPHE})([^\n ])", "$1$2\n$3"),
    (rf"{_BEFORE}({_APOSTROPHE})\n([tT])([iI][sS]|[wW][aA][sS]){_AFTER}", "$1$2$3\n$4$5"),
    (_INSIDE + _CLITIC + _AFTER, "$1\n$2$3"),
    (_INSIDE + _CLITIC + _AFTER, "$1\n$2$3"),
    (rf"{_INSIDE}({_APOSTROPHE}){_AFTER}", "$1\n$2$3"),
)
_WORDS = tuple((rf"{_BEFORE}({any_case(a)})({any_case(b)}){_AFTER}", "$1$2\n$3$4") for a, b in CUT_WORDS)
_TIDY = ((r"\n* \n*", " "), (r"\n\n+", "\n"), (r"\A\n+|\n+\z", ""))


def _replaced(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def _holds(text: Column, parts) -> Column:
    """Whether a text holds one of some parts, written in small letters, in letters of any size."""
    return let(F.lower(text), lambda small: reduce(or_, (small.contains(p) for p in parts)))


def _replaced_where(text: Column, parts, rules) -> Column:
    """``_replaced`` by rules that only match a text with one of ``parts``: looking for these costs less than the patterns."""
    return let(text, lambda t: F.when(_holds(t, parts), _replaced(t, rules)).otherwise(t))


def marked(sentence: Column | str) -> Column:
    """A sentence, single-spaced as ``text.sentence_pieces`` gives it, with a line end at borders without a blank."""
    cut = _replaced(col(sentence), _PUNCTUATION)
    cut = _replaced_where(cut, APOSTROPHES, _QUOTED)
    cut = _replaced_where(cut, [a + b for a, b in CUT_WORDS], _WORDS + _WORDS)
    return _replaced(cut, _TIDY)


def treebank_pieces(sentence: Column | str) -> Column:
    """Tokens with the blank before them: joined without separator they are the sentence again."""
    return F.filter(F.split(F.replace(marked(sentence), F.lit(" "), F.lit("\n ")), "\n"), lambda p: p != "")


def spelled(pieces: Column | str) -> Column:
    """The sentence that its pieces came from."""
    return F.array_join(col(pieces), "")


def _is_opening(pieces: Column, i: Column) -> Column:
    """A double quote opens where the next token touches it and the one before does not, or is an opening bracket."""
    behind = F.coalesce(F.get(pieces, i + 1), F.lit(" "))
    before = F.when(i == 0, F.lit("(")).otherwise(F.get(pieces, i - 1))
    free = F.get(pieces, i).startswith(" ") | (F.ltrim(before).isin("(", "[", "{", "<"))
    return free & ~behind.startswith(" ")


def treebank_tokens(sentence: Column | str) -> Column:
    """Tokens without blanks; double quotes read as an opening or a closing pair of marks, as treebanks write them."""

    def token(pieces: Column, p: Column, i: Column) -> Column:
        quote = F.when(_is_opening(pieces, i), OPENING).otherwise(CLOSING)
        return F.when(F.ltrim(p) == '"', quote).otherwise(F.ltrim(p))

    pieces = let(treebank_pieces(sentence), lambda ps: F.transform(ps, lambda p, i: token(ps, p, i)))
    return F.filter(pieces, lambda t: t != "")


# What touches the token before it, or behind it, when nothing is known but the tokens.
# Rules come with the parts that a text has to have for them, if most texts have none.
_OPENERS = ("``", *"([{<“„«$#@")
_JOINED = (
    (
        None,
        (
            (r" (''|[;?!%)\]}>”»…])", "$1"),
            (r" (\.+|[,:])([^\p{L}\p{N}]|\z)", "$1$2"),
            (r" (\.+|[,:])([^\p{L}\p{N}]|\z)", "$1$2"),
        ),
    ),
    (APOSTROPHES, ((rf" {_CLITIC}(?: |\z)", "$1 "), (rf" {_CLITIC}(?: |\z)", "$1 "))),
    (
        _OPENERS,
        (
            (r"(\A| )(``|[(\[{<“„«$#@]) ", "$1$2"),
            (r"(\A| |``|[(\[{<“„«$#@])(``|[(\[{<“„«$#@]) ", "$1$2"),
        ),
    ),
    (
        [f"{a} {b}" for a, b in CUT_WORDS],
        [(rf"(\A| )({any_case(a)}) ({any_case(b)})([^\p{{L}}\p{{N}}]|\z)", "$1$2$3$4") for a, b in CUT_WORDS],
    ),
    ((OPENING, CLOSING), (("``|''", '"'),)),
)


def detokenize(tokens: Column | str) -> Column:
    """A text for tokens of which nothing else is known, spaced as printed text usually is.

    The exact way back is ``spelled``, which needs the pieces.
    """
    text = F.array_join(col(tokens), " ")
    for parts, rules in _JOINED:
        text = _replaced(text, rules) if parts is None else _replaced_where(text, parts, rules)
    return F.btrim(text, F.lit(" "))
