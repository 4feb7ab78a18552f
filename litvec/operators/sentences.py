"""Sentence ends that are learned from the corpus.

A full stop before white space ends a sentence unless it belongs to an abbreviation, an initial or an
ordinal number. Which words are abbreviations, which words start sentences and which follow ordinals is
decided by log-likelihood ratios over counts of the whole corpus, in the manner of published work on
unsupervised sentence detection. The corpus is read once; everything else works on counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.functions import text as tx
from litvec.functions.columns import col, let
from litvec.runtime import BROADCAST_ROWS, stage

# Published thresholds of the three ratios.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
# Share of full stops behind an abbreviation that the ratio is tested against.
_ALWAYS = 0.99
# What may stand between the end of a sentence and the white space, and the words that may be ends.
CLOSERS = "\"'”’»)\\]}"
_TAIL = rf"[.!?]+[{CLOSERS}]*\z"
_NUMBER = r"\A[0-9][0-9.,]*\z"
NUMBER = "#"

COUNTS = "type string, mark string, next string, n long"


def word_type(word: Column) -> Column:
    """A word in lower case without what is no letter or digit at its ends; a number is ``#``."""
    bare = F.lower(F.regexp_replace(word, r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))
    return let(bare, lambda t: F.when(t.rlike(_NUMBER), NUMBER).otherwise(t))


def _mark(word: Column) -> Column:
    """``!`` ends a sentence, ``.`` and ``…`` may; ``,`` has its full stop before another mark; else empty.

    A full stop that stands behind a bracket or a quote belongs to no abbreviation.
    """
    return (
        F.when(word.rlike(r"[!?][.!?]*" + rf"[{CLOSERS}]*\z"), "!")
        .when(word.rlike(r"\.\.+" + rf"[{CLOSERS}]*\z"), "…")
        .when(word.rlike(rf"[\p{{L}}\p{{N}}]\.[{CLOSERS}]*\z"), ".")
        .when(word.rlike(rf"\.[{CLOSERS}]*\z"), "!")
        .when(word.rlike(r"[\p{L}\p{N}]\.[^\p{L}\p{N}.]+\z"), ",")
        .otherwise("")
    )


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``type, mark, next, n``: how often words occur, and before which others where they may end a sentence.

    Words are counted as they are spelled in the tasks that read them, and patterns meet each spelling once; only
    counts are shuffled. The word behind is kept for possible ends alone, as nothing else asks for it. The start of
    a text counts as an end before it, with the mark ``^`` and no type.
    """

    def spelled(w: Column, behind: Column, start: bool) -> Column:
        return F.struct(w.alias("word"), behind.alias("behind"), F.lit(start).alias("start"))

    def word(words: Column, w: Column, i: Column) -> Column:
        # No other word has a mark that asks for the word behind.
        may_end = w.contains(".") | w.contains("!") | w.contains("?")
        return spelled(w, F.when(may_end, F.coalesce(F.get(words, i + 1), F.lit(""))), False)

    def counted(words: Column) -> Column:
        return F.concat(F.array(spelled(F.lit(""), words[0], True)), F.transform(words, lambda w, i: word(words, w, i)))

    words = df.select(F.inline(let(F.split(tx.single_spaced(text), " "), counted)))
    words = words.groupBy("word", "behind", "start").agg(F.count("*").alias("n"))
    kind, mark = (F.when(F.col("start"), first).otherwise(rest) for first, rest in (("", word_type(F.col("word"))), ("^", _mark(F.col("word")))))
    marked = words.select(kind.alias("type"), mark.alias("mark"), "behind", "n")
    following = F.when(F.col("mark").isin("!", ".", "^"), word_type(F.col("behind")))
    return marked.select("type", "mark", following.alias("next"), "n").groupBy("type", "mark", "next").agg(F.sum("n").alias("n"))


def _times_log(count: Column, share: Column) -> Column:
    """``count`` times the logarithm of ``share``; nothing for nothing."""
    return F.when(count > 0, count * F.ln(share)).otherwise(0.0)


def _ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Log-likelihood ratio of two words next to each other: ``both`` of ``first`` and ``second`` in ``total`` words."""

    def fit(k: Column, n: Column, share: Column) -> Column:
        return _times_log(k, share) + _times_log(n - k, 1 - share)

    rest, others = second - both, total - first
    share = second / total
    return 2 * (fit(both, first, both / first) + fit(rest, others, rest / others) - fit(both, first, share) - fit(rest, others, share))


def learn(df: DataFrame, text: str = "text") -> DataFrame:
    """The model of a corpus: ``kind, type, n, together, score`` of abbreviations, starters and words behind ordinals.

    ``n`` counts a type in the corpus, ``together`` with its full stop, after an end, or after a number
    with a full stop. Null and empty texts count nothing, and an empty corpus gives an empty model.
    """
    counts = stage(word_counts(df, text), "word-counts")
    dotted = F.col("mark").isin(".", ",")
    types = stage(
        counts.where("type <> ''").groupBy("type").agg(
            F.sum("n").alias("n"), F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("dotted")
        ),
        "word-types",
    )
    told = types.agg(F.sum("n").alias("total"), F.sum("dotted").alias("stops")).first()
    total, stops = (F.lit(told[c] or 0) for c in ("total", "stops"))
    k, plain = F.col("dotted"), F.col("n") - F.col("dotted")
    share = stops / total
    ratio = -2 * (
        _times_log(k, share) + _times_log(plain, 1 - share) - k * F.ln(F.lit(_ALWAYS)) - plain * F.ln(F.lit(1 - _ALWAYS))
    )
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters
    # Short words, words with full stops inside and words hardly ever seen without one are likelier abbreviations.
    weight = F.exp(-letters) * (inner + 1) * F.pow(letters, -plain)
    words = F.col("type").rlike(r"\p{L}")
    abbreviations = stage(
        types.where((k > 0) & words)
        .select("type", "n", k.alias("together"), (ratio * weight).alias("score"))
        .where(F.col("score") >= ABBREVIATION),
        "abbreviations",
    )

    def behind(pairs: DataFrame, least: float) -> DataFrame:
        """Types that follow the given ends more often than they would by chance."""
        after = pairs.groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("together"))
        ends = F.lit(pairs.agg(F.sum("n").alias("ends")).first()["ends"] or 0)
        scored = after.where(F.col("type").rlike(r"\p{L}")).join(types, "type")
        score = _ratio(F.col("together"), ends, F.col("n"), total)
        more = F.col("together") / ends > F.col("n") / total
        return scored.where(more).select("type", "n", "together", score.alias("score")).where(F.col("score") >= least)

    pairs = counts.where(F.col("mark").isin("!", ".", "^") & (F.col("next") != ""))
    certain = pairs.join(abbreviations.select("type"), "type", "left_anti").where((F.length("type") > 1) | (F.col("mark") != "."))
    starters = stage(behind(certain, STARTER), "starters")
    ordinals = behind(pairs.where((F.col("type") == NUMBER) & (F.col("mark") == ".")), COLLOCATION)
    ordinals = ordinals.join(starters.select("type"), "type", "left_anti")
    named = [
        part.select(F.lit(kind).alias("kind"), "type", "n", "together", "score")
        for kind, part in (("abbreviation", abbreviations), ("starter", starters), ("ordinal", ordinals))
    ]
    return named[0].union(named[1]).union(named[2])


@dataclass(frozen=True)
class SentenceModel:
    """The learned words, small enough for every task: sets of types by kind."""

    abbreviations: tuple[str, ...]
    starters: tuple[str, ...]
    ordinals: tuple[str, ...]

    @staticmethod
    def of(model: DataFrame, most: int = BROADCAST_ROWS) -> SentenceModel:
        """The words of a table that ``learn`` made; more than ``most`` of them raise, as every task would hold them."""
        rows = model.select("kind", "type").orderBy("kind", "type").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} learned words; raise the thresholds or learn from less noisy texts")
        kinds = ("abbreviation", "starter", "ordinal")
        return SentenceModel(*(tuple(r.type for r in rows if r.kind == kind) for kind in kinds))

    def _together(self, piece: Column, following: Column) -> Column:
        """True where the possible end of a piece does not end a sentence."""
        # A possible end has no blank behind it.
        word, after = F.substring_index(piece, " ", -1), F.substring_index(F.ltrim(following), " ", 1)
        capital, small = (after.rlike(rf"\A[^\p{{L}}\p{{N}}]*\p{{{c}}}") for c in ("Lu", "Ll"))

        def judged(mark: Column, kind: Column, next_kind: Column) -> Column:
            known = (F.length(kind) == 1) & (kind != NUMBER) | kind.isin(*self.abbreviations)
            starts = capital & next_kind.isin(*self.starters)
            return (
                F.when(mark == "!", False)
                .when(mark == "…", ~capital)
                .when(known, ~starts)
                .when(kind == NUMBER, small | next_kind.isin(*self.ordinals))
                .otherwise(False)
            )

        facts = F.struct(_mark(word).alias("mark"), word_type(word).alias("kind"), word_type(after).alias("next"))
        return let(facts, lambda f: judged(f["mark"], f["kind"], f["next"]))

    def sentence_pieces(self, text: Column | str) -> Column:
        """Sentences with the blank before them kept: joined without separator they are the single-spaced text.

        A sentence ends at full stops, question or exclamation marks, and closing quotes or brackets
        behind them, before white space, unless the model says otherwise.
        """
        possible = F.split(F.regexp_replace(tx.single_spaced(col(text)), rf"([.!?][{CLOSERS}]*) ", "$1\n "), "\n")

        def joined(pieces: Column) -> Column:
            def with_end(piece: Column, i: Column) -> Column:
                last = i + 1 >= F.size(pieces)
                return F.when(last | self._together(piece, F.get(pieces, i + 1)), piece).otherwise(F.concat(piece, F.lit("\n")))

            return F.split(F.array_join(F.transform(pieces, with_end), ""), "\n")

        return let(possible, joined)

    def sentences(self, text: Column | str) -> Column:
        trimmed = F.transform(self.sentence_pieces(text), lambda s: F.ltrim(s))
        return F.filter(trimmed, lambda s: s != "")


def split_sentences(df: DataFrame, model: SentenceModel, text: str = "text") -> DataFrame:
    """One row per sentence in place of the text, numbered in ``sentence_no``."""
    rest = [c for c in df.columns if c != text]
    found = df.select(*rest, F.posexplode(model.sentences(text)).alias("_no", text))
    return found.select(*rest, F.col("_no").cast("long").alias("sentence_no"), text)
