"""Documents to chunk tables, document by document inside its own row: no shuffle at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.functions import text as tx
from litvec.functions.columns import let
from litvec.functions.packing import PLAIN, Splitter
from litvec.functions.packing import chunks as packed
from litvec.operators import passages as ps

# Chunk limits of the demo configuration and of the notebooks.
DEMO_MAX_TOKENS = 100
NOTEBOOK_MAX_TOKENS = 350


def _kept_passages(sections: Sequence[str], more_than: int) -> Column:
    """Section and cleaned text of a document's passages that belong to a kept section and are long enough."""

    def cleaned(passage: Column) -> Column:
        return F.struct(
            tx.normalise_section(ps.section_of(F.col("pmcid"), passage["infons"])).alias("section"),
            tx.with_end_mark(tx.strip(passage["text"])).alias("text"),
        )

    return F.filter(
        F.transform("passages", cleaned),
        lambda p: p["section"].isin(*sections) & tx.has_more_words_than(p["text"], more_than),
    )


def without_chunks(
    documents: DataFrame, sections: Sequence[str] = ps.DEFAULT_SECTIONS, more_than: int = ps.MIN_WORDS
) -> DataFrame:
    """Documents that give no chunk, found in their own row: no text is packed and nothing is joined.

    A kept passage has words, so a document gives chunks if and only if it has one.
    """
    return documents.where(F.coalesce(F.size(_kept_passages(sections, more_than)), F.lit(0)) <= 0)


def section_texts(
    documents: DataFrame, sections: Sequence[str] = ps.DEFAULT_SECTIONS, more_than: int = ps.MIN_WORDS
) -> DataFrame:
    """Cleaned text of every kept section of every document.

    The same rows as ``clean``, ``keep_sections``, ``min_words`` and ``collapse`` give, but a document
    comes as one row with all its passages, so nothing has to be grouped across rows.
    """

    def collected(kept: Column) -> Column:
        def section_text(name: Column) -> Column:
            own = F.filter(kept, lambda p: p["section"] == name)
            return F.struct(
                name.alias("section"), F.array_join(F.transform(own, lambda p: p["text"]), " ").alias("text")
            )

        names = F.array(*[F.lit(s) for s in sorted(sections)])
        return F.filter(F.transform(names, section_text), lambda s: s["text"] != "")

    kept = _kept_passages(sections, more_than)
    own = [c for c in documents.columns if c not in ("pmid", "pmcid", "date", "authors", "journal", "passages")]
    return documents.select(
        *own,
        F.col("pmid").cast("string").alias("pmid"),
        "pmcid",
        tx.parse_date("date").alias("date"),
        tx.joined_authors("authors").alias("authors"),
        "journal",
        F.explode(let(kept, collected)).alias("s"),
    ).select(*own, "s.section", "pmid", "pmcid", "date", "authors", "journal", "s.text")


def chunk_texts(texts: DataFrame, max_tokens: int = DEMO_MAX_TOKENS, splitter: Splitter = PLAIN) -> DataFrame:
    """Replace ``text`` by its chunks, one row each, numbered in ``chunk_no``; ``splitter`` says what a token is."""
    if max_tokens < 1:
        raise ValueError(f"max_tokens must be positive: {max_tokens}")
    rest = [c for c in texts.columns if c != "text"]
    return (
        texts.where(F.length(tx.strip("text")) > 0)
        .select(*rest, F.posexplode(packed("text", max_tokens, splitter)).alias("chunk_no", "c"))
        .select(*rest, F.col("chunk_no").cast("long").alias("chunk_no"), "c.text", "c.n_tokens")
    )


def to_chunks(
    documents: DataFrame,
    mode: str = "section",
    max_tokens: int = DEMO_MAX_TOKENS,
    sections: Sequence[str] = ps.DEFAULT_SECTIONS,
    splitter: Splitter = PLAIN,
) -> DataFrame:
    """Chunk table of documents: packed sections, or the passages as they are (``mode='sentence'``).

    ``chunk_no`` counts within (document, section), in sentence mode it is the passage position.
    """
    if mode == "section":
        return chunk_texts(section_texts(documents, sections), max_tokens, splitter)
    if mode == "sentence":
        kept = ps.min_words(ps.keep_sections(ps.clean(ps.flatten(documents), end_marks=False), sections))
        return kept.withColumnsRenamed({"sentence": "text", "index": "chunk_no"}).withColumn(
            "n_tokens", F.size(tx.tokens("text"))
        )
    raise ValueError(f"mode must be 'section' or 'sentence': {mode!r}")


def chunk_quality(texts: DataFrame, max_tokens: int = DEMO_MAX_TOKENS) -> DataFrame:
    """Per text: tokens before and after packing, counted anew on the emitted chunks.

    ``n_over`` chunks above the limit and a ``lost`` of 3 or more mark a text to look at; the
    run goes on.
    """

    def measured(chunk_sizes: Column) -> Column:
        return F.struct(
            F.size(chunk_sizes).cast("long").alias("n_chunks"),
            F.aggregate(chunk_sizes, F.lit(0).cast("long"), lambda acc, n: acc + n).alias("tokens_out"),
            F.size(F.filter(chunk_sizes, lambda n: n > max_tokens)).cast("long").alias("n_over"),
        )

    sizes = F.transform(packed("text", max_tokens), lambda c: F.size(tx.tokens(c["text"])))
    rest = [c for c in texts.columns if c != "text"]
    return texts.select(
        *rest, F.size(tx.tokens("text")).cast("long").alias("tokens_in"), let(sizes, measured).alias("m")
    ).select(*rest, "tokens_in", "m.*", F.abs(F.col("tokens_in") - F.col("m.tokens_out")).alias("lost"))
