"""Search hits to chat prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litvec.operators.passages import UNKNOWN

# The default role and task of the prompt, and the texts of the tagged variant.
ROLE = """You are a cautious AI assistant. You are able to find concise answers to the questions only from the contextual passage snippets provided.
    Please check the context information carefully and do not use information that is not relevant to the question. If the retrieved context does not provide useful information to answer the question, say that you do not know."""
TASK = """
    Use the following pieces of information in the "Context" section to provide an answer to the "Question".
    Each context is annotated with a dictionary of metadata, such as "pmid" which is the pubmed ID of the publication that the context is from.
    """
TAGGED_ROLE = """
You are a biological and biomedical Knowledge graph (KG) LLM. You are a cautious assistant
proficient in creating knowledge graphs for biological and biomedical use cases. 
You are able to find answers to the questions from the contextual passage snippets provided and their affiliated pubmed articles.
Please check the context information carefully and do not use information that is not relevant to the question.
If the retrieved context doesn't provide useful information to answer the question, say that you don't know.
"""
TAGGED_TASK = """
Use the following pieces of information enclosed in <context> tags sourced from pubmed ids enclosed in <pmid> to provide an answer to the question enclosed in <question> tags.
"""
TAGGED_RESTRICTIONS = """
Only use academic papers from pubmed or biorxiv to support your answer. 
"""
CONTEXT_LINE = ' - "%s" {"pmid":"%s"}\n        '
TAGGED_LINE = "<context>%s</context><pmid>%s</pmid>\n"
TAGGED_QUESTION_END = "<\\question>"


def _in_rank_order(hits: DataFrame, line: Column) -> DataFrame:
    """One text per query from a line per hit. A query has at most k hits, so its group is small."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ranked, lambda h: h["line"]), "").alias("context"))


def _formatted(template: str, text: Column, pmid: Column) -> Column:
    before, between, after = template.split("%s")
    return F.concat(F.lit(before), _known(text), F.lit(between), _known(pmid), F.lit(after))


def _known(value: Column) -> Column:
    """A null, which would make the whole line null, as the collection writes it."""
    return F.coalesce(value.cast("string"), F.lit(UNKNOWN))


def _escaped(text: Column, escape: bool) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')) if escape else text


def context(hits: DataFrame, escape: bool = False) -> DataFrame:
    """Context section per query: the quoted text and id of every hit in rank order."""
    line = _formatted(CONTEXT_LINE, _escaped(F.col("entity.text"), escape), F.col("entity.pmid"))
    return _in_rank_order(hits, line).select("query_id", F.concat(F.lit("Context:\n"), "context").alias("context"))


def _messages(role: str, content: Column) -> Column:
    def message(who: str, what: Column) -> Column:
        return F.struct(F.lit(who).alias("role"), what.alias("content"))

    return F.array(message("system", F.lit(role)), message("user", content))


def messages(
    questions: DataFrame, hits: DataFrame, role: str = ROLE, task: str = TASK, escape: bool = False
) -> DataFrame:
    """Prompt per question ``(query_id, text)``: a system and a user message.

    A question without hits keeps an empty context.
    """
    joined = questions.select("query_id", F.col("text").alias("question")).join(
        context(hits, escape), "query_id", "left"
    )
    content = F.concat(
        F.lit(task + 'Question: "'),
        _known(_escaped(F.col("question"), escape)),
        F.lit('".\n'),
        F.coalesce("context", F.lit("Context:\n")),
    )
    return joined.select("query_id", _messages(role, content).alias("messages"))


def tagged(
    questions: DataFrame,
    hits: DataFrame,
    role: str = TAGGED_ROLE,
    task: str = TAGGED_TASK,
    restrictions: str = TAGGED_RESTRICTIONS,
    well_formed: bool = False,
) -> DataFrame:
    """Prompt per question with tags around context, id and question.

    The question closes with a backslash in its end tag unless ``well_formed``.
    """
    lines = _in_rank_order(hits, _formatted(TAGGED_LINE, F.col("entity.text"), F.col("entity.pmid")))
    end = "</question>" if well_formed else TAGGED_QUESTION_END
    content = F.concat(
        F.lit(task),
        F.coalesce("context", F.lit("")),
        F.lit("<question>"),
        _known(F.col("question")),
        F.lit(f"{end}\nHere are some restrictions: {restrictions}\n"),
    )
    joined = questions.select("query_id", F.col("text").alias("question")).join(lines, "query_id", "left")
    return joined.select("query_id", _messages(role, content).alias("messages"))


def message_columns(prompts: DataFrame) -> DataFrame:
    """The two messages as columns ``system`` and ``user``."""
    return prompts.select(
        "query_id",
        F.col("messages")[0]["content"].alias("system"),
        F.col("messages")[1]["content"].alias("user"),
    )
