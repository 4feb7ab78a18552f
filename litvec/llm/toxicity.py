"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers follow insults, threats, targets, negation and reported speech. Their
composition reads the classes of a clause's words and says for every insult or threat whether it
is aimed at somebody, negated or reported. The kinds of matched clauses are weighed, not words.
Terms and weights are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.llm.common import text_or_empty
from litvec.runtime import small_side, stage

FIT_ROWS = 8_000  # labelled rows that the fit reads at most, by the order of a hash of their id
EVIDENCE = 30.0  # a term's log-likelihood ratio against chance
PURITY = 20.0  # how much likelier a term is in toxic rows
STEMS = (4, 5, 6, 7)  # beginnings of words that stand for their inflections
THRESHOLD = 0.7

# Fixed word lists of the grammar in the languages of the corpus, lower case.
TARGETS = """you your you're yours he she they him her them his their this that these those who
du dich dir dein deine ihr euch euer er sie ihn ihm dieser diese dieses
tu toi ton ta tes vous votre vos il elle ils elles lui leur ce cet cette ces
tú ti tu te usted ustedes vuestro su él ella ellos ellas este esta ese esa""".split()
NEGATIONS = """not no never none nobody isn't aren't wasn't don't doesn't hardly without
nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin""".split()
REPORTS = """said says say told tells wrote writes called calls quoted according reportedly claimed
sagte sagt schrieb nannte laut angeblich dit disait écrit appelé selon dijo dice escribió llamó según""".split()
THREATS = """kill hurt beat destroy shoot stab burn punch strangle murder
töten umbringen schlagen erschießen verbrennen tuer frapper détruire brûler étrangler
matar golpear destruir quemar disparar""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_FIXED = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
NEAR = 4  # words over which a target or a negation reaches

WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
CLAUSES = re.compile(r"[.!?;:\n]+")


def _reach(symbol: int):
    """State: words since the symbol, at most NEAR. Output on a term: whether the symbol reaches it."""

    def step(state: int, seen: int) -> tuple[int, int]:
        return (0 if seen == symbol else min(NEAR, state + 1)), int(state < NEAR)

    return NEAR, step


def _since(symbol: int):
    """State and output: whether the symbol came before in the clause."""

    def step(state: int, seen: int) -> tuple[int, int]:
        return int(state or seen == symbol), state

    return 0, step


def _hits():
    """Output: 0 nothing, 1 an insult, 2 a threat."""

    def step(state: int, seen: int) -> tuple[int, int]:
        return 0, {INSULT: 1, THREAT: 2}.get(seen, 0)

    return 0, step


def compose(*machines) -> tuple[dict, tuple]:
    """The machines run side by side as one table: (states, symbol) -> (states, outputs)."""
    start = tuple(m[0] for m in machines)
    arcs: dict = {}
    todo = [start]
    while todo:
        states = todo.pop()
        for symbol in range(6):
            if (states, symbol) in arcs:
                continue
            steps = [step(state, symbol) for (_, step), state in zip(machines, states)]
            following = tuple(s for s, _ in steps)
            arcs[states, symbol] = following, tuple(o for _, o in steps)
            todo.append(following)
    return arcs, start


ARCS, START = compose(_hits(), _reach(TARGET), _reach(NEGATION), _since(REPORT))

# Kinds of matched clauses: insult or threat, aimed, negated, reported; weights before the fit.
KINDS = [(t, a, n, r) for t in (1, 2) for a in (0, 1) for n in (0, 1) for r in (0, 1)]
PRIOR = np.array([(0.5 if n or r else 2.0 + a) if t == 1 else (0.0 if n or r else 0.5 + 2.0 * a) for t, a, n, r in KINDS])
_AT = {kind: i for i, kind in enumerate(KINDS)}


@dataclass(frozen=True)
class Model:
    """Learned terms, by full word and by beginning, and the weights of the features."""

    words: frozenset[str]
    stems: tuple[tuple[int, frozenset[str]], ...]
    weights: tuple[float, ...]

    def is_term(self, word: str) -> bool:
        return word in self.words or any(word[:n] in s for n, s in self.stems)


def matches(model: Model, text: str) -> np.ndarray:
    """Matches in clauses of each kind; a clause is of the kind of its strongest match."""
    counts = np.zeros(len(KINDS))
    lower = text.lower()
    distinct = set(WORDS.findall(lower))
    terms = distinct & model.words
    for n, stems in model.stems:
        terms.update(w for w in distinct if w[:n] in stems)
    if not terms and distinct.isdisjoint(THREATS):
        return counts
    for clause in CLAUSES.split(lower):
        words = WORDS.findall(clause)
        states, best, hits = START, None, 0
        for word in words:
            symbol = INSULT if word in terms else _FIXED.get(word, OTHER)
            states, (term, aimed, negated, reported) = ARCS[states, symbol]
            if term:
                hits += 1
                kind = _AT[term, aimed, negated, reported]
                if best is None or PRIOR[kind] > PRIOR[best]:
                    best = kind
        if best is not None:
            counts[best] += hits
    return counts


def _features(counts: np.ndarray, words: int) -> np.ndarray:
    """Matches by kind, matches in a hundred words, the length if there are matches, and the bias."""
    found = counts.sum()
    return np.concatenate([np.log1p(counts), [np.log1p(100 * found / words), np.log1p(words) * (found > 0), 1.0]])


def score(model: Model, text: str) -> float:
    z = float(_features(matches(model, text), text.count(" ") + 1) @ np.array(model.weights))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; each weight has a normal prior around its first value."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    prior = np.concatenate([PRIOR, [0.0, 0.0, np.log(rate / (1 - rate))]])
    precision = np.concatenate([np.full(len(PRIOR) + 2, 0.25), [0.02]])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + precision * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(precision)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(documents: DataFrame, labels: DataFrame, rows: int, doc_id: str, text: str) -> DataFrame:
    """At most ``rows`` labelled rows that are not held out: ``text, toxic``."""
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    own = documents.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return own.join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _words(sample: DataFrame) -> DataFrame:
    """Every word with its neighbours."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    around = F.arrays_zip(
        F.concat(F.array(F.lit("")), F.col("w")).alias("before"), F.col("w").alias("word"), F.expr("slice(w, 2, size(w))").alias("after")
    )
    return sample.select(words.alias("w")).select(F.inline(around)).where("word is not null").toDF("before", "word", "after")


def _terms(words: DataFrame, *others: str) -> DataFrame:
    """The word and its beginnings, marked by their length; a full word by 0."""
    cut = [F.when(F.length("word") >= n, F.concat(F.lit(f"{n}:"), F.substring("word", 1, n))) for n in STEMS]
    whole = F.concat(F.lit("0:"), "word")
    return words.select(*others, F.explode(F.array_compact(F.array(whole, *cut))).alias("term"))


def learned_terms(sample: DataFrame) -> DataFrame:
    """Words and beginnings of words: in how many contexts of toxic rows (``t``), how often in others (``c``).

    A context is the word with its neighbours, so a toxic text with many copies gives one. A
    beginning stands for several words; one that is nearly always the same word is left to it.
    """
    by_word = _words(sample.where("toxic = 1")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    found = (
        _terms(by_word, "n")
        .groupBy("term")
        .agg(F.sum("n").alias("t"), F.max("n").alias("top"))
        .where("t >= 4 and (term like '0:%' or top <= 0.8 * t)")
    )
    found = small_side(found.select("term", "t"), "terms")
    others = _terms(_words(sample.where("toxic <> 1"))).join(found.select("term"), "term").groupBy("term")
    return found.join(others.agg(F.count("*").alias("c")), "term", "left").fillna(0, ["c"])


def fit(
    documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Learn terms and weights from at most ``rows`` labelled rows (``doc_id, toxic``).

    Rows with crc32(doc_id as text) mod 3 = 1 are held out. Of the documents only the texts of
    the sample are read. Without labelled rows there are no terms and the first weights stand.
    """
    sample = stage(_sample(documents, labels, rows, doc_id, text), "labelled")
    terms = learned_terms(sample)
    all_t = max(1, _words(sample.where("toxic = 1")).distinct().count())
    all_c = max(1, _words(sample.where("toxic <> 1")).count())
    share = all_t / (all_t + all_c)
    n, t = F.col("t") + F.col("c"), F.col("t").cast("double")
    ratio = 2 * (
        t * F.log(t / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0)
    )
    likelier = (t / all_t) / ((F.col("c") + 0.5) / all_c)
    found = terms.where("t > 0").where((likelier >= PURITY) & (ratio >= EVIDENCE)).select("term").collect()
    by = {}
    for row in found:
        size, _, term = row.term.partition(":")
        by.setdefault(int(size), set()).add(term)
    model = Model(frozenset(by.pop(0, ())), tuple((k, frozenset(by[k])) for k in sorted(by)), ())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_features(matches(model, s), s.count(" ") + 1).tolist() for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast("double")], ["x", "y"])

    seen = sample.mapInArrow(features, "x array<double>, y double").toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(KINDS) + 3)
    weights = _fit_weights(x, (seen["y"].to_numpy(float) == 1).astype(float))
    return Model(model.words, model.stems, tuple(weights))


def toxicity(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row, read in whole and by its text alone.

    A null text counts as empty; a text without a match has the score of the bias. Rows that
    repeat stay, a null id stays null, an empty table gives an empty one. Nothing is shuffled.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([score(model, s) for s in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype("i4"))],
                ["doc_id", "score", "predicted"],
            )

    return df.select(F.col(doc_id).cast("long"), text_or_empty(text)).mapInArrow(
        scored, "doc_id long, score double, predicted int"
    )


def drop_toxic(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose text is not predicted toxic; the model is fitted on ``df``."""
    model = fit(df, labels, doc_id=doc_id, text=text)
    own = df.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(own.index(text)).to_pylist()
            yield batch.filter(pa.array([score(model, s or "") < THRESHOLD for s in texts], pa.bool_()))

    return df.mapInArrow(kept, df.schema)
