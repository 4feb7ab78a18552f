"""The same results in DuckDB SQL, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from litvec.operators.prompts import (
    ROLE,
    TAGGED_QUESTION_END,
    TAGGED_RESTRICTIONS,
    TAGGED_ROLE,
    TAGGED_TASK,
    TASK,
)

# White space of every kind, as ranges.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIM = 64
NEWLINE = "chr(10)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def n_words(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array({expr}, '[{WS}]+'), lambda w: w <> ''))"


def spaced(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{WS}]+', ' ', 'g'))"


def sentence_list(expr: str) -> str:
    return rf"string_split(regexp_replace({spaced(expr)}, '([.!?]) ', '\1' || {NEWLINE} || ' ', 'g'), {NEWLINE})"


TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ ]"


def token_list(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOKEN}')"


# The sections kept by default.
SECTIONS = "('abstract','intro','results','discuss','methods','concl')"

# Passages of the stand-in documents.
PASSAGES = f"""
lines AS (SELECT *, string_split(text, {NEWLINE}) AS ls FROM documents),
numbered AS (SELECT doc_id, lang, source, n_chars, len(ls) AS n, unnest(range(len(ls))) AS index, unnest(ls) AS line FROM lines),
labelled AS (
  SELECT *, CASE WHEN n > 1 AND index = 0 THEN 'title' WHEN n > 8 AND index = n - 1 THEN 'ref'
    ELSE ['abstract','intro','methods','results','discuss','concl'][((6 * index) // n + 1)::INT] END AS label
  FROM numbered),
passages AS (
  SELECT index, CASE WHEN lang = 'en' THEN ' ' || upper(label) ELSE label || ' ' END AS section, line AS sentence,
    doc_id::VARCHAR AS pmid, CASE WHEN lang = 'en' THEN 'PMC' || doc_id END AS pmcid,
    (DATE '2015-01-01' + n_chars::INT)::VARCHAR AS date, 'A. ' || source || ' and B. ' || lang AS authors, source AS journal
  FROM labelled),
stripped AS (SELECT * REPLACE ({strip("sentence")} AS sentence, {strip("lower(section)")} AS section,
    date::TIMESTAMP AS date) FROM passages),
cleaned AS (SELECT * REPLACE (CASE WHEN regexp_matches(sentence, '[!,.?"'']\\z') THEN sentence ELSE sentence || '.' END AS sentence)
  FROM stripped)"""

KEPT = f"""{PASSAGES},
kept AS (SELECT * FROM cleaned WHERE section IN {SECTIONS} AND {n_words("sentence")} > 5)"""

COLLAPSED = f"""{KEPT},
collapsed AS (
  SELECT pmid, section, string_agg(sentence, ' ' ORDER BY index) AS text, any_value(pmcid) AS pmcid, any_value(date) AS date,
    any_value(authors) AS authors, any_value(journal) AS journal
  FROM kept GROUP BY pmid, section)"""


def packed(texts: str, key: str, limit: int, pieces: str = f"regexp_extract_all(s, ' ?(?:{TOKEN})')") -> str:
    """Chunks of the relation ``texts(key, text)`` as ``chunks(key, chunk_no, text, n_tokens)``."""
    return f"""
sized AS (
  SELECT {key}, sents, list_transform(sents, lambda s: len({pieces})) AS sizes,
    flatten(list_transform(sents, lambda s: {pieces})) AS pieces
  FROM (SELECT {key}, {sentence_list("text")} AS sents FROM {texts})),
{packed_sizes(key, limit)}"""


def packed_sizes(key: str, limit: int) -> str:
    """Chunks from ``sized(key, sizes, pieces)``: the sizes of the sentences and all their pieces."""
    return f"""
step AS (
  SELECT {key}, 0 AS i, 0::BIGINT AS start, 0::BIGINT AS len, CAST([] AS STRUCT(a BIGINT, n BIGINT)[]) AS done, sizes FROM sized
  UNION ALL
  SELECT {key}, i + 1,
    CASE WHEN len + sizes[i + 1] <= {limit} THEN start WHEN sizes[i + 1] > {limit} THEN start + len + sizes[i + 1] ELSE start + len END,
    CASE WHEN len + sizes[i + 1] <= {limit} THEN len + sizes[i + 1] WHEN sizes[i + 1] > {limit} THEN 0 ELSE sizes[i + 1] END,
    CASE WHEN len + sizes[i + 1] <= {limit} THEN [] ELSE list_concat(
      CASE WHEN len > 0 THEN [{{'a': start, 'n': len}}] ELSE [] END,
      CASE WHEN sizes[i + 1] > {limit} THEN list_transform(range(0, sizes[i + 1], {limit}),
        lambda x: {{'a': start + len + x, 'n': least({limit}, sizes[i + 1] - x)}}) ELSE [] END) END,
    sizes
  FROM step WHERE i < len(sizes)),
spans AS (
  SELECT {key}, s.a AS a, s.n AS n FROM (SELECT {key}, unnest(done) AS s FROM step)
  UNION ALL SELECT {key}, start, len FROM step WHERE i = len(sizes) AND len > 0),
chunks AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY a) - 1 AS chunk_no,
    trim(array_to_string(list_slice(pieces, a + 1, a + n), '')) AS text, n AS n_tokens
  FROM spans JOIN sized USING ({key}))"""


# Longest pieces of every distinct word: the longest edge from every place, and a walk along them.
WORD_PIECES = f"""
piece_words AS (SELECT DISTINCT unnest({token_list(f"lower({spaced('text')})")}) AS piece FROM benchmark),
starts AS (SELECT piece FROM piece_words UNION SELECT unnest(string_split(piece, '')) FROM piece_words),
vocabulary AS MATERIALIZED (SELECT piece AS key FROM starts UNION SELECT '##' || piece FROM starts),
doc_tokens AS MATERIALIZED (
  SELECT doc_id, i, j, unnest(ts) AS token, generate_subscripts(ts, 1) AS k
  FROM (SELECT doc_id, i, j, regexp_extract_all(s, ' ?(?:{TOKEN})') AS ts
    FROM (SELECT doc_id, unnest(sents) AS s, generate_subscripts(sents, 1) AS i, 0 AS j
      FROM (SELECT doc_id, {sentence_list("text")} AS sents FROM documents)))),
words AS MATERIALIZED (SELECT DISTINCT lower(ltrim(token, ' ')) AS word FROM doc_tokens),
edges AS MATERIALIZED (
  SELECT word, a, max(l) AS l
  FROM (SELECT word, unnest(range(length(word))) AS a FROM words),
    (SELECT unnest(range(1, (SELECT max(length(key)) + 1 FROM vocabulary))) AS l)
  WHERE a + l <= length(word) AND CASE WHEN a > 0 THEN '##' ELSE '' END || substr(word, (a + 1)::INT, l::INT) IN (SELECT key FROM vocabulary)
  GROUP BY word, a),
walk AS (
  SELECT word, 0::BIGINT AS a FROM words
  UNION ALL SELECT w.word, w.a + e.l FROM walk w JOIN edges e ON e.word = w.word AND e.a = w.a),
known AS MATERIALIZED (SELECT word FROM walk WHERE a = length(word)),
word_cuts AS MATERIALIZED (
  SELECT w.word, w.a, e.l, CASE WHEN w.a > 0 THEN '##' ELSE '' END || substr(w.word, (w.a + 1)::INT, e.l::INT) AS key
  FROM walk w JOIN edges e ON e.word = w.word AND e.a = w.a WHERE w.word IN (SELECT word FROM known)
  UNION ALL SELECT word, 0, length(word), '[UNK]' FROM words WHERE word NOT IN (SELECT word FROM known)),
piece_rows AS MATERIALIZED (
  SELECT doc_id, i, k, a, key,
    CASE WHEN a = 0 AND starts_with(token, ' ') THEN ' ' ELSE '' END || substr(ltrim(token, ' '), (a + 1)::INT, l::INT) AS spelled
  FROM doc_tokens JOIN word_cuts ON word = lower(ltrim(token, ' ')))"""


# Learned sentence ends: words of all documents, counts, ratios.
CLOSERS = r"""["''”’»)\]}]*"""


def word_type(expr: str) -> str:
    bare = rf"lower(regexp_replace({expr}, '\A[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+\z', '', 'g'))"
    return rf"CASE WHEN regexp_matches({bare}, '\A[0-9][0-9.,]*\z') THEN '#' ELSE {bare} END"


def word_mark(expr: str) -> str:
    return rf"""CASE WHEN regexp_matches({expr}, '[!?][.!?]*{CLOSERS}\z') THEN '!'
    WHEN regexp_matches({expr}, '\.\.+{CLOSERS}\z') THEN '…'
    WHEN regexp_matches({expr}, '[\p{{L}}\p{{N}}]\.{CLOSERS}\z') THEN '.'
    WHEN regexp_matches({expr}, '\.{CLOSERS}\z') THEN '!'
    WHEN regexp_matches({expr}, '[\p{{L}}\p{{N}}]\.[^\p{{L}}\p{{N}}.]+\z') THEN ',' ELSE '' END"""


def times_log(count: str, share: str) -> str:
    return f"CASE WHEN {count} > 0 THEN {count} * ln({share}) ELSE 0 END"


def likelihood(k: str, n: str, share: str) -> str:
    return f"({times_log(k, share)} + {times_log(f'({n} - {k})', f'(1 - {share})')})"


RATIO = f"""2 * ({likelihood("k", "c1", "(k / c1)")} + {likelihood("(c2 - k)", "(t - c1)", "((c2 - k) / (t - c1))")}
    - {likelihood("k", "c1", "(c2 / t)")} - {likelihood("(c2 - k)", "(t - c1)", "(c2 / t)")})"""


def behind(ends: str, least: str) -> str:
    return f"""
  SELECT type, n, k AS together, score FROM (
    SELECT a.type, a.n, a.k, {RATIO} AS score
    FROM (SELECT e.next AS type, sum(e.c)::BIGINT AS k, any_value(t.n) AS n, any_value(t.n)::DOUBLE AS c2,
        (SELECT sum(c) FROM {ends})::DOUBLE AS c1, (SELECT total FROM totals)::DOUBLE AS t
      FROM {ends} e JOIN types t ON t.type = e.next WHERE regexp_matches(e.next, '\\p{{L}}') GROUP BY e.next) a
    WHERE k / c1 > c2 / t) WHERE score >= {least}"""


SENTENCE_MODEL = f"""
words AS (
  SELECT doc_id, i, w, {word_type("w")} AS type, {word_mark("w")} AS mark
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, string_split({spaced("text")}, ' ') AS ws FROM documents WHERE text IS NOT NULL))),
followed AS (
  SELECT type, mark, lead(type) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM words
  UNION ALL SELECT '', '^', type FROM words WHERE i = 1),
counts AS MATERIALIZED (SELECT type, mark, CASE WHEN mark IN ('!', '.', '^') THEN next END AS next, count(*) AS c FROM followed GROUP BY ALL),
types AS MATERIALIZED (
  SELECT type, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (mark IN ('.', ',')), 0)::BIGINT AS k FROM counts WHERE type <> '' GROUP BY type),
totals AS MATERIALIZED (SELECT sum(n)::BIGINT AS total, sum(k)::BIGINT AS stops FROM types),
weighed AS (
  SELECT type, n, k, n - k AS plain, stops / total AS p, length(replace(type, '.', '')) AS letters
  FROM types, totals WHERE k > 0 AND regexp_matches(type, '\\p{{L}}')),
scored AS (
  SELECT type, n, k AS together, -2 * ({times_log("k", "p")} + {times_log("plain", "(1 - p)")} - k * ln(0.99) - plain * ln(1 - 0.99::DOUBLE))
    * exp(-letters) * (length(type) - letters + 1) * pow(letters::DOUBLE, -plain::DOUBLE) AS score
  FROM weighed),
abbreviations AS MATERIALIZED (SELECT * FROM scored WHERE score >= 0.3),
certain AS MATERIALIZED (
  SELECT * FROM counts WHERE next <> '' AND type NOT IN (SELECT type FROM abbreviations)
    AND (mark IN ('!', '^') OR mark = '.' AND length(type) > 1)),
starters AS MATERIALIZED ({behind("certain", "30")}),
numbered AS MATERIALIZED (SELECT * FROM counts WHERE type = '#' AND mark = '.' AND next <> ''),
ordinals AS MATERIALIZED (SELECT * FROM ({behind("numbered", "7.88")}) WHERE type NOT IN (SELECT type FROM starters))"""

LEARNED_SENTENCES = rf"""{SENTENCE_MODEL},
possible AS (
  SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace({spaced("text")}, '([.!?]{CLOSERS}) ', '\1' || {NEWLINE} || ' ', 'g'), {NEWLINE}) AS ps
    FROM documents)),
faced AS (
  SELECT *, regexp_extract(p, '[^ ]+\z') AS word,
    regexp_extract(lead(p) OVER (PARTITION BY doc_id ORDER BY i), '\A *([^ ]+)', 1) AS after FROM possible),
facts AS (
  SELECT doc_id, i, p, {word_mark("word")} AS mark, {word_type("word")} AS kind, {word_type("after")} AS next,
    regexp_matches(after, '\A[^\p{{L}}\p{{N}}]*\p{{Lu}}') AS capital, regexp_matches(after, '\A[^\p{{L}}\p{{N}}]*\p{{Ll}}') AS small FROM faced),
judged AS (
  SELECT *, NOT CASE WHEN mark = '!' THEN FALSE WHEN mark = '…' THEN NOT capital
    WHEN length(kind) = 1 AND kind <> '#' OR kind IN (SELECT type FROM abbreviations)
      THEN NOT (capital AND next IN (SELECT type FROM starters))
    WHEN kind = '#' THEN small OR next IN (SELECT type FROM ordinals) ELSE FALSE END AS ends FROM facts),
runs AS (
  SELECT doc_id, i, p, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM judged),
learned AS (SELECT doc_id, run, trim(string_agg(p, '' ORDER BY i)) AS text FROM runs GROUP BY doc_id, run)"""


def regexp_chain(expr: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
        expr = f"regexp_replace({expr}, '{pattern}', replace('{to}', '~', {NEWLINE}), 'g')"
    return expr


def small_or_capital(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


CLITIC = "([nN]['’][tT]|['’](?:[lL][lL]|[rR][eE]|[vV][eE]|[sS]|[mM]|[dD]))"
CUT_WORDS = [
    (small_or_capital(a), small_or_capital(b))
    for a, b in (("can", "not"), ("gon", "na"), ("wan", "na"), ("got", "ta"), ("gim", "me"), ("lem", "me"))
]


def marked(expr: str) -> str:
    """A line end wherever two tokens touch; ``~`` stands for it in the replacements."""
    clitic = (rf"([^'’\n ]){CLITIC}(\n| |\z)", r"\1~\2\3")
    words = [(rf"(\A|\n| )({a})({b})(\n| |\z)", r"\1\2~\3\4") for a, b in CUT_WORDS]
    return regexp_chain(
        expr,
        (r"(--+|\.\.+|[,:;@#$%&?!()\[\]{}<>\"“”„«»…])", r"~\1~"),
        (r"\n([,:])\n([0-9])", r"\1\2"),
        (r"([^.\n ])\.([\n \])}>\"”»'’]*)\z", r"\1~.\2"),
        (r"(\A|\n| )(['’])([^\n ])", r"\1\2~\3"),
        (r"(\A|\n| )(['’])\n([tT])([iI][sS]|[wW][aA][sS])(\n| |\z)", r"\1\2\3~\4\5"),
        clitic,
        clitic,
        (r"([^'’\n ])(['’])(\n| |\z)", r"\1~\2\3"),
        *words,
        *words,
        (r"\n* \n*", " "),
        (r"\n\n+", "~"),
        (r"\A\n+|\n+\z", ""),
    )


def treebank_pieces(expr: str) -> str:
    return f"list_filter(string_split(replace({marked(expr)}, ' ', {NEWLINE} || ' '), {NEWLINE}), lambda p: p <> '')"


# Sentences with their pieces and tokens; a double quote opens where only the next token touches it.
TREEBANK = f"""
treebank AS (
  SELECT doc_id, i - 1 AS sentence_no, {treebank_pieces("trim(piece)")} AS ps
  FROM (SELECT doc_id, unnest(sents) AS piece, generate_subscripts(sents, 1)::BIGINT AS i
    FROM (SELECT doc_id, {sentence_list("text")} AS sents FROM documents))),
tokens AS (
  SELECT *, list_filter(list_transform(ps, lambda p, i: CASE WHEN trim(p) <> '"' THEN ltrim(p, ' ')
    WHEN (starts_with(p, ' ') OR i = 1 OR ltrim(ps[i - 1], ' ') IN ('(', '[', '{{', '<')) AND NOT starts_with(coalesce(ps[i + 1], ' '), ' ')
    THEN '``' ELSE '''''' END), lambda t: t <> '') AS ts FROM treebank)"""

PRINTED = regexp_chain(
    "array_to_string(ts, ' ')",
    (r" (''|[;?!%)\]}>”»…])", r"\1"),
    (r" (\.+|[,:])([^\p{L}\p{N}]|\z)", r"\1\2"),
    (r" (\.+|[,:])([^\p{L}\p{N}]|\z)", r"\1\2"),
    (rf" {CLITIC}(?: |\z)", r"\1 "),
    (rf" {CLITIC}(?: |\z)", r"\1 "),
    (r"(\A| )(``|[(\[{<“„«$#@]) ", r"\1\2"),
    (r"(\A| |``|[(\[{<“„«$#@])(``|[(\[{<“„«$#@]) ", r"\1\2"),
    *((rf"(\A| )({a}) ({b})([^\p{{L}}\p{{N}}]|\z)", r"\1\2\3\4") for a, b in CUT_WORDS),
    (r"``|''", '"'),
    (r"\A +| +\z", ""),
)


SECTION_CHUNKS = f"""{COLLAPSED},
keyed AS (SELECT pmid || '/' || section AS k, * FROM collapsed),
{packed("keyed", "k", 100)},
section_chunks AS (
  SELECT pmid, section, chunk_no, c.text, c.n_tokens FROM chunks c JOIN keyed USING (k))"""

CORPUS = f"""{SECTION_CHUNKS},
corpus AS (
  SELECT row_number() OVER (ORDER BY pmid::BIGINT, section, chunk_no) - 1 AS id, * FROM section_chunks)"""


def hashed(texts: str, key: str, name: str) -> str:
    """Sparse unit vectors ``name(key, dim, value)``, in single precision like the stored ones."""
    return f"""
{name}_counts AS (
  SELECT {key}, ('0x' || substr(md5(t), 1, 7))::INT % {DIM} AS dim, count(*) AS n
  FROM (SELECT {key}, unnest({token_list(f"lower({spaced('text')})")}) AS t FROM {texts}) GROUP BY ALL),
{name} AS (
  SELECT {key}, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value FROM {name}_counts),
{name}_norm AS (SELECT {key}, sqrt(sum(value * value)) AS norm FROM {name} GROUP BY {key})"""


TEXT_HITS = f"""{CORPUS},
questions AS (SELECT item_id AS query_id, text FROM benchmark),
{hashed("corpus", "id", "cv")},
{hashed("questions", "query_id", "qv")},
scores AS (
  SELECT query_id, id, round(sum(q.value * c.value) / any_value(qn.norm * cn.norm), 9) AS score
  FROM qv q JOIN cv c USING (dim) JOIN qv_norm qn USING (query_id) JOIN cv_norm cn USING (id)
  GROUP BY query_id, id),
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score
  FROM scores QUALIFY rank <= 10)"""

SENTENCE_HITS = TEXT_HITS.replace(
    CORPUS,
    f"""{PASSAGES},
corpus AS (
  SELECT row_number() OVER (ORDER BY pmid::BIGINT, index) - 1 AS id, pmid, section, sentence AS text
  FROM stripped WHERE section IN {SECTIONS} AND {n_words("sentence")} > 5)""",
)


def largest_variance(name: str, matrix: str) -> str:
    """The largest eigenvalue ``name(value, axis)`` of ``matrix(m)``: a column of a high power is the axis."""
    square = "list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)))"
    trace = "list_sum(list_transform(m, lambda r: list_dot_product(r, r)))"
    return f"""
{name}_power AS (
  SELECT 0 AS k, m FROM {matrix}
  UNION ALL SELECT k + 1, list_transform({square}, lambda r: list_transform(r, lambda x: x / {trace})) FROM {name}_power WHERE k < 16),
{name}_column AS (
  SELECT list_extract(m, list_position(list_transform(m, lambda r: list_dot_product(r, r)),
    list_max(list_transform(m, lambda r: list_dot_product(r, r))))) AS c FROM {name}_power WHERE k = 16),
{name}_axis AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS axis FROM {name}_column),
{name} AS (SELECT axis, list_dot_product(axis, list_transform(m, lambda r: list_dot_product(r, axis))) AS value FROM {matrix}, {name}_axis)"""


AXES = f"""
pca_cells AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
centred AS (SELECT vec_id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM pca_cells),
entries AS (
  SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) / (count(*) - 1) AS c FROM centred a JOIN centred b USING (vec_id) GROUP BY ALL),
covariance AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM entries GROUP BY i)),
{largest_variance("first", "covariance")},
deflated AS (
  SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - value * axis[i] * axis[j])) AS m FROM covariance, first),
{largest_variance("second", "deflated")}"""

POOL_CELLS = """
cells AS (
  SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v, (embedding[1] >= 0)::INT AS mask FROM embeddings)"""

LABEL_QUERIES = """
centre_cells AS (
  SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
centres AS (
  SELECT label::BIGINT AS query_id, list(m ORDER BY dim) AS q
  FROM (SELECT label, dim, avg(v) AS m FROM centre_cells GROUP BY label, dim) GROUP BY label)"""


def label_hits(score: str, order: str, where: str = "TRUE") -> str:
    return f"""{LABEL_QUERIES},
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank, id, score
  FROM (SELECT query_id, vec_id AS id, round({score}, 9) AS score FROM centres, embeddings WHERE {where})
  QUALIFY rank <= 10)"""


COSINE = "list_cosine_similarity(q, embedding::DOUBLE[])"
HIT_ROWS = "SELECT query_id, rank::INTEGER AS rank, id, score FROM hits"


def context(order: str = "rank") -> str:
    line = """' - "' || text || '" {"pmid":"' || pmid || '"}' || chr(10) || '        '"""
    return f"'Context:' || chr(10) || string_agg({line}, '' ORDER BY {order})"


def default_user(question: str) -> str:
    return f"""{quoted(TASK)} || 'Question: "' || {question} || '".' || chr(10) || {context()}"""


def tagged_user(question: str) -> str:
    line = "'<context>' || text || '</context><pmid>' || pmid || '</pmid>' || chr(10)"
    end = quoted(f"{TAGGED_QUESTION_END}\nHere are some restrictions: {TAGGED_RESTRICTIONS}\n")
    return (
        f"{quoted(TAGGED_TASK)} || string_agg({line}, '' ORDER BY rank) || '<question>' || {question} || {end}"
    )


LABEL_TEXT_HITS = f"""{label_hits(COSINE, "DESC", "vec_id IN (SELECT doc_id FROM documents)")},
hit_texts AS (
  SELECT query_id, rank, text, doc_id::VARCHAR AS pmid, 'What is label ' || query_id || ' about?' AS question
  FROM hits JOIN documents ON doc_id = id)"""

# Every twentieth vector asks; buckets of twelve tables of six planes, four of which are also turned.
UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
HASHED_HITS = f"""
normals AS (
  SELECT t, b, list((('0x' || substr(md5(t || '-' || b || '-' || d), 1, 4))::INT - 32768)::DOUBLE ORDER BY d) AS n
  FROM range(12) r(t), range(6) s(b), range(64) u(d) GROUP BY t, b),
sides AS MATERIALIZED (
  SELECT vec_id, t, b::INT AS b, list_inner_product(u, n) AS side FROM (SELECT vec_id, {UNIT} AS u FROM embeddings), normals),
own AS MATERIALIZED (SELECT vec_id, t, sum(CASE WHEN side >= 0 THEN 1 << b ELSE 0 END)::INT AS code FROM sides GROUP BY vec_id, t),
turned AS (
  SELECT vec_id, t, b FROM sides WHERE vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(side), b) <= 4),
probed AS (
  SELECT vec_id, t, code FROM own WHERE vec_id % 20 = 0
  UNION ALL SELECT vec_id, t, xor(code, 1 << b) FROM own JOIN turned USING (vec_id, t)),
met AS (SELECT DISTINCT p.vec_id AS query_id, o.vec_id AS id FROM probed p JOIN own o USING (t, code)),
hashed_hits AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score
  FROM (SELECT query_id, id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
    FROM met JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = id) QUALIFY rank <= 10)"""

CELL_ROWS = """SELECT {key}, unnest(range(len({v}))) AS dim, round(unnest({v})::DOUBLE, 6) AS value FROM {t}"""
VECTOR_CELLS = CELL_ROWS.format(key="vec_id AS id", v="embedding", t="embeddings")

LISTING = """
listing AS (
  SELECT '/a/biocjson_' || vec_id || '.json' AS path FROM embeddings
  UNION ALL SELECT '/b/biocjson_' || page_id || '.json' FROM pages),
named AS (SELECT path, string_split(path, '/')[-1] AS name FROM listing),
wanted AS (SELECT doc_id AS pos, doc_id::VARCHAR AS doc_id FROM labels)"""

LOOKUP = """SELECT pos, doc_id, arg_min(path, [name, path]) AS path, count(*) AS n_files
FROM wanted JOIN named ON {condition} GROUP BY pos, doc_id"""

FLAT_COLUMNS = "index, section, sentence, pmid, pmcid, date, authors, journal"

ORACLES: dict[str, str] = {
    "id_list_scan": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id::VARCHAR AS doc_id FROM documents",
    "file_lookup": f"WITH {LISTING} " + LOOKUP.format(condition="name = 'biocjson_' || doc_id || '.json'"),
    "file_lookup_substring": f"WITH {LISTING} " + LOOKUP.format(condition="contains(name, doc_id)"),
    "file_missing": f"""WITH {LISTING}
SELECT pos, doc_id FROM wanted WHERE 'biocjson_' || doc_id || '.json' NOT IN (SELECT name FROM named)""",
    "document_json_roundtrip": f"WITH {PASSAGES} SELECT {FLAT_COLUMNS} FROM passages",
    "envelope_unwrap": f"""WITH {PASSAGES}
SELECT pmid, any_value(pmcid) AS pmcid, any_value(journal) AS journal, count(*) AS n_passages FROM passages GROUP BY pmid""",
    "passage_table_roundtrip": f"WITH {PASSAGES} SELECT {FLAT_COLUMNS} FROM passages",
    "embedding_tsv_roundtrip": VECTOR_CELLS,
    "chunk_tsv_roundtrip": f"""WITH RECURSIVE {SECTION_CHUNKS}
SELECT pmid, section, chunk_no::VARCHAR AS chunk_no, s.text, pmcid FROM section_chunks s JOIN collapsed USING (pmid, section)""",
    "collection_roundtrip": VECTOR_CELLS,
    "dimension_check": """
SELECT 64::BIGINT AS dim, count(*) FILTER (len(embedding) <> 64) AS n FROM embeddings
UNION ALL SELECT 32, count(*) FILTER (len(embedding) <> 32) FROM embeddings""",
    "passages_flatten": f"WITH {PASSAGES} SELECT {FLAT_COLUMNS} FROM passages",
    "section_choice": f"""WITH {PASSAGES}
SELECT pmid, index, section, {strip("lower(section)")} AS normal FROM passages""",
    "passages_clean": f"""WITH {PASSAGES}
SELECT pmid, index, section, sentence, epoch_us(date) AS date_us FROM cleaned WHERE {n_words("sentence")} > 5""",
    "keep_sections_default": f"WITH {PASSAGES} SELECT pmid, index, section FROM cleaned WHERE section IN {SECTIONS}",
    "keep_sections_title": f"""WITH {PASSAGES}
SELECT pmid, index, section FROM cleaned
WHERE section IN ('title','abstract','intro','results','discuss','methods')""",
    "date_parse": """
SELECT event_id, epoch_us(ts::VARCHAR::TIMESTAMP) AS ts_us, epoch_us(try_cast(event_type AS TIMESTAMP)) AS bad_us FROM events""",
    "authors_join": """
SELECT doc_id, source || CASE WHEN lang = 'en' THEN ' and ' || lang ELSE '' END || ' and et al' AS authors FROM documents""",
    "fill_unknown": """
SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'Unknown' END AS source,
  CASE WHEN lang <> 'en' THEN n_chars::VARCHAR ELSE 'Unknown' END AS n_chars, 'Unknown' AS nothing FROM documents""",
    "dropped_documents": f"""WITH {KEPT}
SELECT doc_id::VARCHAR AS pmid, source AS journal FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT pmid FROM kept)""",
    "documents_without_chunks": f"""WITH {KEPT}
SELECT doc_id::VARCHAR AS pmid, source AS journal FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT pmid FROM kept)""",
    "first_n_docs": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 15",
    "collapse_conversation": """
SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS joined, count(*) AS n_passages
FROM conversations GROUP BY ALL""",
    "collapse_documents": f"""WITH {KEPT}
SELECT pmid, section, string_agg(sentence, ' ' ORDER BY index) AS text, count(*) AS n_passages,
  any_value(pmcid) AS pmcid, epoch_us(any_value(date)) AS date_us, any_value(authors) AS authors, any_value(journal) AS journal
FROM kept GROUP BY pmid, section""",
    "section_texts": f"""WITH {COLLAPSED}
SELECT pmid, section, text, pmcid, epoch_us(date) AS date_us, authors, journal FROM collapsed""",
    "dedupe_text": """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1""",
    "dedupe_text_ties": """
SELECT sha256(text) AS digest, lang, min(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 END) AS place FROM documents GROUP BY text, lang""",
    "latest_per_id": """
SELECT o_custkey AS doc_id, min(o_orderkey) AS pos, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus,
  arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""",
    "single_id_check": """
SELECT source, count(DISTINCT lang) AS n_ids FROM documents GROUP BY source HAVING n_ids > 1""",
    "chunk_counts": f"WITH RECURSIVE {SECTION_CHUNKS} SELECT pmid, section, count(*) AS n FROM section_chunks GROUP BY ALL",
    "label_encode": "SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents",
    "label_decode": "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS code, source FROM documents",
    "union_sources": """
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN n_chars END AS n_chars, CASE WHEN lang <> 'en' THEN source END AS source
FROM documents""",
    "dense_ids": """
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, conv_id, turn, role FROM conversations""",
    "sentence_tokens": f"""
SELECT doc_id, i - 1 AS sentence_no, s AS sentence, array_to_string({token_list("s")}, '|') AS tokens
FROM (SELECT doc_id, unnest(sents) AS piece, trim(piece) AS s, generate_subscripts(sents, 1)::BIGINT AS i
  FROM (SELECT doc_id, {sentence_list("text")} AS sents FROM documents))""",
    "pack_100": f"WITH RECURSIVE {packed('documents', 'doc_id', 100)} SELECT doc_id, chunk_no, text, n_tokens FROM chunks",
    "pack_guarded": f"""WITH RECURSIVE guarded AS (SELECT doc_id, text FROM documents WHERE doc_id % 4 = 3),
{packed("guarded", "doc_id", 100)} SELECT doc_id, chunk_no, text, n_tokens FROM chunks""",
    "pack_350": f"WITH RECURSIVE {packed('documents', 'doc_id', 350)} SELECT doc_id, chunk_no, text, n_tokens FROM chunks",
    "sentence_model": f"""WITH {SENTENCE_MODEL}
SELECT 'abbreviation' AS kind, type, n, together, round(score, 4) AS score FROM abbreviations
UNION ALL SELECT 'starter', type, n, together, round(score, 4) FROM starters
UNION ALL SELECT 'ordinal', type, n, together, round(score, 4) FROM ordinals""",
    "sentences_learned": f"""WITH {LEARNED_SENTENCES}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS sentence_no, text FROM learned WHERE text <> ''""",
    "treebank_tokens": f"""WITH {TREEBANK}
SELECT doc_id, sentence_no, array_to_string(ts, '|') AS tokens FROM tokens WHERE ps <> []""",
    "detokenize": f"""WITH {TREEBANK}
SELECT doc_id, sentence_no, array_to_string(ps, '') AS spelled, {PRINTED} AS printed FROM tokens WHERE ps <> []""",
    "pack_treebank": f"""WITH RECURSIVE {packed('documents', 'doc_id', 100, treebank_pieces("s"))}
SELECT doc_id, chunk_no, text, n_tokens FROM chunks""",
    "truncate_subwords": f"""WITH RECURSIVE {WORD_PIECES},
listed AS (SELECT doc_id, list(key ORDER BY i, k, a) AS ks FROM piece_rows GROUP BY doc_id),
every AS (SELECT doc_id, lang, list_slice(coalesce(ks, []), 1, 512) AS ks FROM documents LEFT JOIN listed USING (doc_id))
SELECT doc_id, len(ks) AS n_pieces, max(len(ks)) OVER (PARTITION BY lang) AS n_mask, len(ks) AS n_ones,
  md5(array_to_string(ks, ' ')) AS digest FROM every""",
    "pack_subwords": f"""WITH RECURSIVE {WORD_PIECES},
sentence_sizes AS (SELECT doc_id, i, count(*) AS n, list(spelled ORDER BY k, a) AS ps FROM piece_rows GROUP BY doc_id, i),
sized AS (SELECT doc_id, list(n ORDER BY i) AS sizes, flatten(list(ps ORDER BY i)) AS pieces FROM sentence_sizes GROUP BY doc_id),
{packed_sizes("doc_id", 100)}
SELECT doc_id, chunk_no, text, n_tokens FROM chunks""",
    "fixed_slices": """
SELECT id, (a // 10)::BIGINT AS slice_no, len(s) AS n, round(list_sum(s::DOUBLE[]), 6) AS total
FROM (SELECT vec_id AS id, a, list_slice(embedding, a + 1, a + 10) AS s
  FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings), 10) r(a) WHERE a < len(embedding))""",
    "chunk_text_section": f"WITH RECURSIVE {SECTION_CHUNKS} SELECT * FROM section_chunks",
    "chunk_text_sentence": f"""WITH {PASSAGES}
SELECT pmid, section, index AS chunk_no, sentence AS text, len({token_list(spaced("sentence"))}) AS n_tokens
FROM stripped WHERE section IN {SECTIONS} AND {n_words("sentence")} > 5""",
    "chunk_quality": f"""WITH RECURSIVE {packed('documents', 'doc_id', 100)},
whole AS (SELECT doc_id, len({token_list(spaced("text"))}) AS tokens_in FROM documents),
counted AS (SELECT doc_id, len({token_list("text")}) AS n FROM chunks)
SELECT doc_id, any_value(tokens_in) AS tokens_in, count(*) AS n_chunks, sum(n)::BIGINT AS tokens_out,
  count(*) FILTER (n > 100) AS n_over, abs(any_value(tokens_in) - sum(n))::BIGINT AS lost
FROM counted JOIN whole USING (doc_id) GROUP BY doc_id""",
    "truncate_mask": f"""
SELECT doc_id, least(n, 512) AS n_tokens, least(max(n) OVER (PARTITION BY lang), 512) AS n_mask, least(n, 512) AS n_ones
FROM (SELECT doc_id, lang, len({token_list(spaced("text"))}) AS n FROM documents)""",
    "truncate_mask_gaps": f"""
SELECT doc_id, least(n, 512) AS n_tokens, least(max(n) OVER (PARTITION BY lang), 512) AS n_mask
FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang,
    CASE WHEN doc_id % 7 <> 0 THEN len({token_list(spaced("text"))}) ELSE 0 END AS n
  FROM documents)""",
    "hash_embed": f"""WITH questions AS (SELECT item_id AS query_id, text FROM benchmark),
{hashed("questions", "query_id", "qv")}
SELECT query_id, dim, round(coalesce(value, 0), 6) AS value
FROM (SELECT query_id, unnest(range({DIM})) AS dim FROM questions) LEFT JOIN qv USING (query_id, dim)""",
    "embed_model": f"""WITH {PASSAGES},
means AS (
  SELECT pmid || '-' || index AS key, list_avg(list_transform(string_split(sentence, ' '), lambda w: length(w))) AS m FROM passages)
SELECT key, 0::BIGINT AS dim, round((m / sqrt(m * m + 1))::FLOAT::DOUBLE, 6) AS value FROM means
UNION ALL SELECT key, 1, round((1 / sqrt(m * m + 1))::FLOAT::DOUBLE, 6) FROM means""",
    "mean_pool": f"""WITH {POOL_CELLS}
SELECT label, dim, round(sum(v * mask) / greatest(sum(mask), 1e-9), 6) AS value FROM cells GROUP BY label, dim""",
    "attention_pool": f"""WITH {POOL_CELLS}
SELECT label, dim, round(sum(v * exp(mask)) / sum(exp(mask)), 6) AS value FROM cells GROUP BY label, dim""",
    "attention_pool_scores": """
WITH scored AS (SELECT label, embedding, embedding[2]::DOUBLE * 2000 - 500 AS s FROM embeddings),
weighed AS (SELECT label, embedding, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM scored),
cells AS (SELECT label, w, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM weighed)
SELECT label, dim, round(sum(v * w) / sum(w), 6) AS value FROM cells GROUP BY label, dim""",
    "l2_normalize": """
SELECT id, unnest(range(64)) AS dim, round(unnest(list_transform(v, lambda x: x / norm)), 6) AS value
FROM (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (label + 2)) AS v,
  sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM embeddings)""",
    "vector_text_roundtrip": VECTOR_CELLS,
    "vector_shape": """
SELECT count(embedding) AS n_rows, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings""",
    "knn_cosine": f"WITH {label_hits(COSINE, 'DESC')} {HIT_ROWS}",
    "knn_ip": f"WITH {label_hits('list_inner_product(q, embedding::DOUBLE[])', 'DESC')} {HIT_ROWS}",
    "knn_l2": f"WITH {label_hits('list_distance(q, embedding::DOUBLE[])', 'ASC')} {HIT_ROWS}",
    "knn_cells_recall": f"""WITH {label_hits(COSINE, 'DESC')},
near AS (
  SELECT vec_id AS id, query_id AS cell FROM centres, embeddings
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {COSINE} DESC, query_id) = 1),
probed AS (
  SELECT a.query_id, b.query_id AS cell FROM centres a, centres b
  QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY list_cosine_similarity(a.q, b.q) DESC, b.query_id) <= 4)
SELECT h.query_id, count(p.cell) / count(*) AS recall, count(*) AS k
FROM hits h JOIN near USING (id) LEFT JOIN probed p ON p.query_id = h.query_id AND p.cell = near.cell GROUP BY h.query_id""",
    "knn_many_questions": """
WITH scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a, embeddings b)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score
FROM scored QUALIFY rank <= 5""",
    "knn_joined": """
WITH scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a, embeddings b)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score
FROM scored QUALIFY rank <= 5""",
    "knn_hashed": f"WITH {HASHED_HITS} SELECT * FROM hashed_hits",
    "knn_hashed_recall": f"""WITH {HASHED_HITS},
exact AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id
    ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) <= 10)
SELECT query_id, count(h.id) / count(*) AS recall, count(*) AS k FROM exact LEFT JOIN hashed_hits h USING (query_id, id) GROUP BY query_id""",
    "knn_pruned_cosine": f"WITH {label_hits(COSINE, 'DESC')} {HIT_ROWS}",
    "knn_pruned_ip": f"WITH {label_hits('list_inner_product(q, embedding::DOUBLE[])', 'DESC')} {HIT_ROWS}",
    "knn_pruned_l2": f"WITH {label_hits('list_distance(q, embedding::DOUBLE[])', 'ASC')} {HIT_ROWS}",
    "knn_quantized": f"""WITH {LABEL_QUERIES},
parts AS MATERIALIZED (
  SELECT vec_id, p::INT AS p, list_slice(u, 8 * p + 1, 8 * p + 8) AS v FROM (SELECT vec_id, {UNIT} AS u FROM embeddings), range(8) r(p)),
coded AS MATERIALIZED (
  SELECT a.vec_id, a.p, arg_min(b.vec_id, [list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v), b.vec_id]) AS code
  FROM parts a JOIN parts b ON a.p = b.p AND b.vec_id < 64 GROUP BY a.vec_id, a.p),
asked AS (
  SELECT query_id, p::INT AS p, list_slice(list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))), 8 * p + 1, 8 * p + 8) AS v
  FROM centres, range(8) r(p)),
tables AS MATERIALIZED (
  SELECT query_id, a.p, vec_id AS code, list_inner_product(a.v, b.v) AS s FROM asked a JOIN parts b ON a.p = b.p AND vec_id < 64),
guessed AS (
  SELECT query_id, vec_id AS id, sum(s ORDER BY t.p) AS s FROM coded JOIN tables t USING (p, code) GROUP BY query_id, vec_id),
chosen AS (SELECT query_id, id FROM guessed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 200),
scored AS (
  SELECT query_id, id, round({COSINE}, 9) AS score FROM chosen JOIN centres USING (query_id) JOIN embeddings ON vec_id = id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score
FROM scored QUALIFY rank <= 10""",
    "knn_filtered_cells": f"""WITH {LABEL_QUERIES},
near AS (
  SELECT vec_id AS id, query_id AS cell FROM centres, embeddings WHERE vec_id % 7 = 3
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {COSINE} DESC, query_id) = 1),
filled AS (SELECT cell, count(*) AS n FROM near GROUP BY cell),
ordered AS (
  SELECT a.query_id, b.query_id AS cell, n, list_cosine_similarity(a.q, b.q) AS s
  FROM centres a, centres b JOIN filled ON b.query_id = filled.cell),
cumulated AS (
  SELECT query_id, cell, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY s DESC, cell
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered),
scored AS (
  SELECT c.query_id, id, round({COSINE}, 9) AS score
  FROM cumulated c JOIN near USING (cell) JOIN centres ON centres.query_id = c.query_id JOIN embeddings ON vec_id = id WHERE before < 10)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score
FROM scored QUALIFY rank <= 10""",
    "collection_search": f"""WITH {label_hits(
        'list_inner_product(q, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)))', 'DESC', 'label <> 4')}
SELECT query_id, rank::INTEGER AS rank, id, score, label::VARCHAR AS label FROM hits JOIN embeddings ON vec_id = id""",
    "rag_from_collection": f"""WITH RECURSIVE {SENTENCE_HITS},
hit_texts AS (
  SELECT query_id, rank, corpus.text, pmid, questions.text AS question
  FROM hits JOIN corpus USING (id) JOIN questions USING (query_id) WHERE rank <= 5)
SELECT query_id, {quoted(ROLE)} AS system, {default_user("any_value(question)")} AS user FROM hit_texts GROUP BY query_id""",
    "pca_2d": f"""WITH RECURSIVE {AXES},
codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM embeddings))
SELECT 'x' AS name, round(value, 8) AS value FROM first
UNION ALL SELECT 'y', round(value, 8) FROM second
UNION ALL SELECT 'label ' || label || ' is ' || code, count(*)::DOUBLE FROM embeddings JOIN codes USING (label) GROUP BY label, code""",
    "neighbour_graph": """
WITH near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id
    ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 11), b.vec_id) <= 5)
SELECT a, b FROM near UNION SELECT b, a FROM near""",
    "knn_with_gaps": f"WITH {label_hits(COSINE, 'DESC', 'vec_id % 5 NOT IN (1, 2, 3)')} {HIT_ROWS}",
    "knn_ip_small": f"""WITH {LABEL_QUERIES},
scored AS (
  SELECT query_id, vec_id AS id, list_inner_product(q, list_transform(embedding, lambda x: x::DOUBLE * 1e-12)) AS score
  FROM centres, embeddings)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id FROM scored QUALIFY rank <= 10""",
    "knn_filtered": f"WITH {label_hits(COSINE, 'DESC', 'label = 3')} {HIT_ROWS}",
    "knn_fields": f"""WITH {label_hits(COSINE, "DESC", "vec_id IN (SELECT doc_id FROM documents)")}
SELECT query_id, rank::INTEGER AS rank, score, text, doc_id::VARCHAR AS pmid, lang AS section FROM hits JOIN documents ON doc_id = id""",
    "knn_cells_all": f"WITH {label_hits(COSINE, 'DESC')} {HIT_ROWS}",
    "prompt_default": f"""WITH {LABEL_TEXT_HITS}
SELECT query_id, {quoted(ROLE)} AS system, {default_user("any_value(question)")} AS user FROM hit_texts GROUP BY query_id""",
    "prompt_tagged": f"""WITH {LABEL_TEXT_HITS}
SELECT query_id, {quoted(TAGGED_ROLE)} AS system, {tagged_user("any_value(question)")} AS user FROM hit_texts GROUP BY query_id""",
    "prompt_gaps": f"""WITH {label_hits(COSINE, "DESC", "vec_id IN (SELECT doc_id FROM documents)")},
hit_texts AS (
  SELECT query_id, rank, CASE WHEN rank % 3 <> 0 THEN text ELSE 'Unknown' END AS text,
    CASE WHEN rank % 4 <> 0 THEN doc_id::VARCHAR ELSE 'Unknown' END AS pmid,
    CASE WHEN query_id % 2 = 0 THEN 'What is label ' || query_id || ' about?' ELSE 'Unknown' END AS question
  FROM hits JOIN documents ON doc_id = id)
SELECT query_id, {quoted(ROLE)} AS system, {default_user("any_value(question)")} AS user FROM hit_texts GROUP BY query_id""",
    "corpus_ids": f"WITH RECURSIVE {CORPUS} SELECT id, pmid, section, chunk_no, text FROM corpus",
    "search_texts": f"""WITH RECURSIVE {TEXT_HITS}
SELECT query_id, rank::INTEGER AS rank, id, score, pmid, section FROM hits JOIN corpus USING (id)""",
    "rag_end_to_end": f"""WITH RECURSIVE {TEXT_HITS},
hit_texts AS (
  SELECT query_id, rank, corpus.text, pmid, questions.text AS question
  FROM hits JOIN corpus USING (id) JOIN questions USING (query_id))
SELECT query_id, {quoted(ROLE)} AS system, {default_user("any_value(question)")} AS user FROM hit_texts GROUP BY query_id""",
}
