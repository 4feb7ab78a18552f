"""One query per operator over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from litvec.llm import (
    bestfit,
    chat,
    clusters,
    decontaminate,
    exact,
    merkle,
    near,
    pii,
    repeats,
    sequences,
    toxicity,
    url_rules,
    warc,
)
from pyspark.sql import functions as F

from litvec.llm.common import Query, table
from litvec.runtime import spread

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the public tokenizers, at the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf_dir):
    """Small tables are dealt to all cores; large ones stay as they are read."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_pii(spark, sf_dir):
    return pii.digests(pii.find_pii(documents(spark, sf_dir)))


@query
def op2_packing(spark, sf_dir):
    return sequences.digests(sequences.pack(documents(spark, sf_dir), vocabulary()))


@query
def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op3_url_filters"] = """
WITH p AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
)
SELECT page_id, host, path,
    CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule,
    CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org'))
            AND (starts_with(path, '/en/1') OR starts_with(path, '/es/')) THEN 'block'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'block'
        ELSE 'allow'
    END AS verdict
FROM p
"""


@query
def op4_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = chat.read_back(chat.formatted(chat.canonical_turns(chat.rows_to_records(rows))))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
    )


ORACLES["op4_chat_formatting"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
    SELECT *,
        regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS safe_role,
        regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS safe_text
    FROM c
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|turn|>' || safe_role || '<|text|>' || safe_text || '<|end|>'))::BIGINT AS formatted_chars
FROM e
GROUP BY conv_id
"""


@query
def op5_toxicity(spark, sf_dir):
    rows = documents(spark, sf_dir)
    model = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.toxicity(rows, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_decontamination(spark, sf_dir):
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), shorter=True)


@query
def op7_near_dedup(spark, sf_dir):
    return near.near_duplicates(documents(spark, sf_dir))


@query
def op8_suffix_dedup(spark, sf_dir):
    return repeats.digests(repeats.remove_repeats(documents(spark, sf_dir)))


@query
def op9_warc(spark, sf_dir):
    archives = warc.write_archives(spread(table(spark, sf_dir, "pages")))
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?[0-9]+)", 1).try_cast("long")
    damage = F.raise_error(F.concat(F.lit("a gap in an archive just written: "), "path", F.lit(" "), "gap")).cast("boolean")
    return (
        warc.read_archives(archives, payloads=False)
        .where(F.when(F.col("gap").isNull(), True).otherwise(damage))
        .select(
            number("record_id").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            number("refers_to").alias("refers_to"),
        )
    )


ORACLES["op9_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper,
        [('0x' || substr(hex, 5 * i + 1, 5))::INTEGER FOR i IN range(8)] AS parts
    FROM p
)
SELECT page_id,
    octet_length(payload)::BIGINT AS payload_bytes,
    array_to_string([
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]], '')
        FOR v IN parts], '') AS payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM g
"""


@query
def op10_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = r"""
WITH n AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
    min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
    text_sha256
FROM n
"""


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_checked(documents, fan_out=merkle.FAN_OUT):
    """Proofs of all rows, folded from rows of which every third or so came back in lower case."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    # Only tampered rows are hashed a second time; the others come back as they were.
    seen = F.when(hit, merkle.digest(*LEAF_FIELDS[:-1], text)).alias("seen")
    tree = merkle.build(documents, merkle.digest(*LEAF_FIELDS), "lang", ["doc_id"], ["doc_id", seen], fan_out)
    folded = merkle.proofs(tree).withColumn("folded_root", merkle.folded(F.coalesce("carried.seen", "leaf")))
    return folded.select(
        "carried.doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest().alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op11_manifest(spark, sf_dir):
    return manifest_checked(spread(table(spark, sf_dir, "documents")))


def _manifest_sql(levels: int = 9, fan_out: int = 8) -> str:
    """Every level groups its nodes by run; ``levels`` is enough for as many leaves as 8 to its power."""

    def told(name: str) -> str:
        return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(told, LEAF_FIELDS[:-1]), told(text)]) + ")"

    def climbed(name: str) -> str:
        parts = []
        for at in range(levels):
            parts.append(f"""{name}r{at} AS MATERIALIZED (
    SELECT grp, node // {fan_out} AS node, list(hash ORDER BY node) AS run, any_value(n) AS n FROM {name}{at} GROUP BY grp, node // {fan_out}
), {name}{at + 1} AS MATERIALIZED (
    SELECT grp, node, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash,
        (n + {fan_out - 1}) // {fan_out} AS n
    FROM {name}r{at}
)""")
        return ",\n".join(parts)

    def folded(name: str, start: str, source: str) -> str:
        """Proof and both folds of the rows of ``source`` (row, grp, node, hash, proof, seen)."""
        parts = [f"{start}0 AS MATERIALIZED ({source})"]
        for at in range(levels):
            slot = f"(f.node % {fan_out})::INTEGER"
            left, right = f"array_to_string(r.run[1:{slot}], '')", f"array_to_string(r.run[{slot} + 2:], '')"
            parts.append(f"""{start}{at + 1} AS MATERIALIZED (
    SELECT f.row, f.grp, f.node // {fan_out} AS node,
        CASE WHEN r.n = 1 THEN f.proof ELSE f.proof || {left} || {right} END AS proof,
        CASE WHEN r.n = 1 THEN f.seen ELSE sha256({left} || f.seen || {right}) END AS seen
    FROM {start}{at} f JOIN {name}r{at} r ON r.grp = f.grp AND r.node = f.node // {fan_out}
)""")
        return ",\n".join(parts)

    return f"""
WITH bits AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
    SELECT documents.*, xor(list_reduce(
            [4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 IS NOT DISTINCT FROM 0 AS hit
    FROM documents, bits
), h AS (
    SELECT doc_id, lang, {leaf("text")} AS leaf,
        CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed,
        {leaf("changed")} AS seen
    FROM d
), l AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, leaf, seen, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node, count(*) OVER (PARTITION BY lang) AS n
    FROM h
), a0 AS MATERIALIZED (SELECT grp, node, leaf AS hash, n FROM l),
{climbed("a")},
b0 AS MATERIALIZED (SELECT 0 AS grp, grp AS node, hash, count(*) OVER () AS n FROM a{levels}),
{climbed("b")},
{folded("a", "f", "SELECT row, grp, node, '' AS proof, seen FROM l")},
{folded("b", "g", f"SELECT row, 0 AS grp, grp AS node, proof, seen FROM f{levels}")}
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(g.proof) AS proof_sha256,
    g.seen AS folded_root, g.seen = r.hash AS verified
FROM l JOIN g{levels} g ON g.row = l.row JOIN a{levels} s ON s.grp = l.grp, b{levels} r
"""


ORACLES["op11_manifest"] = _manifest_sql()


@query
def op12_clusters(spark, sf_dir):
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return clusters.with_inertia(*clusters.centroid_clusters(vectors))


def _cluster_sql(dim: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    """One step per round: nearest centroids of all vectors, then the means as floors."""
    each = ", ".join(f"sum(v[{i}]) AS s{i}" for i in range(1, dim + 1))
    # Division of whole numbers cuts towards zero: take the remainder off first.
    floors = ", ".join(f"((s{i} - ((s{i} % n) + n) % n) // n)::BIGINT" for i in range(1, dim + 1))
    squares = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    step = """a{r} AS MATERIALIZED (
    SELECT v.row, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v,
        min({{'d': {squares}::BIGINT, 'k': c.k}}) AS near
    FROM v, c{r} c GROUP BY v.row
), """.replace("{squares}", squares)
    move = """m{r} AS MATERIALIZED (SELECT near.k AS k, count(*) AS n, {each} FROM a{r} GROUP BY near.k),
c{next} AS MATERIALIZED (SELECT c.k, CASE WHEN m.k IS NULL THEN c.c ELSE [{floors}] END AS c FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k),
"""
    steps = "".join(
        step.format(r=r) + move.format(r=r, next=r + 1, each=each, floors=floors) for r in range(rounds)
    ) + step.format(r=rounds)
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS k, v AS c FROM v QUALIFY k < {clusters}
), {steps}t AS (
    SELECT near.k AS k, sum(near.d)::BIGINT AS n FROM a{rounds} GROUP BY near.k
)
SELECT a.vec_id, a.near.k AS cluster, a.near.d AS distance, t.n AS cluster_inertia,
    (SELECT sum(n) FROM t)::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t ON t.k = a.near.k JOIN c{rounds} c ON c.k = a.near.k
"""


ORACLES["op12_clusters"] = _cluster_sql()


@query
def op13_best_fit(spark, sf_dir):
    found = bestfit.pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return bestfit.best_fit(bestfit.digests(found))
