"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotemill.llm import (
    bpe_tree,
    decontaminate,
    html_extract,
    language,
    line_dedup,
    manifest,
    pieces,
    repair,
    simhash,
    topk,
    toxicity,
    transcripts,
    url_filter,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model() -> bytes:
    """The public 32k piece model; its path is the one parameter of the encoding query."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def word_tokenizer() -> str:
    """The public 49k word tokenizer; its path is the one parameter of the byte-pair query."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@query(
    "op1_topk_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS query_id, b.vec_id,
               CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s QUALIFY rank <= 10
    """,
)
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    vectors = rows.select("vec_id", topk.quantised("embedding").alias("vector"))
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return classes.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op5_piece_ids")
def op5_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(read(spark, sf_dir, "documents"), piece_model()))


@query(
    "op6_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, i,
               string_split(coalesce(text, ''), chr(10))[i] AS line
        FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS s(i)
    ), keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), shared AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), marked AS (
        SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone
        FROM keyed LEFT JOIN shared USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated(read(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


SHINGLES = r"""
    SELECT {id}, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
    FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
          FROM {table} WHERE {id} IS NOT NULL AND text IS NOT NULL)
    WHERE len(w) > 0
"""


@query(
    "op9_decontamination",
    f"""
    WITH d AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM ({SHINGLES.format(id="doc_id", table="documents")})),
         b AS (SELECT DISTINCT item_id, unnest(s) AS s FROM ({SHINGLES.format(id="item_id", table="benchmark")})),
         n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
         m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n_shared, n_shingles FROM m JOIN n USING (item_id)
    WHERE 5 * n_shared >= 4 * n_shingles
    """,
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(documents, benchmark, size=5, containment=0.8)


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_chat_formatting")
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = transcripts.defaced(read(spark, sf_dir, "conversations"))
    learned_from = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0
    model = transcripts.learn(plain.where(learned_from))
    return transcripts.parse(plain.select("conv_id", "pos", "text"), model)


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query("op13_bpe_ids")
def op13_bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(bpe_tree.encode(read(spark, sf_dir, "documents"), word_tokenizer()))


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32; this is the bitwise definition over an ASCII expression."""
    step = "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda crc, b: list_reduce(range(8), {step}, xor(crc, b)), 4294967295), 4294967295)"


def leaf_sql(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


LOWERED = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"


@query(
    "op11_manifest",
    f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {leaf_sql("text")} AS leaf,
               CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf_sql(LOWERED)}
                    ELSE {leaf_sql("text")} END AS used
        FROM documents
    ), placed AS (
        SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
        FROM leaves
    ), t(g, k, i, h, n) AS (
        SELECT g, 0, i, leaf, n FROM placed
        UNION ALL
        SELECT g, any_value(k) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
        FROM t WHERE n > 1 GROUP BY g, i // 8
    ), tops AS (SELECT g, h FROM t WHERE n = 1),
    u(k, i, h, n) AS (
        SELECT 0, g, h, (SELECT count(*) FROM tops) FROM tops
        UNION ALL
        SELECT any_value(k) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
        FROM u WHERE n > 1 GROUP BY i // 8
    ), f(g, p, k, i, h, others) AS (
        SELECT g, i, 0, i, used, '' FROM placed
        UNION ALL
        SELECT f.g, p, any_value(f.k) + 1, any_value(f.i) // 8,
               sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)),
               any_value(f.others) || string_agg(CASE WHEN t.i = f.i THEN '' ELSE t.h END, '' ORDER BY t.i)
        FROM f JOIN t ON t.g = f.g AND t.k = f.k AND t.i // 8 = f.i // 8 AND t.n > 1 GROUP BY f.g, p
    ), e AS (
        SELECT g, p, arg_max(h, k) AS h, arg_max(others, k) AS others FROM f GROUP BY g, p
    ), d(g, p, k, i, h, others) AS (
        SELECT g, p, 0, g, h, others FROM e
        UNION ALL
        SELECT d.g, p, any_value(d.k) + 1, any_value(d.i) // 8,
               sha256(string_agg(CASE WHEN u.i = d.i THEN d.h ELSE u.h END, '' ORDER BY u.i)),
               any_value(d.others) || string_agg(CASE WHEN u.i = d.i THEN '' ELSE u.h END, '' ORDER BY u.i)
        FROM d JOIN u ON u.k = d.k AND u.i // 8 = d.i // 8 AND u.n > 1 GROUP BY d.g, p
    ), b AS (
        SELECT g, p, arg_max(h, k) AS h, arg_max(others, k) AS others FROM d GROUP BY g, p
    )
    SELECT doc_id, leaf, tops.h AS subroot, u.h AS root, sha256(b.others) AS proof_sha256,
           b.h AS folded_root, b.h = u.h AS verified
    FROM placed JOIN b ON b.g = placed.g AND b.p = placed.i JOIN tops ON tops.g = placed.g JOIN u ON u.n = 1
    """,
)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return manifest.proofs(manifest.manifest(docs, changed=manifest.lowered_every_third))


def insert_sql(option: str, role: str) -> str:
    """A state of the cost fold with one more inserted turn."""
    return f"{{'c': {option}.c + 3, 'a': {option}.a || 'I', 'r': list_append({option}.r, '{role}:')}}"


def row_sql(state: str, cost: str, letter: str, turn: str | None) -> str:
    """A state of the cost fold with the next row edited; `turn` is what is put out."""
    put = f"list_append({state}.r, {turn})" if turn else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {put}}}"


def edits_sql() -> str:
    """The fold over a conversation's rows: per state (z nothing, s, u, a put out last) the least (cost, audit, turns)."""
    extra = "CASE WHEN x.f = 3 THEN 3 ELSE 0 END"
    barred = "CASE WHEN x.f IN (1, 2) THEN 1000000000 ELSE 0 END"
    keep = lambda initial: f"({extra}) + ({barred}) + (CASE WHEN x.i = '{initial}' THEN 0 ELSE 1000000000 END)"
    rerole = f"3 + ({extra}) + ({barred})"
    own, as_user, as_assistant = "x.role || ':' || x.text", "'user:' || x.text", "'assistant:' || x.text"
    deleted = {s: row_sql(f"p.{s}", "4", "D", None) for s in "zsua"}
    to_user = [row_sql(f"p.{s}", c, letter, t) for s in "zsa" for c, letter, t in ((keep("u"), "K", own), (rerole, "R", as_user))]
    to_assistant = [row_sql("p.u", c, letter, t) for c, letter, t in ((keep("a"), "K", own), (rerole, "R", as_assistant))]
    step = f"""{{'z': {deleted["z"]},
        's': list_min([{deleted["s"]}, {row_sql("p.z", keep("s"), "K", own)}]),
        'u': list_min([{deleted["u"]}, {", ".join(to_user)}]),
        'a': list_min([{deleted["a"]}, {", ".join(to_assistant)}])}}"""
    return f"list_reduce(rows, lambda y, x: list_transform([{inserts_sql('y')}], lambda p: {step})[1], {{'z': {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}}, 's': none, 'u': none, 'a': none}})"


def inserts_sql(state: str) -> str:
    """All states after turns may have been inserted."""
    user = f"list_min([{state}.u, {', '.join(insert_sql(f'{state}.{s}', 'user') for s in 'zsa')}])"
    assistant = f"list_min([{state}.a, {insert_sql('v.u', 'assistant')}])"
    first = f"{{'z': {state}.z, 's': {state}.s, 'u': {user}, 'a': {state}.a}}"
    return f"list_transform([{first}], lambda v: {{'z': v.z, 's': v.s, 'u': v.u, 'a': {assistant.replace(f'{state}.a', 'v.a')}}})[1]"


@query(
    "op12_conversation_repair",
    f"""
    WITH filled AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS lot
        FROM conversations
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM filled, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) WHERE lot <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
        FROM damaged
    ), coded AS (
        SELECT *, CASE WHEN trimmed = '' THEN 1
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                       WHEN trimmed[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
               role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS pair
        FROM placed
    ), held AS (
        SELECT conv_id, list({{'i': role[1], 'f': f, 'role': role, 'text': text}} ORDER BY pos) AS rows,
               coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               sum(CAST(f = 1 AS BIGINT)) AS blank, sum(CAST(f = 2 AS BIGINT)) AS duplicate, sum(CAST(f = 3 AS BIGINT)) AS truncated,
               sum(CASE WHEN pair IS NULL OR pair IN ('su', 'ua', 'au') THEN 0 ELSE 1 END) AS illegal,
               {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS none
        FROM coded GROUP BY conv_id
    ), folded AS (SELECT *, {edits_sql()} AS y FROM held),
    ended AS (SELECT *, {inserts_sql("y")} AS e FROM folded),
    best AS (SELECT *, list_min([e.z, e.a]) AS b FROM ended)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
           sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
    """,
)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(read(spark, sf_dir, "conversations"))
