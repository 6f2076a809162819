"""Keyword search, vector search, embeddings, prompt context."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions import texts
from quotemill.operators import embed, keyword, quantised, vectors
from quotemill.operators.text_index import TextIndex
from quotemill.operators.vector_cache import cached_encoder
from quotemill.session import new_work_dir
from registry.tables import SQL, Tables, register

QUERIES = ["the oredat", "nation", "hedand thring", "und nicht", "réaux lement", "of the"]


# --- the stemming rules as SQL -------------------------------------------------------------

def _alternatives(suffixes) -> str:
    return "|".join(suffixes)


def _case(table: dict[str, str]) -> str:
    return "CASE tail " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def stem_sql(source: str) -> str:
    """(token, term) of the distinct tokens of a relation, one nested SELECT per rule step."""
    syllable = "[^aeiouy]*[aeiouy]+[^aeiouy]"
    short = texts.SHORT_SYLLABLE
    head = "left(w, length(w) - length(tail))"
    size = "(length(w) - length(tail))"

    def region(text: str, pattern: str) -> str:
        found = f"regexp_extract({text}, '^({pattern})', 1)"
        return f"CASE WHEN {found} = '' THEN 1000 ELSE length({found}) END"

    def tail(inner: str, suffixes) -> str:
        return f"SELECT *, regexp_extract(w, '({_alternatives(suffixes)})$', 1) AS tail FROM ({inner})"

    def replace(inner: str, word: str) -> str:
        return f"SELECT * REPLACE (CASE WHEN done THEN w ELSE {word} END AS w) FROM ({inner})"

    def drop(inner: str) -> str:
        return f"SELECT * EXCLUDE (tail) FROM ({inner})"

    done = ", ".join(f"'{w}'" for w in texts.UNCHANGED_AFTER_PLURAL)
    q = f"SELECT DISTINCT token FROM {source}"
    q = f"SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM ({q})"
    q = f"SELECT *, {region('w', 'gener|commun|arsen|' + syllable)} AS r1 FROM ({q})"
    q = f"SELECT *, r1 + {region('substr(w, r1 + 1)', syllable)} AS r2 FROM ({q})"
    q = f"""SELECT * REPLACE (CASE WHEN regexp_matches(w, 'sses$') THEN regexp_replace(w, 'sses$', 'ss')
      WHEN regexp_matches(w, '^.(ied|ies)$') THEN regexp_replace(w, '(ied|ies)$', 'ie')
      WHEN regexp_matches(w, '(ied|ies)$') THEN regexp_replace(w, '(ied|ies)$', 'i')
      WHEN regexp_matches(w, '(us|ss)$') THEN w
      WHEN regexp_matches(w, '[aeiouy].+s$') THEN regexp_replace(w, 's$', '') ELSE w END AS w) FROM ({q})"""
    q = tail(f"SELECT *, w IN ({done}) AS done FROM ({q})", texts.TENSE_SUFFIXES)
    q = f"SELECT *, tail NOT IN ('', 'eed', 'eedly') AND regexp_matches({head}, '[aeiouy]') AS cut FROM ({q})"
    q = replace(
        q,
        f"CASE WHEN tail IN ('eed', 'eedly') THEN CASE WHEN {size} >= r1 THEN {head} || 'ee' ELSE w END WHEN cut THEN {head} ELSE w END",
    )
    q = replace(
        drop(q),
        f"""CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
      WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1)
      WHEN r1 >= length(w) AND regexp_matches(w, '{short}') THEN w || 'e' ELSE w END""",
    )
    q = replace(q, "regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i')")
    q = replace(
        tail(q, texts.STEP2_SUFFIXES),
        f"CASE WHEN tail = '' OR {size} < r1 OR (tail = 'ogi' AND NOT {head} LIKE '%l') "
        f"OR (tail = 'li' AND NOT regexp_matches({head}, '[cdeghkmnrt]$')) THEN w ELSE {head} || {_case(texts.STEP2_SUFFIXES)} END",
    )
    q = replace(
        tail(drop(q), texts.STEP3_SUFFIXES),
        f"CASE WHEN tail = '' OR {size} < r1 OR (tail = 'ative' AND {size} < r2) THEN w ELSE {head} || {_case(texts.STEP3_SUFFIXES)} END",
    )
    q = replace(
        tail(drop(q), texts.STEP4_SUFFIXES),
        f"CASE WHEN tail = '' OR {size} < r2 OR (tail = 'ion' AND NOT regexp_matches({head}, '[st]$')) THEN w ELSE {head} END",
    )
    q = replace(
        tail(drop(q), ["e", "l"]),
        f"CASE WHEN (tail = 'e' AND ({size} >= r2 OR ({size} >= r1 AND NOT regexp_matches({head}, '{short}')))) "
        f"OR (tail = 'l' AND {size} >= r2 AND {head} LIKE '%l') THEN {head} ELSE w END",
    )
    irregular = " ".join(f"WHEN token = '{k}' THEN '{v}'" for k, v in texts.IRREGULAR_STEMS.items())
    same = ", ".join(f"'{w}'" for w in texts.UNCHANGED_WORDS)
    return f"SELECT token, CASE {irregular} WHEN length(token) <= 2 OR token IN ({same}) THEN token ELSE lower(w) END AS term FROM ({q})"


_STOP = ", ".join(f"'{w}'" for w in texts.STOP_WORDS)


def _tokens_sql(select: str, text: str, source: str) -> str:
    pieces = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"SELECT {select}, unnest({pieces}) AS token, generate_subscripts({pieces}, 1) AS pos FROM {source}"


_QUERY_ROWS = "(SELECT unnest([" + ", ".join(f"'{q}'" for q in QUERIES) + "]) AS query)"
TEXT = "title || ' ' || coalesce(description, '')"
TOKENS = {
    "doc_tokens": f"SELECT * FROM ({_tokens_sql('id', TEXT, 'news_articles')}) WHERE token NOT IN ({_STOP})",
    "query_tokens": f"SELECT * FROM ({_tokens_sql('query', 'query', _QUERY_ROWS)}) WHERE token NOT IN ({_STOP})",
    "stems": stem_sql("(SELECT token FROM doc_tokens UNION ALL SELECT token FROM query_tokens)"),
    "doc_terms": "SELECT id, term, pos FROM doc_tokens JOIN stems USING (token)",
    "query_terms": "SELECT query, term, count(*) OVER (PARTITION BY query) AS terms "
                   "FROM (SELECT DISTINCT query, term FROM query_tokens JOIN stems USING (token))",
}
MATCH = {
    **TOKENS,
    "tfs": "SELECT id, term, count(*) AS tf FROM doc_terms GROUP BY ALL",
    "lengths": "SELECT n.id, count(t.token) AS dl FROM news_articles n LEFT JOIN doc_tokens t ON t.id = n.id GROUP BY n.id",
    "totals": "SELECT count(*) AS n, avg(dl) AS mean FROM lengths",
    "dfs": "SELECT term, count(*) AS df FROM tfs GROUP BY term",
    "hits": "SELECT query, terms, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part "
            "FROM query_terms JOIN tfs USING (term) JOIN dfs USING (term) JOIN lengths USING (id) JOIN totals ON true",
    "ranked": """
SELECT query, id, relevance, published_at, title, description
FROM (SELECT query, id, round(sum(part), 9) AS relevance FROM hits GROUP BY query, id, terms HAVING count(*) = terms)
JOIN news_articles USING (id)""",
    "found": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, published_at DESC NULLS FIRST, id) AS place
               FROM ranked) WHERE place <= 5""",
}
_RANKED = "round(relevance, 6) AS relevance"


def _asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(q,) for q in QUERIES], "query string")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("relevance", F.round("relevance", 6))


@register(
    "keyword_terms",
    "SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM doc_terms GROUP BY term",
    ("news_articles",),
    **TOKENS,
)
def keyword_terms(t: Tables):
    index = keyword.postings(t.news, keyword.search_text()).filter(F.col("term") != keyword.NO_TERM)
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@register("keyword_match", f"SELECT query, id, {_RANKED} FROM ranked", ("news_articles",), **MATCH)
def keyword_match(t: Tables):
    terms = keyword.query_terms(_asked(t))
    found = keyword.matches(keyword.postings(t.news, keyword.search_text(), terms), terms)
    return _rounded(found).select("query", "id", "relevance")


@register("keyword_search", f"SELECT query, CAST(place AS INT) AS place, id, title, {_RANKED} FROM found", ("news_articles",), **MATCH)
def keyword_search(t: Tables):
    return _rounded(keyword.search(t.news, _asked(t))).select("query", "place", "id", "title", "relevance")


@register("keyword_search_indexed", f"SELECT query, CAST(place AS INT) AS place, id, {_RANKED} FROM found", ("news_articles",), **MATCH)
def keyword_search_indexed(t: Tables):
    path = new_work_dir(t.spark, "postings")
    keyword.write_postings(keyword.postings(t.news, keyword.search_text()), path, buckets=16)
    index = keyword.read_postings(t.spark, path, keyword.query_terms(_asked(t)), buckets=16)
    return _rounded(keyword.search(t.news, _asked(t), index=index)).select("query", "place", "id", "relevance")


_KEPT = {name: sql.replace("news_articles", "kept_articles") for name, sql in MATCH.items()}


@register(
    "keyword_search_segments",
    f"SELECT query, CAST(place AS INT) AS place, id, {_RANKED} FROM found",
    ("news_articles",),
    kept_articles="SELECT * FROM news_articles WHERE fetched_at >= TIMESTAMP '2024-01-08 00:00:00'",
    **_KEPT,
)
def keyword_search_segments(t: Tables):
    """An index of three batches, one of them replayed, after a retention delete."""
    index = TextIndex(new_work_dir(t.spark, "text-index"), buckets=8)
    for batch in (0, 1, 2, 1):
        index.add(t.news.where(F.col("id") % 3 == batch), f"news-{batch}")
    index.delete(t.news.where("fetched_at < TIMESTAMP_NTZ'2024-01-08 00:00:00'").select("id"), "retention-2024-01-08")
    return _rounded(index.search(t.news, _asked(t))).select("query", "place", "id", "relevance")


@register(
    "news_context",
    """
SELECT query, count(*) AS articles_found, string_agg('- [' || coalesce(left(CAST(published_at AS VARCHAR), 10), 'None') || '] ' || title
  || ': ' || coalesce(description, 'None'), chr(10) ORDER BY place) AS context FROM found GROUP BY query
""",
    ("news_articles",),
    **MATCH,
)
def news_context(t: Tables):
    return keyword.news_context(keyword.search(t.news, _asked(t)))


# --- vectors -----------------------------------------------------------------------------

def _label_questions(t: Tables) -> DataFrame:
    """One question vector per label: the mean of its vectors."""
    rows = t.raw("embeddings").select("label", array_to_vector("embedding").alias("vector"))
    mean = rows.groupBy("label").agg(Summarizer.mean(F.col("vector")).alias("mean"))
    return mean.select(F.col("label").cast("string").alias("question"), vector_to_array("mean").alias("embedding"))


_TOPK = {
    "cells": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings",
    "question_cells": "SELECT label AS question, i, avg(x) AS x FROM cells GROUP BY ALL",
    "question_norms": "SELECT question, sqrt(sum(x * x)) AS norm FROM question_cells GROUP BY question",
    "vector_norms": "SELECT vec_id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY vec_id",
    "scores": "SELECT question, vec_id, round(sum(q.x * c.x) / any_value(qn.norm) / any_value(vn.norm), 12) AS similarity "
              "FROM question_cells q JOIN cells c USING (i) JOIN question_norms qn USING (question) JOIN vector_norms vn USING (vec_id) "
              "GROUP BY ALL",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, vec_id) AS place FROM scores) "
           "WHERE place <= 5",
}

# The same among the vectors that belong to an article.
_TOPK_NEWS = {**_TOPK, "top": _TOPK["top"].replace("FROM scores", "FROM scores SEMI JOIN news_articles ON id = vec_id")}


@register(
    "semantic_topk",
    "SELECT CAST(question AS VARCHAR) AS question, CAST(place AS INT) AS place, vec_id AS id, round(similarity, 3) AS similarity FROM top",
    **_TOPK,
)
def semantic_topk(t: Tables):
    found = vectors.semantic_topk(t.raw("embeddings"), _label_questions(t), 5, "vec_id")
    return found.withColumn("similarity", F.round("similarity", 3))


def _indexed(t: Tables, questions: DataFrame, planes: int = 4, **near) -> DataFrame:
    path = new_work_dir(t.spark, "vectors")
    vectors.build_vector_index(t.raw("embeddings"), path, planes=planes, id_column="vec_id")
    found = vectors.approximate_topk(t.spark, path, questions, 5, planes=planes, **near)
    return found.withColumn("similarity", F.round("similarity", 3))


@register("semantic_topk_indexed", SQL["semantic_topk"])
def semantic_topk_indexed(t: Tables):
    """With all plane crossings allowed the index must give the exact answer."""
    return _indexed(t, _label_questions(t), reach=4)


# The test vectors have hardly any neighbourhoods: a recall of 0.9 takes four fifths of the cells.
NEAR = {"planes": 8, "probes": 205}


@register("semantic_topk_near")
def semantic_topk_near(t: Tables):
    """Approximate: each question meets the nearest 205 of 256 cells, so there is no SQL to compare with."""
    return _indexed(t, _label_questions(t), **NEAR)


def _quantised(t: Tables, questions: DataFrame, **search) -> DataFrame:
    path = new_work_dir(t.spark, "quantised")
    quantised.build_index(t.raw("embeddings"), path, id_column="vec_id")
    return quantised.search(t.spark, path, questions, 5, **search).withColumn("similarity", F.round("similarity", 3))


@register("semantic_topk_quantised_whole", SQL["semantic_topk"])
def semantic_topk_quantised_whole(t: Tables):
    """The quantised index with all stored vectors scored exactly."""
    return _quantised(t, _label_questions(t), whole=True)


@register("semantic_topk_quantised")
def semantic_topk_quantised(t: Tables):
    """Approximate, hence without SQL: codes of 16 bytes choose the vectors that are scored exactly."""
    return _quantised(t, _label_questions(t))


@register(
    "vector_self_similarity",
    "SELECT vec_id, CAST(1.0 AS DOUBLE) AS similarity, "
    "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) + 0.0 AS to_reversed FROM embeddings",
)
def vector_self_similarity(t: Tables):
    vector = F.col("embedding")
    own, other = vectors.cosine(vector, vector), vectors.cosine(vector, F.reverse(vector))
    return t.raw("embeddings").select("vec_id", F.round(own, 6).alias("similarity"), (F.round(other, 6) + 0.0).alias("to_reversed"))


@register(
    "semantic_sources",
    """
SELECT CAST(question AS VARCHAR) AS question, CAST(place AS INT) AS place, n.title, n.url, n.published_at, round(similarity, 3) AS similarity
FROM top JOIN news_articles n ON n.id = vec_id
""",
    ("news_articles",),
    **_TOPK_NEWS,
)
def semantic_sources(t: Tables):
    news = t.news_with_vectors
    found = vectors.semantic_topk(news, _label_questions(t), 5)
    return vectors.with_sources(news, found).select("question", "place", "title", "url", "published_at", F.round("similarity", 3).alias("similarity"))


@register(
    "source_context",
    """
SELECT CAST(question AS VARCHAR) AS question, count(*) AS articles_found, string_agg('Źródło ' || place || ': ' || title || chr(10)
  || coalesce(description, ''), chr(10) || chr(10) ORDER BY place) AS context
FROM top JOIN news_articles n ON n.id = vec_id GROUP BY question
""",
    ("news_articles",),
    **_TOPK_NEWS,
)
def source_context(t: Tables):
    news = t.news_with_vectors
    found = vectors.semantic_topk(news, _label_questions(t), 5)
    return keyword.source_context(vectors.with_sources(news, found))


@register(
    "embedding_coverage",
    "SELECT count(*) AS total, count(embedding) AS with_embedding FROM news_articles",
    ("news_articles",),
)
def embedding_coverage(t: Tables):
    return embed.coverage(t.news_with_vectors)


@register(
    "missing_embeddings",
    f"SELECT id, {TEXT} AS text FROM news_articles WHERE embedding IS NULL",
    ("news_articles",),
)
def missing_embeddings(t: Tables):
    waiting = embed.missing_embeddings(t.news_with_vectors)
    return waiting.select("id", embed.embedding_text().alias("text"))


def _encoder(t: Tables) -> embed.Encoder:
    return embed.fit_encoder(t.news.select("id", embed.embedding_text().alias("text")))


@register(
    "embedding_backfill",
    f"SELECT id, CASE WHEN embedding IS NULL THEN 2 ELSE len(embedding) END AS size, "
    f"round(CASE WHEN embedding IS NULL THEN length({TEXT}) ELSE embedding[1]::DOUBLE END, 5) AS first_value FROM news_articles",
    ("news_articles",),
)
def embedding_backfill(t: Tables):
    """Filled by a model that both sides know: the length of the text, then 1."""
    encode = embed.model_encoder(lambda: lambda batch: [[float(len(text)), 1.0] for text in batch])
    filled = embed.backfill(t.news_with_vectors, encode)
    return filled.select(
        "id", F.size("embedding").cast("bigint").alias("size"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value")
    )


@register("embedding_backfill_cached", SQL["embedding_backfill"])
def embedding_backfill_cached(t: Tables):
    """The same through the vector cache, the second time from the cache alone."""
    encode = embed.model_encoder(lambda: lambda batch: [[float(len(text)), 1.0] for text in batch], "string")
    cache = new_work_dir(t.spark, "vector-cache")
    for model in (encode, encode):
        filled = embed.backfill(t.news_with_vectors, cached_encoder(model, cache, "length-1"))
    return filled.select(
        "id", F.size("embedding").cast("bigint").alias("size"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value")
    )


def _buckets_sql(key: str, text: str, source: str) -> str:
    """(key, bucket, tf): words counted by the first six digits of their MD5 modulo the dimensions."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(md5(token), {i + 1}, 1)) - 1) * {16 ** (5 - i)}" for i in range(6))
    tokens = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return (
        f"SELECT {key}, ({digits}) % {embed.DIMENSIONS} AS bucket, count(*) AS tf "
        f"FROM (SELECT {key}, unnest({tokens}) AS token FROM {source}) GROUP BY ALL"
    )


def _unit_sql(key: str, counts: str) -> str:
    return (
        f"SELECT {key}, bucket, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x "
        f"FROM (SELECT {key}, bucket, tf * ln((m + 1.0) / (coalesce(df, 0) + 1.0)) AS x FROM {counts} LEFT JOIN spread USING (bucket) JOIN docs ON true)"
    )


@register(
    "question_answer_sources",
    """
SELECT CAST(item_id AS VARCHAR) AS question, CAST(place AS INT) AS place, id, round(similarity, 3) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, id) AS place FROM (
    SELECT item_id, id, round(sum(q.x * a.x) / any_value(q.n) / any_value(a.n), 12) AS similarity
    FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS n FROM asked_units) q
    JOIN (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM units) a USING (bucket) GROUP BY ALL))
WHERE place <= 5
""",
    ("news_articles",),
    counts=_buckets_sql("id", TEXT, "news_articles"),
    spread="SELECT bucket, count(*) AS df FROM counts GROUP BY bucket",
    docs="SELECT count(*) AS m FROM news_articles",
    units=_unit_sql("id", "counts"),
    asked_counts=_buckets_sql("item_id", "text", "benchmark"),
    asked_units=_unit_sql("item_id", "asked_counts"),
)
def question_answer_sources(t: Tables):
    """Questions encoded like the articles."""
    encode = _encoder(t)
    articles = encode(t.news.select("id", embed.embedding_text().alias("text")))
    asked = encode(t.raw("benchmark").select(F.col("item_id").alias("id"), "text"))
    found = vectors.semantic_topk(articles, asked.withColumnRenamed("id", "question"), 5)
    return found.withColumn("similarity", F.round("similarity", 3))
