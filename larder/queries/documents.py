"""Text, page and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.context import table
from larder.functions import html
from larder.operators import documents as docs
from larder.operators import vectors
from larder.queries.registry import query

TAGS_SPARK = """array(lang, concat(' ', source, ' '), lang, '', CAST(NULL AS STRING),
  CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'medium' ELSE 'short' END)"""
SIZE_SQL = "CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'medium' ELSE 'short' END"


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr("doc_id", f"{TAGS_SPARK} AS tags", "lang", "source")


@query(
    f"""SELECT tag, count(*) AS n, any_value(n_tags) AS n_tags, any_value(n_uses) AS n_uses FROM u, (
  SELECT count(DISTINCT tag) AS n_tags, count(*) AS n_uses FROM u) GROUP BY tag ORDER BY n DESC, tag LIMIT 20""".replace(
        "SELECT tag, count(*) AS n, any_value(n_tags)",
        f"WITH u AS (SELECT lang AS tag FROM documents UNION ALL SELECT lang FROM documents UNION ALL SELECT source FROM documents "
        f"UNION ALL SELECT {SIZE_SQL} FROM documents)\nSELECT tag, count(*) AS n, any_value(n_tags)",
        1,
    )
)
def tag_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most used tags of the documents."""
    return docs.top_tags(docs.tag_counts(tagged(spark, folder)))


@query(f"SELECT doc_id, lang || ', ' || source || ', ' || {SIZE_SQL} AS tag_text, 3 AS n_tags FROM documents")
def tag_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = docs.normalized(tagged(spark, folder))
    return rows.select("doc_id", "tag_text", F.size("tag_list").cast("long").alias("n_tags"))


TAXONOMY = '{"lang":{"latin":["en","fr","es"],"size":["long","short","en"]},"source":{"tags":["src1","src2","src3"]}}'


@query(
    f"""SELECT doc_id, lang IN ('en', 'fr', 'es') AS lang_ok, concat_ws(',', CASE WHEN lang IN ('en', 'fr', 'es') THEN lang END,
  CASE WHEN source IN ('src1', 'src2', 'src3') THEN source END, CASE WHEN {SIZE_SQL} <> 'medium' THEN {SIZE_SQL} END) AS tags,
  CAST(lang NOT IN ('en', 'fr', 'es') AS BIGINT) + CAST(source NOT IN ('src1', 'src2', 'src3') AS BIGINT)
    + CAST({SIZE_SQL} = 'medium' AS BIGINT) AS n_invalid FROM documents"""
)
def allowed_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Document tags cut down to those of a tag taxonomy."""
    allowed = docs.allowed_tags(F.lit(TAXONOMY))
    rows = docs.normalized(tagged(spark, folder)).select("doc_id", F.col("tag_list").alias("tags"), "lang")
    kept = docs.keep_allowed(rows.withColumn("lang_ok", F.array_contains(allowed, F.col("lang"))), allowed)
    return kept.select("doc_id", "lang_ok", F.array_join("tags", ",").alias("tags"), "n_invalid")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang || '|' || CASE WHEN source <> lang THEN source || '|' ELSE '' END || 'a]b{"c|' || lang || ':' || source
  || CASE WHEN doc_id % 6 > 0 THEN '|side' ELSE '' END END AS tags FROM documents"""
)
def taxonomy_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of taxonomy documents one to six levels deep, with brackets, quotes and colons inside tags; some are no JSON."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source")
    text = F.concat(
        F.to_json(F.struct(F.array(F.col("lang"), F.concat(F.lit(" "), "source", F.lit(" ")), F.lit('a]b{"c'), F.lit("  ")).alias("tags"), F.concat("lang", F.lit(":"), "source").alias("one")))
    )
    for level in range(1, 6):
        deeper = F.concat(F.lit('{"group" : ') if level % 2 else F.lit("[17, null, "), text, F.lit(', "more":["side"]}') if level % 2 else F.lit(', true, "side"]'))
        text = F.when(F.col("doc_id") % 6 >= level, deeper).otherwise(text)
    text = F.when(F.col("doc_id") % 11 == 0, F.lit('{"tags":["lost"')).otherwise(text)
    return rows.select("doc_id", F.array_join(docs.taxonomy_tags(text), "|").alias("tags"))


# --- pages -----------------------------------------------------------------------------------------------------------


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as snippets: the site is the url, the path's language the dish they belong to."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("pos"),
        F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("url"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("content"),
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1).alias("dish_name"),
    )


SNIPPET_SQL = r"""SELECT page_id AS pos, regexp_extract(url, '^(https?://[^/]+)', 1) AS url,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, length(html) AS content_length, html AS content,
  regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS dish_name FROM pages"""


@query(
    f"""WITH s AS ({SNIPPET_SQL}), named AS (SELECT url, dish_name, min(pos) AS seen FROM s GROUP BY ALL)
SELECT f.url, first_pos, title, content_length, content_md5, n_dishes
FROM (SELECT url, min(pos) AS first_pos, arg_min(title, pos) AS title, arg_min(content_length, pos) AS content_length,
  md5(arg_min(content, pos)) AS content_md5 FROM s GROUP BY url) f
JOIN (SELECT url, count(*) AS n_dishes FROM named GROUP BY url) USING (url)"""
)
def url_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every url once, with its whole content (as digest)."""
    return docs.unique_pages(snippets(spark, folder)).withColumn("content_md5", F.md5("content")).drop("content")


@query(
    f"""WITH s AS ({SNIPPET_SQL}), named AS (SELECT url, dish_name, min(pos) AS seen FROM s GROUP BY ALL)
SELECT url, row_number() OVER (PARTITION BY url ORDER BY seen, dish_name) AS place, dish_name FROM named"""
)
def url_dishes(spark: SparkSession, folder: str) -> DataFrame:
    return docs.page_dishes(snippets(spark, folder))


@query(
    f"""WITH s AS ({SNIPPET_SQL}) SELECT count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS total_length, round(avg(n), 6) AS avg_length
FROM (SELECT arg_min(content_length, pos) AS n FROM s GROUP BY url)"""
)
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = docs.corpus_stats(docs.unique_pages(snippets(spark, folder)))
    return stats.withColumn("avg_length", F.round("avg_length", 6))


@query("SELECT doc_id, source, length(text) AS content_length FROM documents ORDER BY length(text) DESC, doc_id LIMIT 10")
def longest_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source", F.length("text").alias("content_length"))
    return docs.longest(rows, "content_length", "doc_id")


def _html_sql() -> str:
    """For well-formed pages; the entities are those of the test pages."""
    text = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in html.DROPPED:
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    text = rf"regexp_replace({text}, '<[!?/a-zA-Z][^>]*>', ' ', 'g')"
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"SELECT page_id, trim(regexp_replace({text}, '[\\s ]+', ' ', 'g')) AS text FROM pages"


@query(_html_sql())
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query(
    """WITH p AS (SELECT doc_id, text, string_split(lower(text), 'the') AS parts FROM documents),
h AS (SELECT doc_id, text, generate_subscripts(parts, 1) AS i, parts FROM p),
o AS (SELECT doc_id, text, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1) AS BIGINT) AS s
      FROM h WHERE i < len(parts)),
w AS (SELECT doc_id, string_agg(substring(text, greatest(s - 180, 0) + 1, s + 3 + 320 - greatest(s - 180, 0)), chr(10) || '...' || chr(10) ORDER BY i)
        AS segments, count(*) AS n_hits FROM o GROUP BY doc_id)
SELECT doc_id, md5(coalesce(segments, text)) AS segments_md5, length(coalesce(segments, text)) AS n_segment_chars
FROM documents LEFT JOIN w USING (doc_id)"""
)
def keyword_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The context of every 'the' in every whole document (as digest and length, the texts being long)."""
    cut = table(spark, folder, "documents").select("doc_id", html.keyword_segments(F.col("text"), ["the"]).alias("s"))
    return cut.select("doc_id", F.md5("s").alias("segments_md5"), F.length("s").alias("n_segment_chars"))


# --- descriptions ----------------------------------------------------------------------------------------------------


def _import(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents describe dishes; a name map gives each name two dish ids, some unknown to the menu."""
    part = table(spark, folder, "part")
    items = table(spark, folder, "documents").selectExpr(
        "IF(doc_id % 7 = 0, concat('unknown ', doc_id), concat(' dish ', doc_id)) AS name",
        "IF(doc_id % 11 = 0, ' ', concat(lang, ' ', n_chars)) AS description", "array(lang, source, lang) AS tags", "doc_id AS line",
    )
    name_map = part.selectExpr(
        "inline(array(struct(concat('dish ', p_partkey div 2) AS name, p_partkey AS dish_id),"
        " struct(concat('dish ', p_partkey div 3) AS name, p_partkey AS dish_id)))"
    )
    known = part.filter("p_partkey % 13 <> 0").selectExpr("p_partkey AS dish_id")
    stored = part.filter("p_partkey % 4 = 0").selectExpr(
        "p_partkey AS dish_id", "IF(p_partkey % 8 = 0, '', 'old') AS description", "CAST(NULL AS STRING) AS tags"
    )
    return docs.import_details(items, name_map, known, stored)


IMPORT_SQL = """WITH i AS (SELECT doc_id, nullif(CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang || ' ' || n_chars END, '') AS description,
  lang || ', ' || source AS tags FROM documents WHERE doc_id % 7 <> 0),
m AS (SELECT p_partkey AS dish_id, p_partkey // 2 AS name FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part),
u AS (SELECT dish_id, description, tags FROM i JOIN m ON name = doc_id WHERE dish_id % 13 <> 0
  QUALIFY row_number() OVER (PARTITION BY dish_id ORDER BY doc_id DESC) = 1),
d AS (SELECT p_partkey AS dish_id, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'old' END AS description, CAST(NULL AS VARCHAR) AS tags
      FROM part WHERE p_partkey % 4 = 0)
"""


@query(
    IMPORT_SQL
    + """SELECT coalesce(u.dish_id, d.dish_id) AS dish_id, CASE WHEN u.dish_id IS NULL THEN d.description ELSE u.description END AS description,
  CASE WHEN u.dish_id IS NULL THEN d.tags ELSE u.tags END AS tags FROM d FULL JOIN u ON u.dish_id = d.dish_id"""
)
def tag_import(spark: SparkSession, folder: str) -> DataFrame:
    return _import(spark, folder)[0]


@query(
    IMPORT_SQL
    + """SELECT (SELECT count(*) FROM documents) AS n_items,
  (SELECT count(*) FROM documents WHERE doc_id % 7 = 0 OR doc_id NOT IN (SELECT name FROM m)) AS skipped_no_id,
  (SELECT count(*) FROM i JOIN m ON name = doc_id WHERE dish_id % 13 = 0) AS skipped_not_in_db,
  (SELECT count(*) FROM u LEFT JOIN d USING (dish_id) WHERE d.dish_id IS NULL OR coalesce(u.description, '') <> coalesce(d.description, '')
     OR coalesce(u.tags, '') <> coalesce(d.tags, '')) AS updated"""
)
def tag_import_report(spark: SparkSession, folder: str) -> DataFrame:
    return _import(spark, folder)[1]


@query(
    """SELECT 'dish ' || doc_id AS dish_name, pos, p.url AS source, md5(text) AS snippet_md5,
  CASE WHEN page_id % 4 = 0 AND doc_id = page_id THEN 'about ' || page_id WHEN page_id % 3 = 0 THEN '' ELSE 'site ' || page_id END AS summary
FROM documents, (VALUES (1), (2)) AS v(pos)
JOIN pages p ON p.page_id = CASE pos WHEN 1 THEN doc_id ELSE doc_id // 2 END"""
)
def source_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Two page snippets per document-dish, with the page's own description of the dish or its introduction."""
    pages = table(spark, folder, "pages")
    asked = table(spark, folder, "documents").selectExpr(
        "concat('dish ', doc_id) AS dish_name", "text AS content", "inline(array(struct(1 AS pos, doc_id AS page_id), struct(2 AS pos, doc_id div 2 AS page_id)))"
    )
    found = asked.join(pages.select("page_id", "url"), "page_id").drop("page_id")
    summaries = pages.filter("page_id % 4 = 0").selectExpr(
        "url", "inline(array(struct(concat('dish ', page_id) AS dish_name, concat('about ', page_id) AS description, 1 AS pos),"
        " struct(concat('dish ', page_id) AS dish_name, 'later' AS description, 2 AS pos)))"
    )
    intros = pages.selectExpr("url", "IF(page_id % 3 = 0, NULL, concat('site ', page_id)) AS restaurant_intro")
    rows = docs.assemble_sources(found, summaries, intros)
    return rows.select("dish_name", "pos", "source", F.md5("snippet").alias("snippet_md5"), "summary")


@query(
    """SELECT source, count(*) AS total, count(*) FILTER (WHERE coalesce(toxic, 0) = 0) AS success,
  count(*) FILTER (WHERE toxic = 1) AS errors FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def error_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Successes and errors per source, toxic documents playing the failed ones."""
    labels = table(spark, folder, "labels").filter("toxic = 1").selectExpr("doc_id", "'toxic' AS error")
    records = table(spark, folder, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return records.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


# --- vectors ---------------------------------------------------------------------------------------------------------

UNIT_SQL = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)
"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id", "embedding AS vector", "array(CAST(label AS STRING), IF(vec_id % 2 = 0, 'even', 'odd')) AS tags"
    )


@query(
    UNIT_SQL
    + """, c AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY label, i),
r AS (SELECT label AS request_id, list(x ORDER BY i) AS q FROM c GROUP BY label),
s AS (SELECT request_id, vec_id, list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * q[i])) / sqrt(list_sum(list_transform(q, lambda y: y * y))) AS sim
      FROM r JOIN u ON (request_id % 2 = vec_id % 2 OR label = request_id))
SELECT CAST(request_id AS BIGINT) AS request_id, vec_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.2
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(sim, 12) DESC, vec_id) <= 10"""
)
def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """One search per label: its centroid is the query, the label or the matching parity the wanted tag."""
    means = (
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    requests = means.groupBy(F.col("label").cast("long").alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector")
    )
    parity = F.expr("array(CAST(request_id AS STRING), IF(request_id % 2 = 0, 'even', 'odd')) AS tags")
    found = vectors.semantic_search(corpus(spark, folder), requests.select("*", parity), threshold=0.2, by_tag=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    UNIT_SQL
    + """SELECT a.vec_id AS request_id, b.vec_id, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 6) AS similarity
FROM (SELECT * FROM u WHERE vec_id IN (SELECT min(vec_id) FROM v GROUP BY label)) a JOIN u b ON a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY
  round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), 12) DESC, b.vec_id) <= 5"""
)
def similar_items(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of the whole corpus for the first item of every label."""
    asked = table(spark, folder, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    found = vectors.similar_items(corpus(spark, folder), asked)
    return found.withColumn("similarity", F.round("similarity", 6))
