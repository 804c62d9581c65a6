"""Text, semantics, ingest and consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import schemas, storage
from lumenframe.functions import text as T
from lumenframe.operators import health, ingest, postings, search, stats
from lumenframe.sources import container, scan

from . import service
from .registry import registrar

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query(
    "WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM benchmark WHERE item_id % 20 = 0), "
    "d AS (SELECT item_id, doc_id, 0.4 * len(list_intersect(t, [lower(lang), lower(source)])) + 0.3 * len(list_intersect(t, list_distinct(string_split_regex(lower(text), '\\s+')))) AS score FROM documents, q), "
    "r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM d WHERE score >= 0.5) SELECT item_id, doc_id, round(score::DOUBLE, 6) AS score, rank FROM r WHERE rank <= 50"
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item whose id is divisible by 20: a stated query set against all rows."""
    q = schemas.table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select("item_id", T.terms(F.col("text")).alias("t"))
    parts = T.semantic_parts(F.array("lang", "source"), F.array().cast("array<string>"), F.col("text"), F.lit(""))
    found = postings.best(schemas.table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts")), q, "item_id", "doc_id", 0.5, 50)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LANGUAGE = "CASE WHEN text IS NULL OR trim(text) = '' THEN 'en' WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[\\x{3040}-\\x{30ff}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{ac00}-\\x{d7af}]') THEN 'ko' WHEN regexp_matches(text, '[\\x{0e00}-\\x{0e7f}]') THEN 'th' WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'vi' ELSE 'en' END"


@query(f"SELECT 'd' || doc_id AS id, {_LANGUAGE} AS language FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, {_LANGUAGE} FROM conversations")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), T.detect_language(F.col("text")).alias("language"))
    c = schemas.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), T.detect_language(F.col("text")).alias("language"))
    return d.unionByName(c)


#: Phrases that occur in the test conversations, to exercise the ordered replacement.
_PHRASES = [("the", "THE"), ("then", "never reached"), ("de la", "of-the"), ("de", "OF"), ("er", "ER")]
_REPLACED = "text"
for _a, _b in _PHRASES:
    _REPLACED = f"replace({_REPLACED}, '{_a}', '{_b}')"


@query(f"SELECT conv_id, turn, md5({_REPLACED}) AS translated FROM conversations")
def dictionary_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schemas.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.translate_dictionary(F.col("text"), _PHRASES)).alias("translated"))


@query(
    f"WITH s AS (SELECT doc_id, text, {_LANGUAGE} AS language FROM documents) SELECT doc_id, language, CASE WHEN trim(text) = '' THEN 0.0::DOUBLE WHEN language = 'vi' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM s"
)
def structured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").select("doc_id", T.structured_query(F.col("text"), T.VIETNAMESE).alias("q"))
    return d.select("doc_id", F.col("q.language").alias("language"), F.col("q.confidence").alias("confidence"))


@query(
    "WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, "
    "len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]'))) AS n_letters, len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) AS n_punctuation FROM t"
)
def tokens_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.table(spark, sf_dir, "documents").select("doc_id", T.token_features(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("SELECT conv_id, 't' || turn AS name, md5(CASE WHEN trim(text) = '' THEN 'Analysis of t' || turn ELSE trim(text) END) AS block FROM conversations UNION ALL SELECT DISTINCT conv_id, 'none', md5('Analysis of none') FROM conversations")
def label_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation read back from one labelled answer, and a label that it lacks."""
    said = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("[t")).otherwise(F.lit("Frame T")), F.col("turn"), F.when(F.col("turn") % 2 == 0, F.lit("]: ")).otherwise(F.lit(": ")), "text")
    turns = schemas.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", said.alias("said")).alias("s"))
    c = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    names = F.concat(F.transform("s", lambda x: F.concat(F.lit("t"), x["turn"])), F.array(F.lit("none")))
    c = c.select("conv_id", F.array_join(F.transform("s", lambda x: x["said"]), " ").alias("text"), names.alias("names"))
    x = c.select("conv_id", "text", "names", F.explode("names").alias("name"))
    return x.select("conv_id", "name", F.md5(T.label_block(F.col("text"), F.col("name"), F.col("names"), F.concat(F.lit("Analysis of "), "name"))).alias("block"))


@query("SELECT page_id, coalesce(try_cast(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS BIGINT), -1) AS frame_id FROM pages")
def frame_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.table(spark, sf_dir, "pages").select("page_id", T.frame_id(F.col("url")).alias("frame_id"))


@query(
    "WITH s AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS l FROM pages) SELECT page_id, CASE WHEN list_position(l, 'en') > 0 THEN array_to_string(l[list_position(l, 'en'):], '/') WHEN len(l) >= 2 THEN 'en/' || l[-2] || '/' || l[-1] ELSE l[-1] END AS path FROM s"
)
def path_relativize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.table(spark, sf_dir, "pages").select("page_id", T.relative_path(F.col("url"), "en").alias("path"))


@query("SELECT doc_id, substr(md5(text), 1, 12) AS short_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.table(spark, sf_dir, "documents").select("doc_id", T.short_id(F.col("text")).alias("short_id"), T.content_id(F.col("text")).alias("content_id"))


@query("SELECT doc_id, lang || ',' || source || ',new' AS tags FROM documents")
def tag_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.update_tags(F.array("lang", "source"), F.array(F.col("lang"), F.lit(" "), F.lit("new"))), ",").alias("tags"))


@query("SELECT doc_id, md5(substr(trim(text), 1, 1000)) AS cleaned FROM documents WHERE trim(text) <> ''")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").withColumn("c", T.clean(F.col("text")))
    return d.where("c is not null").select("doc_id", F.md5("c").alias("cleaned"))


# --- ingest

_INVENTORIES = (
    "cur AS (SELECT doc_id AS path, md5(text) AS hash FROM documents), old AS (SELECT path, CASE WHEN path % 11 = 0 THEN hash || 'x' ELSE hash END AS hash FROM cur WHERE path % 7 <> 0 UNION ALL SELECT path + 1000000, hash FROM cur WHERE path % 13 = 0), "
    "ch AS (SELECT coalesce(cur.path, old.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'deleted' WHEN cur.hash <> old.hash THEN 'modified' ELSE 'unchanged' END AS change FROM cur FULL OUTER JOIN old ON cur.path = old.path)"
)


@query(f"WITH {_INVENTORIES} SELECT path, change FROM ch")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_changes(*schemas.inventories(spark, sf_dir))


@query(
    f"WITH {_INVENTORIES}, n AS (SELECT count(*) FILTER (WHERE change = 'new') AS n_new, count(*) FILTER (WHERE change = 'modified') AS n_modified, count(*) FILTER (WHERE change = 'deleted') AS n_deleted, count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged FROM ch), "
    "r AS (SELECT *, (n_new + n_modified) / (n_new + n_modified + n_unchanged)::DOUBLE AS x FROM n) SELECT n_new, n_modified, n_deleted, n_unchanged, round(x, 6) AS ratio, CASE WHEN x > 0.1 THEN 'rebuild' WHEN n_new + n_modified + n_deleted > 0 THEN 'incremental' ELSE 'none' END AS decision FROM r"
)
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.change_ratio(ingest.detect_changes(*schemas.inventories(spark, sf_dir)))


@query(f"WITH {_INVENTORIES} SELECT path, hash FROM cur WHERE hash NOT IN (SELECT hash FROM old)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, stored = schemas.inventories(spark, sf_dir)
    return ingest.pending(current, stored).select("path", "hash")


@query(f"WITH {_INVENTORIES} SELECT cur.path, cur.hash FROM cur JOIN ch USING (path) WHERE change <> 'deleted'")
def incremental_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, stored = schemas.inventories(spark, sf_dir)
    return ingest.apply_changes(stored, ingest.detect_changes(current, stored), current).select("path", "hash")


@query("SELECT DISTINCT md5(text) AS hash, md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) AS first_build FROM documents")
def container_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of the even documents that then grows by the others: each content once, in chunks of either build."""
    d = schemas.table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("k/"), "source", F.lit("/"), "doc_id").alias("path"), F.md5("text").alias("hash"), F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("stem"), F.col("text").alias("content"))
    path = storage.shared_path(spark)
    storage.delete_at_exit(spark, path)
    container.build_system(files.where("cast(stem as long) % 2 = 0"), path, chunk_rows=300)
    _, rows = container.build_system(files, path, chunk_rows=300)
    return rows.select("hash", F.startswith(F.col("chunk"), F.lit("c00000")).alias("first_build"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("lang").alias("extension"), F.col("n_chars").alias("bytes"))


@query("SELECT source AS folder, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, sum(count(*)) OVER ()::BIGINT AS all_files, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.folder_stats(_files(spark, sf_dir))


@query(
    "WITH d AS (SELECT source AS folder, lpad(doc_id::VARCHAR, 9, '0') AS name, lang FROM documents), f AS (SELECT DISTINCT folder FROM d ORDER BY 1 LIMIT 3), n AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM d WHERE folder IN (SELECT folder FROM f)) "
    "SELECT (SELECT count(DISTINCT folder) FROM d) AS folders, (SELECT count(*) FROM d) AS files, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM d)) AS extensions, (SELECT string_agg(folder || '/' || name, ',' ORDER BY folder, name) FROM n WHERE k <= 5) AS samples"
)
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.structure_profile(_files(spark, sf_dir))


_CONSISTENCY = (
    "WITH b AS (SELECT d.doc_id AS i, l.doc_id AS m, l.quality = 1 AS ok FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id), "
    "c AS (SELECT count(i) AS index_rows, count(m) AS metadata_rows, count(*) FILTER (WHERE m IS NULL) AS missing_metadata, count(*) FILTER (WHERE i IS NULL) AS orphan_metadata, count(*) FILTER (WHERE m IS NOT NULL AND NOT ok) AS invalid_rows FROM b) "
)


@query(
    _CONSISTENCY + "SELECT *, missing_metadata = 0 AND orphan_metadata = 0 AND invalid_rows = 0 AS consistent, CASE WHEN missing_metadata = 0 AND orphan_metadata = 0 AND invalid_rows = 0 THEN 'none' WHEN missing_metadata + orphan_metadata > 0 THEN 'rebuild' ELSE 'repair' END AS recommendation FROM c"
)
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = (schemas.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return health.consistency(d.select("doc_id"), labels, "doc_id", F.col("quality") == 1)


@query(
    "WITH k AS (SELECT 'index' AS component, count(*) > 0 AS ok, 'missing rows' AS issue FROM documents UNION ALL SELECT 'index', min(n_chars) > 0, 'empty text' FROM documents UNION ALL SELECT 'labels', min(quality) = 1, 'invalid rows' FROM labels UNION ALL SELECT 'labels', count(*) >= 10, 'missing labels' FROM labels) "
    "SELECT bool_and(ok) AS healthy, coalesce(string_agg(component || ': ' || issue, '; ' ORDER BY component || ': ' || issue) FILTER (WHERE NOT ok), '') AS issues, round(avg(ok::INT::DOUBLE), 6) AS health_rate, "
    "CASE WHEN coalesce(string_agg(issue, ';') FILTER (WHERE NOT ok), '') LIKE '%missing%' THEN 'rebuild' WHEN coalesce(string_agg(issue, ';') FILTER (WHERE NOT ok), '') LIKE '%invalid%' THEN 'repair' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'inspect' ELSE 'none' END AS recovery FROM k"
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = (schemas.table(spark, sf_dir, t) for t in ("documents", "labels"))
    checks = health.gates(d, {"rows": (F.count("*") > 0, "missing rows"), "text": (F.min("n_chars") > 0, "empty text")}, "index")
    checks = checks.unionByName(health.gates(labels, {"quality": (F.min("quality") == 1, "invalid rows"), "size": (F.count("*") >= 10, "missing labels")}, "labels"))
    return health.rollup(checks)


@query("SELECT round(count(*) FILTER (WHERE l.doc_id IS NOT NULL) / count(*), 6) AS present, count(*) FILTER (WHERE l.doc_id IS NOT NULL) / count(*) >= 0.8 AS compatible FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def structure_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = (schemas.table(spark, sf_dir, t).select(F.col("doc_id").alias("folder")) for t in ("documents", "labels"))
    return health.compatible_structure(d, labels)


def _wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths of images that are, by ``page_id % 5``: nowhere, as they are, under a root, in the folder above, under a registered prefix."""
    p = schemas.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/old/keyframes/v/"), "page_id", F.lit(".jpg")).alias("path"))
    place = F.array(*map(F.lit, ("/none/", "/old/keyframes/v/", "/new/keyframes/v/", "/old/keyframes/", "/moved/v/")))
    there = p.where("page_id % 5 <> 0").select(F.concat(F.get(place, (F.col("page_id") % 5).cast("int")), F.col("page_id"), F.lit(".jpg")).alias("path"))
    return p, there


_PLACES = "['/none/', '/old/keyframes/v/', '/new/keyframes/v/', '/old/keyframes/', '/moved/v/']"


@query(f"SELECT page_id, '/old/keyframes/v/' || page_id || '.jpg' AS path, CASE WHEN page_id % 5 <> 0 THEN {_PLACES}[page_id % 5 + 1] || page_id || '.jpg' END AS resolved FROM pages")
def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, there = _wanted(spark, sf_dir)
    return ingest.resolve_paths(wanted, there, ["/gone", "/new"], cwd="/work", registered={"/old/keyframes/": "/moved/"})


@query("SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 5 <> 0) AS found, round(avg((page_id % 5 <> 0)::INT), 6) AS rate FROM pages")
def path_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolution_report(path_resolution(spark, sf_dir))


@query("SELECT '/old/keyframes/v/' || page_id || '.jpg' AS path FROM pages WHERE page_id % 5 = 0")
def path_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.failures(path_resolution(spark, sf_dir))


@query("SELECT source AS folder, doc_id AS stem FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def rows_with_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("stem"))
    there = d.join(schemas.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l")), F.col("stem") == F.col("l"), "left_semi")
    return ingest.with_image(d, there)


@query("SELECT d.doc_id AS n, CASE WHEN l.quality IS NOT NULL THEN l.quality + 1000 ELSE d.doc_id END AS frame_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def frame_ids_from_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = schemas.table(spark, sf_dir, "documents").select(F.lit("v").alias("folder"), F.col("doc_id").cast("string").alias("stem"))
    known = schemas.table(spark, sf_dir, "labels").select(F.lit("v").alias("folder"), F.col("doc_id").cast("string").alias("stem"), (F.col("quality") + 1000).alias("frame_id"))
    return ingest.attach_frame_ids(files, known).select(F.col("stem").cast("long").alias("n"), "frame_id")


@query("SELECT source AS folder, doc_id AS frame_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def batched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("frame_id"))
    return ingest.batches(d, 32)


@query("SELECT doc_id, source || '_' || doc_id || '_' || lang AS key, source AS folder, doc_id || '_' || lang AS image FROM documents")
def frame_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").withColumn("key", T.frame_key(F.col("source"), T.frame_key(F.col("doc_id").cast("string"), F.col("lang"))))
    return d.select("doc_id", "key", T.parse_frame_key(F.col("key")).alias("p")).select("doc_id", "key", "p.*")


@query(
    "WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN [('v' || page_id, page_id::VARCHAR, NULL), ('w', '2', NULL)] WHEN 1 THEN [('a', '1', NULL), (NULL, NULL, 'not a folder:frame reference: b')] WHEN 2 THEN [('v', 'x:' || page_id, NULL)] ELSE [] END AS l FROM pages), "
    "u AS (SELECT page_id, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS place FROM x) SELECT page_id, CAST(place AS INTEGER) AS place, r[1] AS folder, r[2] AS frame, r[3] AS problem FROM u"
)
def frame_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in all forms of a list: quoted JSON, commas, one alone, a word for nothing."""
    p = schemas.table(spark, sf_dir, "pages")
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("['v"), i, F.lit(":"), i, F.lit("', \"w: 2\"]"))).when(k == 1, " a:1 , b ").when(k == 2, F.concat(F.lit("v:x:"), i)).otherwise("None")
    return p.select("page_id", F.posexplode(T.frame_references(text)).alias("place", "r")).select("page_id", "place", "r.*")


@query(
    "WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, md5(array_to_string(w, '|')) AS tokens, md5(array_to_string(regexp_extract_all(text, '[0-9]+'), '|')) AS numbers, "
    "md5(array_to_string(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]')), '|')) AS letters, md5(array_to_string(regexp_extract_all(text, '[!-/:-@\\[-`{-~]'), '|')) AS punctuation FROM t"
)
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schemas.table(spark, sf_dir, "documents").select("doc_id", T.token_lists(F.col("text")).alias("f"))
    return d.select("doc_id", *[F.md5(F.array_join(f"f.{c}", "|")).alias(c) for c in ("tokens", "numbers", "letters", "punctuation")])


_VIETNAMESE = "text"
for _a, _b in T.VIETNAMESE:
    _VIETNAMESE = f"replace({_VIETNAMESE}, '{_a}', '{_b}')"

_WORDS = {"objects": ["the", "en", "de"], "mood": ["und", "la", "of"]}


def _part(name: str) -> str:
    listed = ", ".join(f"'{w}'" for w in _WORDS[name])
    return f"nullif(array_to_string(list_filter(w, lambda x: x IN ({listed})), ', '), '') AS {name}"


@query(
    f"WITH s AS (SELECT conv_id, turn, {_LANGUAGE} AS language, text FROM conversations), q AS (SELECT *, {_VIETNAMESE} AS vi FROM s), c AS (SELECT *, CASE WHEN language = 'vi' THEN vi ELSE text END AS clip_prompt FROM q), "
    "l AS (SELECT *, string_split_regex(lower(clip_prompt), '\\s+') AS raw FROM c), d AS (SELECT *, list_filter(raw, lambda x, i: x <> '' AND list_position(raw, x) = i) AS w FROM l) "
    f"SELECT conv_id, turn, language, md5(clip_prompt) AS prompt, {_part('objects')}, {_part('mood')} FROM d"
)
def full_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schemas.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.full_query(F.col("text"), T.VIETNAMESE, _WORDS).alias("q"))
    return c.select("conv_id", "turn", "q.language", F.md5("q.clip_prompt").alias("prompt"), "q.objects", "q.mood")


@query("SELECT conv_id, turn, lower(trim(text)) IN ('hi', 'hello', 'xin chào', 'chào', 'chào bạn', 'xin chao', 'hey') AS greeting, CASE WHEN turn = 1 THEN '1 turn' ELSE turn || ' turns' END AS shown FROM conversations")
def greetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schemas.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.is_greeting(F.col("text")).alias("greeting"), T.plural(F.col("turn"), "turn").alias("shown"))


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND trim(text) = '' THEN 'missing field ''query''' WHEN turn % 4 = 0 AND length(text) > 5000 THEN '''query'' is longer than 5000' WHEN turn % 4 = 1 THEN 'missing field ''question''' "
    "WHEN turn % 4 = 2 THEN 'limit must be in 1..1000' WHEN turn % 4 = 3 THEN 'unknown request ''other''' END AS problem FROM conversations"
)
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schemas.table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    kind = F.when(k == 1, "chat").when(k == 3, "other").otherwise("search")
    body = F.when(k == 1, F.to_json(F.struct(F.col("text").alias("message")))).when(k == 2, F.to_json(F.struct(F.lit("x").alias("query"), F.lit(0).alias("limit")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"))))
    return service.invalid_requests(c.select("conv_id", "turn", kind.alias("kind"), body.alias("body"))).select("conv_id", "turn", "problem")


def _keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as keyframe rows; every ninth has no path."""
    d = schemas.table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("k/"), "doc_id"))
    return d.select(
        F.col("source").alias("folder_name"), F.col("doc_id").cast("string").alias("image_name"), path.alias("file_path"), F.col("doc_id").alias("frame_id"),
        F.lit(0).alias("sequence_position"), F.col("n_chars").cast("int").alias("total_frames"), F.lit(1.0).alias("confidence_score"), F.array("doc_id").alias("neighboring_frames"), F.lit(None).cast("string").alias("scene_boundaries"),
        F.array("lang", "source").alias("scene_tags"), F.array("lang").alias("detected_objects"), F.lit("d").alias("llm_description"), F.array("lang", "lang").alias("similar_frames"), F.lit(None).cast("array<string>").alias("transition_frames"),
    )


@query("SELECT doc_id AS frame_id, doc_id % 9 <> 0 AS valid FROM documents")
def keyframe_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyframes(spark, sf_dir).select("frame_id", health.valid_keyframe().alias("valid"))


@query("SELECT doc_id AS frame_id, source AS folder_name, CAST(n_chars AS INTEGER) AS total_frames, lang || ',' || source AS scene_tags, 2 AS similar_frames_count, 0 AS transition_frames_count FROM documents")
def metadata_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = search.metadata_detail(_keyframes(spark, sf_dir), "rich")
    return m.select("frame_id", "folder_name", "total_frames", F.array_join("scene_tags", ",").alias("scene_tags"), "similar_frames_count", "transition_frames_count")


@query(
    "WITH f AS (SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM embeddings), l AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) "
    "SELECT 'retriever' AS component, 'rows' AS \"check\", count(*) > 0 AS ok, 'missing rows' AS issue FROM f UNION ALL SELECT 'retriever', 'dimension', min(n) = max(n), 'invalid dimensions' FROM f UNION ALL SELECT 'retriever', 'finite', bool_and(ok), 'invalid vectors' FROM f "
    "UNION ALL SELECT 'retriever', 'ids', count(*) = count(DISTINCT vec_id), 'invalid ids' FROM f UNION ALL SELECT 'metadata', 'partners', count(*) = 0, 'missing metadata' FROM l"
)
def retriever_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.retriever_health(schemas.frames(spark, sf_dir), schemas.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "frame_id"))


@query(
    "WITH f AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT 'build' AS component, 'folders' AS \"check\", count(*) >= 1 AS ok, 'missing folders' AS issue FROM f UNION ALL SELECT 'build', 'images', sum(n) >= 10, 'missing images' FROM f "
    "UNION ALL SELECT 'build', 'disk', FALSE, 'under 1 GB of disk free' UNION ALL SELECT 'build', 'index', TRUE, 'invalid index file'"
)
def build_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.build_gates(_files(spark, sf_dir), free_bytes=10**8, index_bytes=5_000)


@query("SELECT count(*) AS frames, count(DISTINCT label) AS folders, 64::BIGINT AS dimension, count(*) * 256 AS vector_bytes, 0::BIGINT AS without_vector FROM embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.index_stats(schemas.frames(spark, sf_dir))


@query("SELECT substr(md5(url), 1, 12) AS share_id, 'n1' AS node, url AS path, CASE WHEN url LIKE '%.lumen' THEN 'index' ELSE 'folder' END AS kind FROM pages WHERE page_id % 7 <> 0 GROUP BY url")
def shared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of all paths, from which those of every seventh page are left out, in two additions."""
    p = schemas.table(spark, sf_dir, "pages").where("page_id % 7 <> 0").select("page_id", F.col("url").alias("path"))
    one = scan.shares(p.where("page_id % 2 = 0").select("path"), "n1")
    return scan.shares_of(scan.add_shares(one, scan.shares(p.select("path"), "n1")), "n1")


@query("SELECT conv_id, count(*) AS turns, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 10 GROUP BY 1")
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = schemas.table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 10")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.concat_ws(":", s["turn"], s["role"]))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(turns, " ").alias("context"))
