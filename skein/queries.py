"""The catalogue of queries and their DuckDB equivalents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs, paths, text, vectors
from .model import EXCLUDES, LANGUAGES, TEXT_SUFFIXES
from .operators import catalog, chunk, embed, jobs, memory, search, stats, syntax
from .plans import adapters, scratch, settings
from .streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapters.load(spark, sf_dir, name)


# --- vectors -------------------------------------------------------------------------------------------------------

_V = adapters.cte("vectors").replace("embedding from", "CAST(embedding AS DOUBLE[]) AS e from")
_Q = ", q AS (SELECT e AS qe FROM vectors WHERE vec_id = 0)"


def _first(rows: DataFrame, column: str) -> list[float] | None:
    """One cell, or nothing where there is no row."""
    found = rows.select(column).first()
    return found[0] if found else None


def _query_vector(vectors: DataFrame) -> list[float] | None:
    return _first(vectors.filter("vec_id = 0"), "embedding")


def _topk_sql(where: str = "") -> str:
    return f"{_V}{_Q} SELECT vec_id, repo_name, round(list_cosine_similarity(e, qe), 4) AS score FROM vectors, q {where} ORDER BY list_cosine_similarity(e, qe) DESC NULLS LAST, vec_id LIMIT 10"


@query("vector_topk", _topk_sql())
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(spark, sf_dir, "vectors")
    return search.top_k(v, _query_vector(v), 10)


@query("vector_topk_filtered", _topk_sql("WHERE repo_name IN ('repo1', 'repo2', 'repo3')"))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(spark, sf_dir, "vectors")
    return search.top_k(v, _query_vector(v), 10, ["repo1", "repo2", "repo3"])


@query("vector_topk_empty_filter", _topk_sql())
def vector_topk_empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(spark, sf_dir, "vectors")
    return search.top_k(v, _query_vector(v), 10, [])


@query(
    "vector_topk_batch",
    f"""{_V} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(s, 4) AS score FROM (
      SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(b.e, a.e) AS s,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(b.e, a.e) DESC NULLS LAST, b.vec_id) AS rank
      FROM vectors a, vectors b WHERE a.vec_id % 100 = 0) WHERE rank <= 4""",
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(spark, sf_dir, "vectors")
    return search.top_k_batch(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 4)


@query("group_centroids", f"{_V} SELECT repo_name, CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean FROM (SELECT repo_name, unnest(e) AS x, unnest(range(0, 64)) AS pos FROM vectors) GROUP BY repo_name, pos")
def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vectors(store(spark, sf_dir, "vectors"), "repo_name", "embedding")
    return means.select("repo_name", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


def _relationships_sql(limit: int, where: str = "") -> str:
    return f"""{_V}, cells AS (SELECT repo_name, pos, avg(x) AS x FROM (SELECT repo_name, unnest(e) AS x, unnest(range(0, 64)) AS pos FROM vectors) GROUP BY repo_name, pos),
      m AS (SELECT repo_name, list(x ORDER BY pos) AS e FROM cells GROUP BY repo_name), n AS (SELECT repo_name, count(*) AS n FROM vectors GROUP BY repo_name), c AS (SELECT * FROM m JOIN n USING (repo_name))
      SELECT a.repo_name AS repo_a, b.repo_name AS repo_b, round(list_cosine_similarity(a.e, b.e), 4) AS similarity, a.n AS chunks_a, b.n AS chunks_b
      FROM c a JOIN c b ON a.repo_name < b.repo_name {where} ORDER BY similarity DESC, repo_a, repo_b LIMIT {limit}"""


@query("relationships_all", _relationships_sql(20))
def relationships_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relationships(store(spark, sf_dir, "vectors"), 20)


@query("relationships_all_rest", _relationships_sql(25))
def relationships_all_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relationships(store(spark, sf_dir, "vectors"), 25)


@query("relationships_one", _relationships_sql(20, "WHERE a.repo_name = 'repo3' OR b.repo_name = 'repo3'"))
def relationships_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relationships(store(spark, sf_dir, "vectors"), 20, "repo3")


_TOP30 = f"{_V}{_Q}, top AS (SELECT vec_id, repo_name, round(list_cosine_similarity(e, qe), 4) AS score, list_cosine_similarity(e, qe) AS similarity FROM vectors, q ORDER BY similarity DESC NULLS LAST, vec_id LIMIT 30)"


@query(
    "unified_groups",
    f"{_TOP30} SELECT vec_id, repo_name, score, CAST(rank AS INT) AS rank, group_size FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY similarity DESC NULLS LAST, vec_id) AS rank, count(*) OVER (PARTITION BY repo_name) AS group_size FROM top) WHERE rank <= 4",
)
def unified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(spark, sf_dir, "vectors")
    return search.group_results(search.top_k(v, _query_vector(v), 30, exact=True), 4)


@query(
    "related_edges_for_results",
    _relationships_sql(20).replace("WITH", "WITH edges AS (WITH", 1)
    + f"), best AS ({_TOP30.replace('LIMIT 30)', 'LIMIT 3) SELECT DISTINCT repo_name FROM top')}) SELECT * FROM edges WHERE repo_a IN (SELECT repo_name FROM best) OR repo_b IN (SELECT repo_name FROM best) ORDER BY similarity DESC, repo_a, repo_b LIMIT 10",
)
def related_edges_for_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = store(spark, sf_dir, "vectors")
    return search.related_edges(search.relationships(v, 20), search.top_k(v, _query_vector(v), 3), 10)


# --- chunks --------------------------------------------------------------------------------------------------------


def _chunks_sql(window: int, step: int) -> str:
    return f"""{adapters.cte("files")}, w AS (SELECT * EXCLUDE (start), start, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS k,
        substring(content, CAST(start AS INT) + 1, {window}) AS piece FROM (SELECT *, unnest(range(0, length(content), {step})) AS start FROM files)),
      chunks AS (SELECT repo_name, file_path, doc_id, CAST(k AS INT) AS chunk_index, CAST(start AS INT) AS start,
        CASE WHEN start + {window} >= length(content) OR strpos(reverse(piece), chr(10)) = 0 OR length(piece) - strpos(reverse(piece), chr(10)) <= 0 THEN piece
             ELSE left(piece, length(piece) - strpos(reverse(piece), chr(10))) END AS chunk, length(content) AS n FROM w)"""


_CHUNKS = _chunks_sql(1600, 1400)


def _chunks(spark: SparkSession, sf_dir: str, size: int = 400, overlap: int = 50) -> DataFrame:
    return chunk.sliding_chunks(store(spark, sf_dir, "files"), size, overlap)


def _chunk_rows(rows: DataFrame) -> DataFrame:
    return rows.select("repo_name", "file_path", "doc_id", "chunk_index", "start", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


_CHUNK_COLUMNS = "SELECT repo_name, file_path, doc_id, chunk_index, start, length(chunk) AS n_chars, md5(chunk) AS digest FROM chunks"


@query("sliding_chunks", f"{_CHUNKS} {_CHUNK_COLUMNS}")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(_chunks(spark, sf_dir))


@query("sliding_chunks_small", f"{_chunks_sql(400, 320)} {_CHUNK_COLUMNS}")
def sliding_chunks_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(_chunks(spark, sf_dir, 100, 20))


@query(
    "chunk_coverage_gaps",
    f"""{_CHUNKS} SELECT repo_name, CAST(sum(gap) AS BIGINT) AS uncovered FROM (
      SELECT repo_name, greatest(0, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY chunk_index), n) - (start + length(chunk))) AS gap FROM chunks) GROUP BY repo_name""",
)
def chunk_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The next window begins a fixed step later, so no window function is needed.
    following = F.least(F.col("start") + 1400, F.length("content"))
    gap = F.greatest(F.lit(0), following - (F.col("start") + F.length("chunk")))
    return _chunks(spark, sf_dir).groupBy("repo_name").agg(F.sum(gap).cast("long").alias("uncovered"))


@query("chunk_metadata_json", f"""{_CHUNKS} SELECT doc_id, chunk_index, '{{"start_line":0}}' AS metadata, CAST(0 AS INT) AS start_line, '{{"name":null,"start_line":' || start || '}}' AS named FROM chunks""")
def chunk_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).withColumn("metadata", chunk.text_metadata())
    return rows.select("doc_id", "chunk_index", "metadata", F.get_json_object("metadata", "$.start_line").cast("int").alias("start_line"), chunk.metadata(F.lit(None).cast("string"), F.col("start")).alias("named"))


_TYPED = f"{_CHUNKS}, typed AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'function_definition' ELSE 'class_definition' END AS chunk_type FROM chunks)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "function_definition").otherwise("class_definition")
    return _chunks(spark, sf_dir).withColumn("chunk_type", kind)


@query("stats_chunk_types", f"{_TYPED} SELECT repo_name, chunk_type, count(*) AS count FROM typed GROUP BY ALL")
def stats_chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunk_types(_typed(spark, sf_dir))


@query(
    "stats_extensions",
    f"{adapters.cte('files')} SELECT CASE WHEN ext = '' THEN '(none)' ELSE '.' || ext END AS extension, count(*) AS count FROM (SELECT lower(split_part(file_path, '.', -1)) AS ext FROM files WHERE strpos(file_path, '.') > 0) GROUP BY ext ORDER BY count DESC, extension LIMIT 8",
)
def stats_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extensions(store(spark, sf_dir, "files"), 8)


@query(
    "stats_percent",
    f"{_TYPED}, repos AS ({adapters.REPOS}) SELECT t.repo_name, chunk_type, t.count, total_chunks, CASE WHEN total_chunks > 0 THEN round(t.count * 100.0::DOUBLE / total_chunks, 4) ELSE 0.0::DOUBLE END AS percent FROM (SELECT repo_name, chunk_type, count(*) AS count FROM typed GROUP BY ALL) t JOIN repos r ON r.name = t.repo_name",
)
def stats_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_shares(stats.chunk_types(_typed(spark, sf_dir)), store(spark, sf_dir, "repos"))


@query(
    "chunks_upsert",
    f"""{_TYPED}, old AS (SELECT doc_id, chunk_index, chunk_type, chunk FROM typed WHERE doc_id % 4 <> 0), new AS (SELECT doc_id, chunk_index, 'text' AS chunk_type, '+' || chunk AS chunk FROM typed WHERE doc_id % 3 = 0)
      SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.chunk_index, o.chunk_index) AS chunk_index, coalesce(o.chunk_type, n.chunk_type) AS chunk_type, md5(coalesce(n.chunk, o.chunk)) AS digest
      FROM old o FULL JOIN new n ON o.doc_id = n.doc_id AND o.chunk_index = n.chunk_index""",
)
def chunks_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).select("doc_id", "chunk_index", "chunk_type", "chunk")
    new = rows.filter("doc_id % 3 = 0").withColumn("chunk_type", F.lit("text")).withColumn("chunk", F.concat(F.lit("+"), "chunk"))
    return catalog.upsert_chunks(rows.filter("doc_id % 4 <> 0"), new, ("doc_id", "chunk_index")).select("doc_id", "chunk_index", "chunk_type", F.md5("chunk").alias("digest"))


@query("repo_delete", f"{_CHUNKS} SELECT repo_name, count(*) AS chunks FROM chunks WHERE repo_name NOT IN ('src0', 'src7') GROUP BY repo_name")
def repo_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src0",), ("src7",)], "name string")
    return catalog.delete(_chunks(spark, sf_dir), gone).groupBy("repo_name").agg(F.count(F.lit(1)).alias("chunks"))


@query("orphan_chunks", f"{_CHUNKS}, repos AS ({adapters.REPOS}) SELECT repo_name, doc_id, chunk_index FROM chunks WHERE repo_name NOT IN (SELECT name FROM repos WHERE type <> 'gitlab')")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store(spark, sf_dir, "repos").filter("type <> 'gitlab'")
    return catalog.orphans(_chunks(spark, sf_dir), kept).select("repo_name", "doc_id", "chunk_index")


# --- files ---------------------------------------------------------------------------------------------------------

_F = adapters.cte("files")
_SUFFIX = r"lower(regexp_extract(split_part(file_path, '/', -1), '(?s)\A.+(\.[^.]+)\z', 1))"
_ALLOWED = ", ".join(f"'{s}'" for s in (*LANGUAGES, *TEXT_SUFFIXES))
_WHOLE, _PART = (r.replace(r"\Z", r"\z") for r in globs.compile_globs(EXCLUDES))
_EXCLUDED = "(regexp_matches({p}, '{w}') OR regexp_matches('/' || {p}, '{w}') OR len(list_filter(string_split({p}, '/'), lambda c: regexp_matches(c, '{c}'))) > 0)"
_SELF = _EXCLUDED.format(p="file_path", w=_WHOLE, c=_PART)
_PRUNED = f"len(list_filter(list_transform(range(1, len(string_split(file_path, '/')) + 1), lambda n: array_to_string(string_split(file_path, '/')[1:n], '/')), lambda p: {_EXCLUDED.format(p='p', w=_WHOLE, c=_PART)})) > 0"
_LANG = "CASE " + " ".join(f"WHEN {_SUFFIX} = '{s}' THEN '{v}'" for s, v in LANGUAGES.items()) + " ELSE 'text' END"


@query("detect_language", f"{_F} SELECT doc_id, file_path, {_LANG} AS language, CASE WHEN lang IN ('auto', '', 'en') THEN {_LANG} ELSE lang END AS overridden FROM files")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    override = F.when(F.col("lang") == "en", "auto").otherwise(F.col("lang"))
    return store(spark, sf_dir, "files").select("doc_id", "file_path", paths.detect_language(F.col("file_path")).alias("language"), paths.detect_language(F.col("file_path"), override).alias("overridden"))


@query("suffix_filter", f"{_F} SELECT doc_id, file_path, {_SUFFIX} AS suffix FROM files WHERE {_SUFFIX} IN ({_ALLOWED})")
def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store(spark, sf_dir, "files").filter(paths.indexable(F.col("file_path")))
    return files.select("doc_id", "file_path", paths.suffix(F.col("file_path")).alias("suffix"))


@query("glob_exclude", f"{_F} SELECT doc_id, file_path, {_SELF} AS excluded, {_PRUNED} AS pruned FROM files")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return store(spark, sf_dir, "files").select("doc_id", "file_path", globs.excluded(path, EXCLUDES).alias("excluded"), globs.pruned(path, EXCLUDES).alias("pruned"))


@query("size_cap", f"{_F} SELECT doc_id, file_path, size FROM files WHERE size <= 2 * 1024")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "files").filter(F.col("size") <= 2 * 1024).select("doc_id", "file_path", "size")


@query("indexable_files", f"{_F} SELECT repo_name, doc_id, file_path, {_LANG} AS language FROM files WHERE size <= 500 * 1024 AND {_SUFFIX} IN ({_ALLOWED}) AND NOT ({_PRUNED})")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    kept = store(spark, sf_dir, "files").filter((F.col("size") <= 500 * 1024) & paths.indexable(path) & ~globs.pruned(path, EXCLUDES))
    return kept.select("repo_name", "doc_id", "file_path", paths.detect_language(path).alias("language"))


@query(
    "list_dir",
    f"""{_F}, r AS (SELECT substring(file_path, 10) AS rest, size FROM files WHERE file_path LIKE 'docs/a.b/%'), c AS (SELECT split_part(rest, '/', 1) AS name, contains(rest, '/') AS deep, size FROM r)
      SELECT name, CASE WHEN deep THEN 'directory' ELSE 'file' END AS type, CASE WHEN NOT deep THEN max(size) END AS size, 'docs/a.b/' || name AS path FROM c GROUP BY name, deep""",
)
def list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.list_dir(store(spark, sf_dir, "files"), "docs/a.b")


@query(
    "breadcrumbs",
    f"""{_F}, p AS (SELECT doc_id, list_filter(string_split(file_path, '/'), lambda x: x <> '') AS parts FROM files)
      SELECT doc_id, CAST(n - 1 AS INT) AS pos, parts[n] AS name, array_to_string(parts[1:n], '/') AS path FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM p)""",
)
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "files").select("doc_id", F.posexplode(paths.breadcrumbs(F.col("file_path"))).alias("pos", "c"))
    return rows.select("doc_id", "pos", "c.name", "c.path")


@query("get_file", f"{_F} SELECT repo_name, file_path, content, size FROM files WHERE repo_name = 'src14' AND file_path = 'en/f14.MD'")
def get_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = "/en/f14.MD".lstrip("/")
    return store(spark, sf_dir, "files").filter((F.col("repo_name") == "src14") & (F.col("file_path") == wanted)).select("repo_name", "file_path", "content", "size")


def _flat(n: int) -> str:
    flat = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > {n} THEN left({flat}, {n}) || '...' ELSE {flat} END"


@query("snippets", f"SELECT doc_id, {_flat(260)} AS snippet, {_flat(140)} AS short FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), 260).alias("snippet"), text.snippet(F.col("text"), 140).alias("short"))


@query(
    "human_bytes",
    """SELECT doc_id, CASE WHEN b IS NULL OR b = 0 THEN '—' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', round(b / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.1f', round(b / 1048576.0::DOUBLE, 1)) || ' MB' END AS label
      FROM (SELECT doc_id, n_chars * (doc_id % 5) * (1 + doc_id % 7 * 100) AS b FROM documents)""",
)
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * (F.col("doc_id") % 5) * (1 + F.col("doc_id") % 7 * 100)
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(n).alias("label"))


# --- repositories --------------------------------------------------------------------------------------------------

_R = adapters.cte("repos")


@query("repo_list", f"{_R} SELECT name, type, status, total_chunks FROM repos")
def repo_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "repos").orderBy("name")


@query("repo_totals", f"{_R} SELECT CAST(sum(total_chunks) AS BIGINT) AS total_chunks, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (type <> 'local') AS remote FROM repos")
def repo_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.repo_totals(store(spark, sf_dir, "repos"))


@query("pending_repos", f"{_R} SELECT name, type, status, total_chunks FROM repos WHERE status = 'pending' AND type <> 'local'")
def pending_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = store(spark, sf_dir, "repos")
    return catalog.pending_repos(repos, repos.filter("type <> 'local'"))


@query(
    "catalog_upsert",
    f"""{_R}, n AS (SELECT CASE WHEN total_chunks % 2 = 0 THEN name ELSE name || '-new' END AS name, 'local' AS type FROM repos)
      SELECT coalesce(n.name, c.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.type ELSE c.type END AS type, coalesce(c.status, 'pending') AS status, coalesce(c.total_chunks, 0) AS total_chunks FROM repos c FULL JOIN n ON c.name = n.name""",
)
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = store(spark, sf_dir, "repos")
    new = repos.select(F.when(F.col("total_chunks") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("-new"))).alias("name"), F.lit("local").alias("type"))
    return catalog.upsert(repos, new)


# --- jobs and queue ------------------------------------------------------------------------------------------------

_J = adapters.cte("jobs")
_LATEST = "SELECT job_id, s.status AS status, s.tool AS tool, s.error_message AS error_message, s.params AS params, first_at, updated_at, transitions FROM (SELECT job_id, arg_max({'status': status, 'tool': tool, 'error_message': error_message, 'params': params}, created_at) AS s, min(created_at) AS first_at, max(created_at) AS updated_at, count(*) AS transitions FROM jobs GROUP BY job_id)"


@query("jobs_recent", f"{_J} SELECT * FROM jobs ORDER BY created_at DESC, event_id LIMIT 50")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(store(spark, sf_dir, "jobs"))


@query("jobs_by_status", f"{_J} SELECT * FROM jobs WHERE status = 'error' ORDER BY created_at DESC, event_id LIMIT 50")
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(store(spark, sf_dir, "jobs"), 50, "error")


@query("job_latest_state", f"{_J} {_LATEST}")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(store(spark, sf_dir, "jobs"))


@query("job_result_view", f"{_J} SELECT job_id, v AS view, CASE WHEN v = 'error' THEN coalesce(error_message, 'unknown error') END AS message FROM (SELECT *, CASE WHEN status IN ('pending', 'running') THEN 'not_ready' WHEN status = 'error' THEN 'error' ELSE 'done' END AS v FROM ({_LATEST}))")
def job_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.result_view(jobs.latest(store(spark, sf_dir, "jobs")))


@query(
    "job_durations",
    f"""{_J} SELECT job_id, ms, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1f', round(ms / 1000.0::DOUBLE, 1)) || 's' ELSE printf('%.1f', round(ms / 60000.0::DOUBLE, 1)) || 'm' END AS label
      FROM (SELECT job_id, (epoch_us(updated_at) // 1000 - epoch_us(first_at) // 1000) % 200000 AS ms FROM ({_LATEST}))""",
)
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.unix_millis(F.col("updated_at").cast("timestamp")) - F.unix_millis(F.col("first_at").cast("timestamp"))) % 200000
    return jobs.latest(store(spark, sf_dir, "jobs")).select("job_id", ms.alias("ms")).select("job_id", "ms", text.duration_label(F.col("ms")).alias("label"))


@query("job_active_count", f"{_J} SELECT count(*) FILTER (status IN ('pending', 'running')) AS active FROM ({_LATEST})")
def job_active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(store(spark, sf_dir, "jobs")).agg(F.count_if(F.col("status").isin("pending", "running")).alias("active"))


@query("job_search", f"{_J} SELECT job_id, status, tool, error_message FROM ({_LATEST}) WHERE contains(lower(job_id), '50') OR contains(lower(tool), '50') OR contains(lower(status), '50') OR contains(lower(coalesce(error_message, '')), '50') ORDER BY job_id LIMIT 8")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(store(spark, sf_dir, "jobs")).filter(jobs.matches(" 50 ")).select("job_id", "status", "tool", "error_message").orderBy("job_id").limit(8)


@query("job_params_json", f"{_J} SELECT event_id, CAST(json_extract(params, '$.k') AS BIGINT) AS k FROM jobs")
def job_params_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "jobs").select("event_id", F.get_json_object("params", "$.k").cast("long").alias("k"))


@query("job_stale", f"{_J} SELECT job_id, status, updated_at FROM ({_LATEST}) WHERE status IN ('pending', 'running') AND updated_at < (SELECT max(created_at) FROM jobs) - INTERVAL 1 DAY")
def job_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "jobs")
    now = rows.agg(F.max("created_at")).first()[0]
    return jobs.stale(rows, F.lit(now).cast(rows.schema["created_at"].dataType), "1 DAY").select("job_id", "status", "updated_at")


@query("queue_pending", f"{adapters.cte('queue')} SELECT * FROM queue WHERE processed_at IS NULL ORDER BY requested_at, id LIMIT 10")
def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pending(store(spark, sf_dir, "queue"))


@query("queue_resolve", f"{adapters.cte('queue', 'repos')} SELECT q.id, r.name FROM queue q JOIN repos r ON q.repo_name IS NULL OR q.repo_name = r.name WHERE q.processed_at IS NULL")
def queue_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.resolve(store(spark, sf_dir, "queue"), store(spark, sf_dir, "repos"))


@query(
    "session_ttl",
    "SELECT sha256(CAST(event_id AS VARCHAR)) AS token_hash, user_id, ts + INTERVAL 24 HOUR AS expires_at FROM events WHERE ts + INTERVAL 24 HOUR > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR",
)
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sessions = events.select(F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), "user_id", F.expr("ts + INTERVAL '24' HOUR").alias("expires_at"))
    now = events.agg(F.expr("max(ts) - INTERVAL '6' HOUR")).first()[0]
    return jobs.live_sessions(sessions, F.lit(now))


# --- remote catalogues, memories, settings -------------------------------------------------------------------------

_M = adapters.cte("remote")


@query("remote_map", f"{_M} SELECT id, full_name, replace(full_name, '/', '-') AS slug, coalesce(visibility, 'private') <> 'public' AS private, 'main' AS default_branch FROM remote")
def remote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.map_remote(store(spark, sf_dir, "remote"))


@query("remote_search", f"{_M} SELECT id, host, full_name, visibility FROM remote WHERE contains(lower(full_name), 'en/') ORDER BY full_name, id LIMIT 30")
def remote_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_remote(store(spark, sf_dir, "remote"), " EN/ ")


_CONFIGURED = f"{_M}, names AS (SELECT DISTINCT replace(full_name, '/', '-') AS name FROM remote WHERE id % 2 = 0)"


def _configured(rows: DataFrame) -> DataFrame:
    return rows.filter("id % 2 = 0").select(text.slug(F.col("full_name")).alias("name")).distinct()


@query("remote_not_configured", f"{_CONFIGURED} SELECT id, full_name FROM remote WHERE replace(full_name, '/', '-') NOT IN (SELECT name FROM names)")
def remote_not_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "remote")
    return catalog.not_configured(rows, _configured(rows)).select("id", "full_name")


@query("remote_not_configured_first_slash", f"{_CONFIGURED} SELECT id, full_name FROM remote WHERE regexp_replace(full_name, '/', '-') NOT IN (SELECT name FROM names)")
def remote_not_configured_first_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "remote")
    return catalog.not_configured(rows, _configured(rows), first_slash=True).select("id", "full_name")


@query("memory_list", f"{adapters.cte('memories')} SELECT memory_id, user_id, memory, role FROM memories WHERE user_id = 'u3' ORDER BY memory_id LIMIT 20")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.listing(store(spark, sf_dir, "memories"), "u3", 20)


_META = "CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('{\"turn\":', cast(turn as varchar(9)), '}') WHEN 2 THEN '[1]' WHEN 3 THEN '5' ELSE '{broken' END"


@query(
    "memory_metadata",
    f"""SELECT conv_id, turn, CASE WHEN m IS NULL THEN 'empty' WHEN json_valid(m) AND json_type(m) = 'OBJECT' THEN 'object' ELSE 'error' END AS kind,
        CASE WHEN m IS NULL THEN '{{}}' WHEN json_valid(m) AND json_type(m) = 'OBJECT' THEN m END AS metadata FROM (SELECT conv_id, turn, {_META} AS m FROM conversations)""",
)
def memory_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_META} AS m")
    return rows.select("conv_id", "turn", memory.metadata_kind(F.col("m")).alias("kind"), memory.normalize_metadata(F.col("m")).alias("metadata"))


#: Layers of settings, the first event first: some are missing, some empty.
_LAYERS = "SELECT concat('u', CAST(user_id AS varchar(20)), '.', event_type) AS key, event_id AS rank, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE props END AS value FROM events"


def _from_events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query("settings_resolve", f"SELECT key, arg_min(value, rank) AS value FROM ({_LAYERS}) WHERE nullif(value, '') IS NOT NULL GROUP BY key")
def settings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.resolve(_from_events(spark, sf_dir, _LAYERS))


_DEFAULTS = "SELECT concat('u', CAST(user_id AS varchar(20))) AS key, min_by(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, event_id) AS value FROM events WHERE user_id % 7 > 0 GROUP BY user_id"
_CURRENT = "SELECT concat('u', CAST(user_id AS varchar(20))) AS key, max_by(CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_type END, event_id) AS value FROM events GROUP BY user_id"
_DUCK_BY = (("min_by(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END, event_id)", "list(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END ORDER BY event_id)[1]"), ("max_by(CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_type END, event_id)", "list(CASE WHEN event_id % 5 = 1 THEN NULL ELSE event_type END ORDER BY event_id)[-1]"))


def _duck(sql: str) -> str:
    for ours, theirs in _DUCK_BY:
        sql = sql.replace(ours, theirs)
    return sql


@query("override_diff", _duck(f"SELECT c.key, c.value, d.value AS default_value FROM ({_CURRENT}) c LEFT JOIN ({_DEFAULTS}) d ON c.key = d.key WHERE c.value IS DISTINCT FROM d.value"))
def override_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.overrides(_from_events(spark, sf_dir, _CURRENT), _from_events(spark, sf_dir, _DEFAULTS))


@query(
    "text_search_hash",
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS word FROM documents),
      c AS (SELECT doc_id, CAST('0x' || md5(word)[1:2] AS INT) % 16 AS place, count(*) AS n FROM w GROUP BY ALL),
      v AS (SELECT doc_id, list(n::DOUBLE) AS ns, sum(n * n)::DOUBLE AS nn FROM c GROUP BY doc_id),
      d AS (SELECT a.doc_id, sum(a.n * q.n)::DOUBLE AS dot FROM c a JOIN c q ON a.place = q.place WHERE q.doc_id = 3 GROUP BY a.doc_id)
      SELECT documents.doc_id, round(coalesce(dot, 0) / sqrt(nn * (SELECT nn FROM v WHERE doc_id = 3)), 4) AS score FROM documents LEFT JOIN v USING (doc_id) LEFT JOIN d USING (doc_id) ORDER BY coalesce(dot, 0) / sqrt(nn * (SELECT nn FROM v WHERE doc_id = 3)) DESC NULLS LAST, doc_id LIMIT 10""",
)
def text_search_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = _first(embed.hashed_columns(docs.filter("doc_id = 3"), "doc_id", "text"), "embedding")
    found = embed.hashed_columns(docs, "doc_id", "text").withColumn("repo_name", F.lit(""))
    return search.top_k(found, wanted, 10, keys=("doc_id",)).select("doc_id", "score")


_PY = "import os|||def top_@@(a):|    return 'a value long enough'|||class C@@:|    size = 'one more value'|"
_GO = "package x||func (s *S) Do@@(a int) error {|\treturn nil // } is no end|}|"
_SOURCE_COLUMNS = [
    "source AS repo_name", "doc_id", "concat('d', CAST(doc_id AS varchar(20)), CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.txt' END) AS file_path",
    f"""replace(replace(CASE doc_id % 3 WHEN 0 THEN '{_PY.replace("'", '"')}' WHEN 1 THEN '{_GO}' ELSE concat(text, '!') END, '@@', CAST(doc_id AS varchar(20))), '|', chr(10)) AS content""",
]


_SOURCES = f"WITH files AS (SELECT {', '.join(_SOURCE_COLUMNS)} FROM documents)"


@query(
    "syntax_chunks",
    f"""{_CHUNKS.replace(adapters.cte("files"), _SOURCES)}, l AS (SELECT *, string_split(content, chr(10)) AS lines FROM files),
      d AS (SELECT repo_name, file_path, 0 AS chunk_index, 'function_definition' AS chunk_type, array_to_string(lines[4:5], chr(10)) AS chunk, '{{"name": "top_' || doc_id || '", "start_line": 3}}' AS metadata FROM l WHERE doc_id % 3 = 0
        UNION ALL SELECT repo_name, file_path, 1, 'class_definition', array_to_string(lines[8:9], chr(10)), '{{"name": "C' || doc_id || '", "start_line": 7}}' FROM l WHERE doc_id % 3 = 0
        UNION ALL SELECT repo_name, file_path, 0, 'method_declaration', array_to_string(lines[3:5], chr(10)), '{{"name": "Do' || doc_id || '", "start_line": 2}}' FROM l WHERE doc_id % 3 = 1
        UNION ALL SELECT repo_name, file_path, chunk_index, 'text', chunk, '{{"start_line":0}}' FROM chunks WHERE doc_id % 3 = 2)
      SELECT repo_name, file_path, CAST(chunk_index AS INT) AS chunk_index, chunk_type, md5(chunk) AS digest, metadata FROM d""",
)
def syntax_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").selectExpr(*_SOURCE_COLUMNS)
    return syntax.chunk_files(files).select("repo_name", "file_path", "chunk_index", "chunk_type", F.md5("chunk").alias("digest"), "metadata")


def _md5_client() -> embed.Client:
    """Four numbers of each text's MD5, which SQL can check."""
    return lambda texts: [[float(b) for b in hashlib.md5(t.encode()).digest()[:4]] for t in texts]


@query(
    "embedded_chunks",
    f"{_CHUNKS} SELECT repo_name, doc_id, chunk_index, " + ", ".join(f"CAST('0x' || md5(chunk)[{2 * k + 1}:{2 * k + 2}] AS INT) AS v{k}" for k in range(4)) + " FROM chunks",
)
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("repo_name", "doc_id", "chunk_index", F.col("chunk").alias("content"))
    return embed.with_embeddings(rows, _md5_client).select("repo_name", "doc_id", "chunk_index", *[F.col("embedding")[k].cast("int").alias(f"v{k}") for k in range(4)])


#: Calls that a client refuses: how many before it answers (-1: always), and with what message, by document.
_RETRIES = "SELECT CAST(doc_id AS varchar(20)) AS name, CAST(n_chars % 46 AS int) AS texts, CAST(doc_id % 3 AS int) - 1 AS refusals, CASE WHEN doc_id % 5 = 0 THEN 'bad key' WHEN doc_id % 2 = 0 THEN '429' ELSE 'Rate limit' END AS message FROM documents"


def _retry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for name, n, refusals, message in zip(frame.name, frame.texts, frame.refusals, frame.message, strict=True):
            calls, waits = [], []

            def client(texts: list[str], calls: list = calls, refusals: int = refusals, message: str = message) -> list[list[float]]:
                calls.append(len(texts))
                if refusals < 0 or len(calls) <= refusals:
                    raise RuntimeError(message)
                return [[0.0] for _ in texts]

            try:
                outcome = f"{len(embed.embed_all(['x'] * n, client, waits.append))} vectors"
            except RuntimeError:
                outcome = "error"
            out.append((name, ",".join(map(str, calls)), ",".join(map(str, waits)), outcome))
        yield pd.DataFrame(out, columns=["name", "calls", "waits", "outcome"])


_PARTS = "[least(20, texts - 20 * k) for k in range(0, (texts + 19) // 20)]"


@query(
    "embed_retry",
    f"""WITH r AS (SELECT *, {_PARTS} AS b, message <> 'bad key' AS limited FROM ({_RETRIES})), s AS (SELECT *, b[1] AS n, [b[1] // (1 << k) for k in range(0, 6) if b[1] // (1 << k) > 0] AS down FROM r)
      SELECT name, CASE WHEN texts = 0 THEN '' WHEN refusals = 0 THEN array_to_string(b, ',') WHEN NOT limited THEN CAST(n AS VARCHAR) WHEN refusals < 0 THEN array_to_string(down || [1, 1, 1, 1], ',')
          WHEN n = 1 THEN '1,1' ELSE array_to_string([n, n // 2, n - n // 2] || b[2:], ',') END AS calls,
        CASE WHEN texts = 0 OR NOT limited OR refusals = 0 THEN '' WHEN refusals < 0 THEN '1,2,4,8' WHEN n = 1 THEN '1' ELSE '' END AS waits,
        CASE WHEN texts = 0 OR refusals = 0 OR (refusals = 1 AND limited) THEN texts || ' vectors' ELSE 'error' END AS outcome FROM s""",
)
def embed_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls and waits for a document's number of texts, with a client that refuses some."""
    rows = spark.sql(_RETRIES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return rows.mapInPandas(_retry, "name string, calls string, waits string, outcome string")


@query(
    "memory_search",
    f"""{adapters.cte("memories")}, w AS (SELECT memory_id, user_id, unnest(list_filter(regexp_split_to_array(lower(memory), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS word FROM memories),
      c AS (SELECT memory_id, user_id, CAST('0x' || md5(word)[1:2] AS INT) % 16 AS place, count(*) AS n FROM w GROUP BY ALL),
      v AS (SELECT memory_id, user_id, sum(n * n)::DOUBLE AS nn FROM c GROUP BY ALL),
      d AS (SELECT a.memory_id, sum(a.n * q.n)::DOUBLE AS dot FROM c a JOIN c q ON a.place = q.place WHERE q.memory_id = '3-1' GROUP BY ALL)
      SELECT m.memory_id, m.user_id, round(coalesce(dot, 0) / sqrt(nn * (SELECT nn FROM v WHERE memory_id = '3-1')), 4) AS score FROM memories m LEFT JOIN v USING (memory_id) LEFT JOIN d ON d.memory_id = m.memory_id WHERE m.user_id = 'u3'
      ORDER BY coalesce(dot, 0) / sqrt(nn * (SELECT nn FROM v WHERE memory_id = '3-1')) DESC NULLS LAST, m.memory_id LIMIT 10""",
)
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "memories")
    vectors_ = embed.hashed_columns(rows, "memory_id", "memory")
    wanted = _first(vectors_.filter("memory_id = '3-1'"), "embedding")
    return memory.search(rows.select("memory_id", "user_id").join(vectors_, "memory_id"), wanted, "u3", 10)


@query(
    "queue_stream",
    f"""{adapters.cte("queue", "repos")} SELECT CAST(row_number() OVER (ORDER BY min(q.requested_at), r.name) AS INT) AS place, r.name FROM queue q JOIN repos r ON q.repo_name IS NULL OR q.repo_name = r.name
      WHERE q.processed_at IS NULL GROUP BY r.name""",
)
def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending requests go through the stream in one batch; the repositories in the order in which they are handled."""
    base = scratch.folder(spark)
    store(spark, sf_dir, "queue").filter("processed_at IS NULL").select("id", "repo_name", "requested_at").write.json(f"{base}/requests")
    handled: list[str] = []
    queue.consume(spark, f"{base}/requests", f"{base}/acknowledged", store(spark, sf_dir, "repos").select("name"), handled.append, files_per_batch=1 << 30).awaitTermination()
    return spark.createDataFrame([(k + 1, name) for k, name in enumerate(handled)], "place int, name string")


# --- state of jobs, sessions, repositories and settings --------------------------------------------------------------

_CHANGES = "SELECT -event_id AS event_id, job_id, tool, 'done' AS status, NULL AS error_message, params, created_at + INTERVAL 90 DAY AS created_at, user_id FROM jobs WHERE status = 'error' AND event_id % 2 = 0"


@query("job_update", f"{_J}, log AS (SELECT * FROM jobs UNION ALL BY NAME {_CHANGES}) {_LATEST.replace('FROM jobs', 'FROM log')}")
def job_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs end after all."""
    rows = store(spark, sf_dir, "jobs")
    done = rows.filter("status = 'error' and event_id % 2 = 0").withColumns({"event_id": -F.col("event_id"), "status": F.lit("done"), "error_message": F.lit(None).cast("string"), "created_at": F.expr("created_at + INTERVAL '90' DAY")})
    unknown = done.withColumn("job_id", F.concat(F.lit("no-"), "job_id"))
    return jobs.latest(jobs.advance(rows, done.union(unknown)))


@query(
    "job_read",
    f"""{_J}, w AS (SELECT DISTINCT 'job-' || (user_id * 2) AS job_id FROM jobs), l AS ({_LATEST})
      SELECT w.job_id, CASE WHEN l.job_id IS NULL THEN 'not_found' WHEN status IN ('pending', 'running') THEN 'not_ready' WHEN status = 'error' THEN 'error' ELSE 'done' END AS view,
        CASE WHEN l.job_id IS NULL THEN 'job not found' WHEN status = 'error' THEN coalesce(error_message, 'unknown error') END AS message,
        CASE WHEN status NOT IN ('pending', 'running', 'error') THEN json_extract_string(params, '$.k') END AS k FROM w LEFT JOIN l USING (job_id)""",
)
def job_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "jobs")
    wanted = rows.select(F.concat(F.lit("job-"), (F.col("user_id") * 2).cast("string")).alias("job_id"))
    return jobs.read(rows, wanted).select("job_id", "view", "message", F.try_variant_get("result", "$.k", "string").alias("k"))


@query("jobs_created", "SELECT 'http' AS tool, 'pending' AS status, props AS params, 36 AS id_chars, ts AS created_at FROM events WHERE event_type = 'view'")
def jobs_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.lit("http").alias("tool"), F.col("props").alias("params"), "ts")
    return jobs.create(asked, F.col("ts")).select("tool", "status", "params", F.length("job_id").alias("id_chars"), "created_at")


@query("job_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso FROM events")
def job_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.isoformat(F.col("ts")).alias("iso"))


_ASKED = "SELECT -event_id AS id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'src' || (user_id % 40) END AS repo_name, ts AS requested_at FROM events WHERE event_type = 'click'"


@query(
    "queue_enqueue",
    f"{adapters.cte('queue', 'repos')}, asked AS ({_ASKED}) SELECT id, repo_name, requested_at, processed_at FROM queue UNION ALL SELECT id, repo_name, requested_at, NULL FROM asked WHERE repo_name IS NULL OR repo_name IN (SELECT name FROM repos)",
)
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(_ASKED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return jobs.enqueue(store(spark, sf_dir, "queue"), asked, store(spark, sf_dir, "repos"))


@query(
    "session_lifecycle",
    """WITH s AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS token_hash, user_id, ts + INTERVAL 24 HOUR AS expires_at FROM events), n AS (SELECT max(ts) AS t FROM events),
      o AS (SELECT token_hash, user_id, expires_at FROM s, n WHERE expires_at > t UNION ALL SELECT sha256('new-' || event_id), user_id, t + INTERVAL 24 HOUR FROM events, n WHERE event_type = 'signup')
      SELECT token_hash, user_id, expires_at FROM o WHERE token_hash NOT IN (SELECT sha256('new-' || event_id) FROM events WHERE event_id % 2 = 0) AND user_id IN (SELECT user_id FROM events WHERE event_id % 3 = 0)""",
)
def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are opened, purged and closed; those of users that are gone go too."""
    events = table(spark, sf_dir, "events")
    sessions = events.select(F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), "user_id", F.expr("ts + INTERVAL '24' HOUR").alias("expires_at"))
    token = F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("token")
    now = F.lit(events.agg(F.max("ts")).first()[0]).cast(events.schema["ts"].dataType)
    opened = jobs.open_sessions(sessions, events.filter("event_type = 'signup'").select(token, "user_id"), now)
    closed = jobs.close_sessions(opened, events.filter("event_id % 2 = 0").select(token))
    return jobs.of_users(closed, events.filter("event_id % 3 = 0").select("user_id").distinct()).select("token_hash", "user_id", "expires_at")


_STATES = """
select concat('src', cast(user_id % 25 as varchar(10))) as repo_name, ts as at, event_id as seq,
  case event_type when 'signup' then 'pending' when 'view' then 'indexing' when 'error' then 'error' else 'indexed' end as status,
  case when event_type not in ('signup', 'view', 'error') then event_id % 500 end as total_chunks,
  case when event_type = 'error' then concat('clone failed ', cast(event_id as varchar(20))) end as error_message from events
"""


@query(
    "repo_states",
    f"""{_R}, t AS ({_STATES}), l AS (SELECT repo_name, arg_max({{'s': status, 'e': error_message}}, {{'at': t.at, 'seq': t.seq}}) AS s FROM t GROUP BY repo_name),
      i AS (SELECT repo_name, arg_max(total_chunks, {{'at': t.at, 'seq': t.seq}}) AS n, max(t.at) AS last_at FROM t WHERE status = 'indexed' GROUP BY repo_name)
      SELECT name, coalesce(l.s.s, status) AS status, coalesce(i.n, total_chunks) AS total_chunks, i.last_at AS last_indexed_at, CASE WHEN l.s.s = 'error' THEN l.s.e END AS error_message
      FROM repos LEFT JOIN l ON name = l.repo_name LEFT JOIN i ON name = i.repo_name""",
)
def repo_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.sql(_STATES.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    return catalog.apply_states(store(spark, sf_dir, "repos"), log)


@query(
    "repo_rename",
    f"""{_R} SELECT name, status, false AS orphaned FROM repos WHERE name <> 'src3' UNION ALL SELECT 'renamed', 'pending', false FROM repos WHERE name = 'src3' UNION ALL SELECT name, status, true FROM repos WHERE name = 'src3'""",
)
def repo_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new name is a new row; the old one stays behind without a configuration."""
    repos = store(spark, sf_dir, "repos")
    configured = catalog.rename(repos.select("name", "type"), "src3", "renamed")
    after = catalog.upsert(repos, configured)
    return catalog.flag(after, configured, "name").select("name", "status", (~F.col("selected")).alias("orphaned"))


@query("repo_tokens", f"{_R} SELECT name, type, CASE WHEN total_chunks % 2 = 0 THEN 'own' WHEN type = 'github' THEN 'gh' WHEN type = 'gitlab' THEN 'gl' END AS token FROM repos")
def repo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = store(spark, sf_dir, "repos").select("name", "type", F.when(F.col("total_chunks") % 2 == 0, "own").otherwise("").alias("token"))
    return catalog.with_tokens(repos, spark.createDataFrame([("github", "gh"), ("gitlab", "gl")], "type string, token string"))


_HOSTED = "id, full_name, id % 97 AS stars, id * 7919 % 10007 AS last_activity_at"


@query("remote_starred", f"{_M}, f AS (SELECT {_HOSTED} FROM remote WHERE contains(lower(full_name), '1')) SELECT id, full_name, stars, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY stars DESC, id LIMIT 30")
def remote_starred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "remote").selectExpr(*_HOSTED.split(", "))
    return catalog.starred(rows, " 1 ").select("id", "full_name", "stars", "total_count")


@query("remote_active", f"{_M} SELECT id, full_name, last_activity_at FROM (SELECT {_HOSTED} FROM remote) ORDER BY last_activity_at DESC, id LIMIT 50")
def remote_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active(store(spark, sf_dir, "remote").selectExpr(*_HOSTED.split(", "))).drop("stars")


@query("remote_project", f"{_M} SELECT id, full_name, replace(full_name, '/', '%2F') AS encoded FROM remote WHERE full_name = (SELECT min(full_name) FROM remote)")
def remote_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "remote")
    return catalog.project(rows, rows.agg(F.min("full_name")).first()[0]).select("id", "full_name", "encoded")


@query("remote_selected", f"{_M} SELECT id, full_name, full_name IN (SELECT full_name FROM remote WHERE id % 4 = 1) AS selected FROM remote")
def remote_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir, "remote").select("id", "full_name")
    return catalog.flag(rows, rows.filter("id % 4 = 1"), "full_name")


@query("index_progress", f"{_CHUNKS} SELECT repo_name, count(DISTINCT doc_id) AS files, count(*) AS chunks, CAST(ceil(count(*) / 20) AS BIGINT) AS batches FROM chunks GROUP BY repo_name")
def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.progress(_chunks(spark, sf_dir))


_EMPTY = "concat(chr(123), chr(125))"


def _json(key: str, value: str) -> str:
    return f"concat(chr(123), '\"{key}\":\"', {value}, '\"', chr(125))"


_STORED = f"SELECT user_id AS id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE {_json('model', 'min(event_type)')} END AS settings FROM events WHERE user_id % 3 < 2 GROUP BY user_id"
_PUT = f"SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN {_EMPTY} ELSE {_json('dims', 'CAST(count(*) AS varchar(20))')} END AS settings FROM events WHERE user_id % 3 > 0 GROUP BY user_id"


@query(
    "settings_put",
    f"""WITH o AS ({_STORED}), n AS ({_PUT}), b AS (SELECT id, CASE WHEN n.settings <> {_EMPTY} THEN n.settings ELSE o.settings END AS settings FROM o FULL JOIN n USING (id))
      SELECT id, unnest(json_keys(settings)) AS key, json_extract_string(settings, '$.' || unnest(json_keys(settings))) AS value FROM b WHERE settings IS NOT NULL""",
)
def settings_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request is stored as it is, an empty one falls back; read back from JSON."""
    once = settings.put(_from_events(spark, sf_dir, _STORED), _from_events(spark, sf_dir, _PUT))
    return settings.decode(settings.encode(settings.decode(once)))


_NOW = "SELECT concat('embeddings_', CASE event_type WHEN 'view' THEN 'model' WHEN 'click' THEN 'dims' ELSE event_type END) AS key, CAST(count(*) AS varchar(20)) AS value FROM events GROUP BY event_type"
_OVER = "SELECT concat('embeddings_', CASE event_type WHEN 'view' THEN 'model' WHEN 'click' THEN 'dims' ELSE event_type END) AS key, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN CAST(count(*) AS varchar(20)) ELSE CAST(count(DISTINCT user_id) AS varchar(20)) END AS value FROM events GROUP BY event_type"


@query(
    "settings_effective",
    f"""WITH m AS (SELECT c.key, coalesce(o.value, c.value) AS value, coalesce(o.value, c.value) IS DISTINCT FROM c.value AS changed FROM ({_NOW}) c LEFT JOIN ({_OVER}) o USING (key))
      SELECT *, (SELECT bool_or(changed AND key IN ('embeddings_provider', 'embeddings_model', 'embeddings_dims')) FROM m) AS requires_reindex, (SELECT bool_or(changed AND key = 'embeddings_dims') FROM m) AS requires_vector_reset FROM m""",
)
def settings_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = settings.effective(_from_events(spark, sf_dir, _NOW), _from_events(spark, sf_dir, _OVER))
    return merged.join(F.broadcast(settings.consequences(merged)))  # one row


@query("setup_modes", "SELECT event_type AS state, CASE WHEN count(*) FILTER (user_id % 10 = 1) > 0 AND count(*) FILTER (value > 400) > 0 THEN 'configured' WHEN count(*) FILTER (value > 400) > 0 THEN 'admin' ELSE 'full' END AS mode FROM events GROUP BY event_type")
def setup_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a service starts for each kind of event: with an administrator among its users, and a configuration among its values."""
    events = table(spark, sf_dir, "events")
    return settings.setup_modes(events, "event_type", F.col("user_id") % 10 == 1, F.col("value") > 400).select(F.col("event_type").alias("state"), "mode")


@query(
    "unified_search",
    f"""SELECT 'repo' AS kind, CAST(row_number() OVER (ORDER BY group_size DESC, best DESC, repo_name, rank) AS INT) AS place, repo_name || ' ' || vec_id AS key, score
        FROM (SELECT *, max(score) OVER (PARTITION BY repo_name) AS best FROM ({ORACLE["unified_groups"]}))
      UNION ALL SELECT 'memory', CAST(row_number() OVER (ORDER BY score DESC, memory_id) AS INT), memory_id, score FROM ({ORACLE["memory_search"]})
      UNION ALL SELECT 'job', CAST(row_number() OVER (ORDER BY job_id) AS INT), job_id, NULL FROM ({ORACLE["job_search"]})
      UNION ALL SELECT 'edge', CAST(row_number() OVER (ORDER BY similarity DESC, repo_a, repo_b) AS INT), repo_a || ' ' || repo_b, similarity FROM ({ORACLE["related_edges_for_results"]})""",
)
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of chunks, memories, jobs and related repositories as one result."""

    def placed(rows: DataFrame, key: list[str], score: str | None, *order: object) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))  # a bounded list: every part ends in a limit
        return rows.select(place.alias("place"), F.concat_ws(" ", *[F.col(c).cast("string") for c in key]).alias("key"), (F.col(score) if score else F.lit(None)).alias("score"))

    groups = unified_groups(spark, sf_dir).withColumn("best", F.max("score").over(Window.partitionBy("repo_name")))
    return search.unified(
        " 50 ", placed(groups, ["repo_name", "vec_id"], "score", F.desc("group_size"), F.desc("best"), "repo_name", "rank"),
        placed(memory_search(spark, sf_dir), ["memory_id"], "score", F.desc("score"), "memory_id"), placed(job_search(spark, sf_dir), ["job_id"], None, "job_id"),
        placed(related_edges_for_results(spark, sf_dir), ["repo_a", "repo_b"], "similarity", F.desc("similarity"), "repo_a", "repo_b"),
    )


from . import queries_repos, queries_streams, queries_vectors  # noqa: E402, F401  more queries register themselves
