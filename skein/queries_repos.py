"""Queries over the life of repositories: the order of their states, schedules, versions, deletion, listings and trees."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cron, globs, text, vectors
from .operators import catalog, chunk, embed, memory, search, states
from .model import EXAMPLE_EXCLUDES, IndexSettings
from .plans import adapters, index, scratch, versions
from .queries import _CHUNKS, _F, _HOSTED, _M, _R, _STATES, _chunks, _first, query, store, table
from .sources import catalog as hosted
from .sources import listing, tree


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_STATES.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


_ORDERED = f"""t AS ({_STATES}), o AS (SELECT *, lag(status) OVER w AS before, lag(t.at) OVER w AS since, count(*) FILTER (status = 'indexing') OVER (PARTITION BY repo_name ORDER BY t.at, seq ROWS UNBOUNDED PRECEDING) AS attempt
    FROM t WINDOW w AS (PARTITION BY repo_name ORDER BY t.at, seq)),
  l AS (SELECT *, CASE coalesce(before, '') WHEN '' THEN status IN ('pending', 'indexing') WHEN 'pending' THEN status = 'indexing' WHEN 'indexing' THEN status IN ('indexed', 'error') ELSE status IN ('indexing', 'pending') END AS legal,
    (epoch_us(o.at) - epoch_us(since)) / 1000000.0::DOUBLE AS seconds FROM o)"""


@query("repo_state_steps", f"WITH {_ORDERED} SELECT repo_name, seq, status, before, legal, attempt, round(seconds, 3) AS seconds FROM l")
def repo_state_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.steps(_log(spark, sf_dir)).select("repo_name", "seq", "status", "before", "legal", "attempt", F.round("seconds", 3).alias("seconds"))


def _spent(state: str) -> str:
    return f"round(coalesce(sum(seconds) FILTER (before = '{state}'), 0) + CASE WHEN arg_max(status, {{'at': l.at, 'seq': seq}}) = '{state}' THEN (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(l.at))) / 1000000.0::DOUBLE ELSE 0 END, 3) AS {state}_seconds"


@query(
    "repo_state_review",
    f"""WITH {_ORDERED} SELECT repo_name, count(*) AS transitions, count(*) FILTER (NOT legal) AS illegal, max(attempt) AS attempts, count(*) FILTER (status = 'error') AS failures, {", ".join(map(_spent, ("pending", "indexing", "indexed", "error")))},
      arg_max(status, {{'at': l.at, 'seq': seq}}) AS status, arg_max(status, {{'at': l.at, 'seq': seq}}) = 'indexing' AND max(l.at) < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS stuck FROM l GROUP BY repo_name""",
)
def repo_state_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Illegal steps, attempts, time in each state and repositories that hang, by the log that ``repo_states`` applies."""
    log = _log(spark, sf_dir)
    now = log.agg(F.max("at")).first()[0]
    return states.review(log, F.lit(now).cast(log.schema["at"].dataType), "10 MINUTES")


#: Schedules as people write them, with the sets that the SQL takes.
_SCHEDULES = {
    "default": ("0 */6 * * *", "[0]", "[0, 6, 12, 18]", "range(1, 32)", "range(1, 13)", "range(0, 7)"),
    "office": ("*/15,59 9-17 * * mon-fri", "[0, 15, 30, 45, 59]", "range(9, 18)", "range(1, 32)", "range(1, 13)", "range(0, 5)"),
    "halves": ("30 2 1,15 * *", "[30]", "[2]", "[1, 15]", "range(1, 13)", "range(0, 7)"),
    "summer sundays": ("5 4-20/8 * JUN-aug 6", "[5]", "[4, 12, 20]", "range(1, 32)", "[6, 7, 8]", "[6]"),
    "leap": ("0 0 29 2 *", "[0]", "[0]", "[29]", "[2]", "range(0, 7)"),
    "never": ("0 0 31 2 *", "[0]", "[0]", "[31]", "[2]", "range(0, 7)"),
    "broken": ("every six hours", "[0]", "[0, 6, 12, 18]", "range(1, 32)", "range(1, 13)", "range(0, 7)"),
    "broken field": ("0 25 * * *", "[0]", "[0, 6, 12, 18]", "range(1, 32)", "range(1, 13)", "range(0, 7)"),
    "missing": (None, "[0]", "[0, 6, 12, 18]", "range(1, 32)", "range(1, 13)", "range(0, 7)"),
}
_FIRINGS = f"""WITH c(schedule, minutes, hours, days, months, weekdays) AS (VALUES {", ".join(f"('{n}', {', '.join(s[1:])})" for n, s in _SCHEDULES.items())}),
  d AS (SELECT schedule, day FROM c, (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 3000, INTERVAL 1 DAY)) AS DATE) AS day FROM events)
    WHERE list_contains(months, month(day)) AND list_contains(days, day(day)) AND list_contains(weekdays, isodow(day) - 1)),
  f AS (SELECT schedule, CAST(h * 60 + m AS BIGINT) AS slot FROM (SELECT schedule, unnest(hours) AS h, minutes FROM c), unnest(minutes) x(m)),
  e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS now, schedule FROM events, c),
  s AS (SELECT event_id, e.schedule, min(f.slot) AS slot FROM e JOIN d ON d.schedule = e.schedule AND d.day = e.day JOIN f ON f.schedule = e.schedule AND f.slot > e.now GROUP BY ALL),
  n AS (SELECT e.*, d.day AS next FROM e ASOF LEFT JOIN d ON e.schedule = d.schedule AND e.day < d.day)
  SELECT n.event_id, n.schedule, CASE WHEN s.slot IS NOT NULL THEN CAST(n.day AS TIMESTAMP) + to_minutes(s.slot) ELSE CAST(n.next AS TIMESTAMP) + to_minutes((SELECT min(slot) FROM f WHERE f.schedule = n.schedule)) END AS fires_at
  FROM n LEFT JOIN s ON n.event_id = s.event_id AND n.schedule = s.schedule"""


def _schedules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s[0]) for n, s in _SCHEDULES.items()], "schedule string, expression string")


@query("refresh_next", _FIRINGS)
def refresh_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next refresh after each event under each schedule."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return cron.next_firings(events, _schedules(spark), "ts").select("event_id", "schedule", "fires_at")


@query(
    "refresh_missed",
    f"""WITH r AS (SELECT concat('src', user_id % 25) AS repo_name, max(ts) AS ts FROM events WHERE event_type NOT IN ('signup', 'view', 'error') GROUP BY ALL), f AS ({_FIRINGS})
      SELECT repo_name, schedule, min(fires_at) AS fires_at FROM r JOIN events e ON e.ts = r.ts AND concat('src', e.user_id % 25) = repo_name JOIN f ON f.event_id = e.event_id
      WHERE fires_at <= (SELECT max(ts) FROM events) + INTERVAL 6 HOUR GROUP BY ALL""",
)
def refresh_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories whose last indexing lies before a firing that is past, six hours after the last event."""
    log = _log(spark, sf_dir).filter("status = 'indexed'").groupBy("repo_name").agg(F.max("at").alias("ts"))
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.expr("max(ts) + INTERVAL '6' HOUR")).first()[0]).cast(events.schema["ts"].dataType)
    return cron.missed(log, _schedules(spark), now, "ts").select("repo_name", "schedule", "fires_at")


# --- versions and deletion -------------------------------------------------------------------------------------------


def _digests(rows: DataFrame, mark: str) -> DataFrame:
    return rows.select("repo_name", "doc_id", "chunk_index", F.md5(F.concat(F.lit(mark), "chunk")).alias("digest"))


@query(
    "index_versions",
    f"""{_CHUNKS}, n AS (SELECT *, CAST(substring(repo_name, 4) AS INT) AS k FROM chunks)
      SELECT repo_name, doc_id, chunk_index, md5(CASE WHEN k % 4 = 0 THEN '2' ELSE '1' END || chunk) AS digest FROM n WHERE k % 4 <> 1 AND (k % 4 <> 0 OR doc_id % 3 <> 0)""",
)
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repositories are indexed; a fourth is indexed again with fewer files, a fourth is emptied, and for a fourth the writer fails before its commit."""
    held, rows = versions.VersionedStore(spark, f"{scratch.folder(spark)}/store"), _chunks(spark, sf_dir)
    kind = F.substring("repo_name", 4, 9).cast("int") % 4
    held.replace(_digests(rows, "1"), "chunks", "repo_name")
    held.write(_digests(rows.filter(kind == 2), "lost"), "chunks", "repo_name")
    again = _digests(rows.filter((kind == 0) & (F.col("doc_id") % 3 != 0)), "2")
    held.replace(again, "chunks", "repo_name", rows.filter(kind.isin(0, 1)).select(F.col("repo_name").alias("part")).distinct())
    return held.read("chunks")


_GONE = "SELECT DISTINCT source AS name FROM documents WHERE doc_id % 7 = 0 AND lang = 'de' AND CAST(substring(source, 4) AS INT) % 2 = 1"


@query(
    "repos_cascade",
    f"""{adapters.cte("queue", "repos")}, gone AS ({_GONE}), c AS ({_CHUNKS} SELECT * FROM chunks)
      SELECT 'chunks' AS held, repo_name AS name, count(*) AS n FROM c WHERE repo_name NOT IN (SELECT name FROM gone) GROUP BY ALL
      UNION ALL SELECT 'repos', name, count(*) FROM repos WHERE name NOT IN (SELECT name FROM gone) GROUP BY ALL
      UNION ALL SELECT 'config', name, count(*) FROM repos WHERE type <> 'local' AND name NOT IN (SELECT name FROM gone) GROUP BY ALL
      UNION ALL SELECT 'queue', coalesce(repo_name, 'all'), count(*) FROM queue WHERE repo_name IS NULL OR repo_name NOT IN (SELECT name FROM gone) GROUP BY ALL""",
)
def repos_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of repositories is deleted from chunks, catalogue, configuration and queue, twice, as after a crash."""
    held = versions.VersionedStore(spark, f"{scratch.folder(spark)}/store")
    repos = store(spark, sf_dir, "repos")
    held.replace(_digests(_chunks(spark, sf_dir), ""), "chunks", "repo_name")
    held.replace(repos, "repos")
    held.replace(repos.filter("type <> 'local'").select("name", "type"), "config")
    held.replace(store(spark, sf_dir, "queue"), "queue")
    gone = spark.sql(_GONE.replace("FROM documents", "FROM {documents}").replace("AS INT", "AS int"), documents=table(spark, sf_dir, "documents"))
    for _ in range(2):
        versions.delete_repos(held, gone)

    def counted(name: str, key: str) -> DataFrame:
        return held.read(name).groupBy(F.coalesce(key, F.lit("all")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("held"), "name", "n")

    return counted("chunks", "repo_name").union(counted("repos", "name")).union(counted("config", "name")).union(counted("queue", "repo_name"))


# --- listings and trees ----------------------------------------------------------------------------------------------

#: Two hosts, which the listings of the given pages are dealt to.
_HOSTS = "CASE WHEN id % 3 = 0 THEN 'github' ELSE 'gitlab' END AS host"


def _listing(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    path = f"{scratch.folder(spark)}/listing"
    listing.save_pages(store(spark, sf_dir, "remote").selectExpr(*_HOSTED.split(", "), "visibility", _HOSTS), path)
    return listing.read(spark, path, **options)


@query("listing_pages", f"{_M} SELECT {_HOSTS}, id, full_name, visibility, last_activity_at, (last_activity_at // 500) * 500 || '-' || (last_activity_at // 500) * 500 + 499 AS page FROM (SELECT {_HOSTED}, visibility FROM remote)")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of both hosts, a task for each."""
    return _listing(spark, sf_dir)


@query("listing_recent", f"{_M} SELECT id, full_name, last_activity_at FROM (SELECT {_HOSTED} FROM remote) WHERE id % 3 > 0 AND last_activity_at >= 9200 ORDER BY last_activity_at DESC, id LIMIT 50")
def listing_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host's newest repositories: pages of the other host and older pages are not fetched."""
    found = _listing(spark, sf_dir, pushdown="true").filter("host = 'gitlab' and last_activity_at >= 9200")
    return found.orderBy(F.desc("last_activity_at"), "id").limit(50).select("id", "full_name", "last_activity_at")


_TREE = "SELECT source AS repo_name, doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''"


def _written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a tree that tasks write: a folder for each source, in it one for each document with one text file."""
    root = f"{scratch.folder(spark)}/tree"
    os.makedirs(root)
    rows = spark.sql(_TREE.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    tree.save(rows, root, ("repo_name", "doc_id"), "text")
    return root


_LINES = r"regexp_replace(text || chr(10), '\r\n?', chr(10), 'g')"
_READ = f"WITH t AS ({_TREE}), f AS (SELECT 'tree' AS repo_name, repo_name AS folder, doc_id, md5({_LINES}) AS digest, strlen(text) + 1 AS size FROM t WHERE strlen(text) < 512000)"


def _files(rows: DataFrame) -> DataFrame:
    part = lambda name: tree.saved_value(F.col("file_path"), name)
    return rows.select("repo_name", part("repo_name").alias("folder"), part("doc_id").cast("long").alias("doc_id"), F.md5("content").alias("digest"), "size")


@query("tree_documents", f"{_READ} SELECT * FROM f")
def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from the tree, a task for each source's folder."""
    tree.register(spark)
    return _files(spark.read.format("repo_tree").option("repo", "tree").load(_written_tree(spark, sf_dir)))


@query("tree_documents_small", f"{_READ} SELECT * FROM f WHERE folder = 'src3' AND size <= 1500")
def tree_documents_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files of one folder: other folders are not entered, larger files not opened."""
    tree.register(spark)
    rows = spark.read.format("repo_tree").option("repo", "tree").option("pushdown", "true").load(_written_tree(spark, sf_dir))
    return _files(rows.filter(F.col("file_path").startswith("repo_name=src3/") & (F.col("size") <= 1500)))


_WANTED = "SELECT CASE WHEN doc_id % 5 = 0 THEN 'no' || repo_name ELSE repo_name END AS repo, CASE WHEN doc_id % 3 = 0 THEN '/' || file_path WHEN doc_id % 3 = 1 THEN file_path ELSE 'gone/' || file_path END AS path FROM files WHERE doc_id % 2 = 0"


@query(
    "get_files",
    f"""{_F}, w AS (SELECT DISTINCT *, ltrim(path, '/') AS p FROM ({_WANTED})), k AS (SELECT DISTINCT repo_name FROM files)
      SELECT w.repo, w.path, CASE WHEN k.repo_name IS NULL OR f.doc_id IS NULL THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN k.repo_name IS NULL THEN 'Repository ''' || w.repo || ''' not found in runtime settings' WHEN f.doc_id IS NULL THEN 'File not found: ' || w.path END AS error,
        CASE WHEN k.repo_name IS NOT NULL THEN md5(f.content) END AS digest, coalesce(CASE WHEN k.repo_name IS NOT NULL THEN f.size END, 0) AS size_bytes
      FROM w LEFT JOIN k ON w.repo = k.repo_name LEFT JOIN files f ON f.repo_name = k.repo_name AND f.file_path = w.p""",
)
def get_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single files: found, missing, and of repositories that nobody knows."""
    files = store(spark, sf_dir, "files")
    wanted = spark.sql(_WANTED.replace("FROM files", "FROM {files}"), files=files)
    found = tree.lookup(files, files.select(F.col("repo_name").alias("name")), wanted)
    return found.select("repo", "path", "status", "error", F.md5("content").alias("digest"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"))


@query("tree_scan", f"{_READ} SELECT * FROM f WHERE folder NOT IN ('src1', 'src5') AND doc_id NOT BETWEEN 10 AND 19")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree without two sources and without ten documents: what is excluded is not entered."""
    tree.register(spark)
    excludes = "**/repo_name=src1/**\nrepo_name=src5\n**/doc_id=1[0-9]/**"
    return _files(spark.read.format("repo_tree").option("repo", "tree").option("excludes", excludes).load(_written_tree(spark, sf_dir)))


_WHOLE_FILES = "WITH files AS (SELECT 'one' AS repo_name, source, doc_id, '' AS file_path, text || chr(10) AS content FROM documents WHERE text <> '' AND strlen(text) < 512000 UNION ALL SELECT 'two', source, doc_id, '', text || chr(10) FROM documents WHERE text <> '' AND strlen(text) < 512000)"


@query(
    "index_replace",
    f"""{_CHUNKS.replace(adapters.cte("files"), _WHOLE_FILES.replace("text || chr(10)", _LINES)).replace("PARTITION BY doc_id", "PARTITION BY repo_name, doc_id")}
      SELECT c.repo_name, c.doc_id, chunk_index, md5(chunk) AS digest FROM chunks c JOIN documents d USING (doc_id) WHERE c.repo_name = 'two' OR d.source <> 'src2'""",
)
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree is indexed as two repositories; one loses a folder and is indexed again, the other stays as it was."""
    out, root = f"{scratch.folder(spark)}/chunks", _written_tree(spark, sf_dir)
    for repo, excludes in (("one", ()), ("two", ()), ("one", ("repo_name=src2",))):
        states_ = index.index_repo(spark, root, repo, out, settings=IndexSettings(excludes=excludes)).collect()
        if states_[-1]["status"] != "indexed":
            raise RuntimeError(states_[-1]["error_message"])
    rows = spark.read.parquet(out)
    return rows.select("repo_name", tree.saved_value(F.col("file_path"), "doc_id").cast("long").alias("doc_id"), "chunk_index", F.md5("content").alias("digest"))


# --- small operators over the given tables ---------------------------------------------------------------------------


@query("local_paths", f"{_R} SELECT name, CASE WHEN type = 'local' THEN coalesce(nullif(CASE WHEN total_chunks % 2 = 0 THEN '/own/' || name ELSE '' END, ''), '/repos/' || name) ELSE '/cache/' || name END AS path FROM repos")
def local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = store(spark, sf_dir, "repos")
    own = F.when(F.col("total_chunks") % 2 == 0, F.concat(F.lit("/own/"), "name")).otherwise("")
    return repos.select("name", catalog.local_path(F.col("type"), own, F.col("name")).alias("path"))


#: What a host's listing says of the given pages; much is left out, as hosts do.
_GITHUB = "id, full_name, CASE WHEN id % 4 = 0 THEN 'dev' END AS default_branch, CASE WHEN id % 3 = 0 THEN true END AS private, CASE WHEN id % 2 = 0 THEN CAST(id % 97 AS INT) END AS stargazers_count, 'T' || id AS updated_at"
_GITLAB = "id, CASE WHEN id % 2 = 0 THEN full_name ELSE '' END AS path_with_namespace, 'n' || id AS name, CASE WHEN id % 3 = 0 THEN 'public' WHEN id % 3 = 1 THEN 'internal' END AS visibility, CASE WHEN id % 5 = 0 THEN 'x/y' ELSE '' END AS forked_from_project"


def _hosted_json(spark: SparkSession, sf_dir: str, columns: str) -> str:
    path = f"{scratch.folder(spark)}/hosted"
    spark.sql(f"SELECT {columns} FROM {{remote}}", remote=store(spark, sf_dir, "remote")).write.json(path)
    return path


@query("listing_github", f"{_M} SELECT id, full_name, coalesce(default_branch, 'main') AS default_branch, coalesce(private, false) AS private, coalesce(stargazers_count, 0) AS stars, false AS fork FROM (SELECT {_GITHUB} FROM remote)")
def listing_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved listing with its gaps filled."""
    return hosted.github(spark, _hosted_json(spark, sf_dir, _GITHUB)).select("id", "full_name", "default_branch", "private", "stars", "fork")


@query("listing_gitlab", f"{_M} SELECT id, coalesce(nullif(path_with_namespace, ''), name) AS full_name, coalesce(visibility, 'private') <> 'public' AS private, forked_from_project <> '' AS fork FROM (SELECT {_GITLAB} FROM remote)")
def listing_gitlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosted.gitlab(spark, _hosted_json(spark, sf_dir, _GITLAB)).select("id", "full_name", "private", "fork")


@query("vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: printf('%.10f', x)), ',') || ']' AS literal FROM embeddings")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.to_text(F.col("embedding")).alias("literal"))


_TOKEN = "CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN concat('t$', CAST(page_id AS varchar(20))) END"


@query("token_urls", f"SELECT page_id, CASE WHEN coalesce({_TOKEN}, '') = '' THEN url ELSE regexp_replace(url, '^(https?://)([^/@]*@)?', '\\1oauth2:' || {_TOKEN} || '@') END AS url FROM pages")
def token_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT page_id, url, {_TOKEN} AS token FROM {{pages}}", pages=table(spark, sf_dir, "pages"))
    return rows.select("page_id", text.inject_token(F.col("url"), F.col("token")).alias("url"))


@query("text_lines", "SELECT doc_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that are typed one a line, here the lines of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return found.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


_TOOL = "concat(CASE event_type WHEN 'view' THEN 'repo_' WHEN 'click' THEN 'memory_' WHEN 'error' THEN 'job_' ELSE 'my_job_' END, CAST(event_id % 7 AS varchar(20)))"


@query("tool_groups", f"SELECT g, count(*) AS n, count(DISTINCT tool) AS tools FROM (SELECT {_TOOL} AS tool, CASE event_type WHEN 'view' THEN 'repo' WHEN 'click' THEN 'memory' WHEN 'error' THEN 'job' ELSE 'other' END AS g FROM events) GROUP BY g")
def tool_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT {_TOOL} AS tool FROM {{events}}", events=table(spark, sf_dir, "events"))
    return rows.groupBy(text.tool_group(F.col("tool")).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tool").alias("tools"))


@query(
    "memory_changes",
    f"""{adapters.cte("memories")} SELECT memory_id, user_id, memory FROM (SELECT memory_id, user_id, memory FROM memories UNION ALL SELECT 'new-' || memory_id, CASE WHEN role = 'user' THEN user_id ELSE 'default' END, concat('+ ', memory) FROM memories WHERE role IN ('user', 'assistant'))
      WHERE memory_id <> '3-1'""",
)
def memory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories are added, those without a user to the default one, and one is deleted."""
    rows = store(spark, sf_dir, "memories").select("memory_id", "user_id", "memory", "role")
    new = rows.filter("role in ('user', 'assistant')").select(F.concat(F.lit("new-"), "memory_id").alias("memory_id"), F.when(F.col("role") == "user", F.col("user_id")).alias("user_id"), F.concat(F.lit("+ "), "memory").alias("memory"))
    return memory.remove(memory.add(rows.drop("role"), new), "3-1")


@query("glob_exclude_example", f"{_F} SELECT doc_id, regexp_matches(path, '[.](class|jar|war|iml|map|pyc|lock)$|[.]min[.]js$|(^|/)(target|build|dist|node_modules|[.]idea|[.]git)/|(^|/)[.](project|classpath)$') AS excluded FROM (SELECT doc_id, {{path}} AS path FROM files)".replace("{path}", "CASE doc_id % 5 WHEN 0 THEN 'target/a.txt' WHEN 1 THEN 'src/A.class' WHEN 2 THEN 'src/.project' WHEN 3 THEN 'targets/a.txt' ELSE file_path END"))
def glob_exclude_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusions of the example, for Java and Angular as well."""
    path = F.expr("CASE doc_id % 5 WHEN 0 THEN 'target/a.txt' WHEN 1 THEN 'src/A.class' WHEN 2 THEN 'src/.project' WHEN 3 THEN 'targets/a.txt' ELSE file_path END")
    return store(spark, sf_dir, "files").select("doc_id", globs.excluded(path, EXAMPLE_EXCLUDES).alias("excluded"))


@query(
    "search_results",
    f"""{_CHUNKS}, t AS (SELECT doc_id, chunk_index, repo_name, file_path, start, chunk, doc_id * 1000 + chunk_index AS id FROM chunks),
      ws AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(chunk), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS word FROM t),
      c AS (SELECT id, CAST('0x' || md5(word)[1:2] AS INT) % 16 AS place, count(*) AS n FROM ws GROUP BY ALL), v AS (SELECT id, sum(n * n)::DOUBLE AS nn FROM c GROUP BY id),
      d AS (SELECT a.id, sum(a.n * q.n)::DOUBLE AS dot FROM c a JOIN c q ON a.place = q.place WHERE q.id = 3000 GROUP BY a.id)
      SELECT repo_name, file_path, md5(chunk) AS digest, start AS start_line, round(coalesce(dot, 0) / sqrt(nn * (SELECT nn FROM v WHERE id = 3000)), 4) AS score FROM t LEFT JOIN v USING (id) LEFT JOIN d USING (id)
      ORDER BY coalesce(dot, 0) / sqrt(nn * (SELECT nn FROM v WHERE id = 3000)) DESC NULLS LAST, id LIMIT 10""",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks nearest to a chunk, with their content and decoded metadata."""
    rows = _chunks(spark, sf_dir).withColumn("id", F.col("doc_id") * 1000 + F.col("chunk_index")).withColumn("metadata", chunk.metadata(F.lit(None).cast("string"), F.col("start")))
    found = rows.select("id", "repo_name", "file_path", F.col("chunk").alias("content"), "metadata").join(embed.hashed_columns(rows, "id", "chunk"), "id")
    best = search.decoded(search.top_k(found, _first(found.filter("id = 3000"), "embedding"), 10, keys=("id",)))
    return best.select("repo_name", "file_path", F.md5("content").alias("digest"), F.try_variant_get("metadata", "$.start_line", "int").alias("start_line"), "score")
