"""The driver's tables seen as the tables of the context store; the SQL is valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column expressions by table; ``{t}`` stands for the table read.
FILES = """
select source as repo_name,
  concat(case doc_id % 9 when 0 then 'src' when 1 then 'docs/a.b' when 2 then 'dist' when 3 then '.github'
                         when 4 then 'pkg/node_modules' else lang end, '/',
         case when doc_id % 11 = 0 then '__init__' else concat('f', cast(doc_id as varchar(20))) end,
         case doc_id % 13 when 0 then '.py' when 1 then '.MD' when 2 then '.min.js' when 3 then '.ts' when 4 then '.go'
                          when 5 then '.lock' when 6 then '.tar.gz' when 7 then '' when 8 then '.' when 9 then '.java'
                          when 10 then '.env' else '.txt' end) as file_path,
  n_chars as size, lang, text as content, doc_id from documents
"""
VECTORS = "select vec_id, concat('repo', cast(label as varchar(10))) as repo_name, embedding from embeddings"
REPOS = """
select source as name,
  case when n % 3 = 0 then 'github' when n % 3 = 1 then 'gitlab' else 'local' end as type,
  case when n % 4 = 0 then 'pending' when n % 4 = 1 then 'error' else 'indexed' end as status, tc as total_chunks
from (select source, cast(substring(source, 4) as int) as n, cast(sum(n_chars % 7) as bigint) as tc
      from documents group by source) g
"""
JOBS = """
select event_id, concat('job-', cast(user_id as varchar(20))) as job_id,
  case event_type when 'view' then 'http' else 'index' end as tool,
  case event_type when 'signup' then 'pending' when 'view' then 'running' when 'error' then 'error' else 'done' end as status,
  case when event_type = 'error' then concat('HTTP ', cast(500 + event_id % 4 as varchar(20))) end as error_message,
  props as params, ts as created_at, user_id from events
"""
QUEUE = """
select event_id as id,
  case when event_id % 10 = 0 then null else concat('src', cast(user_id % 25 as varchar(10))) end as repo_name,
  ts as requested_at, case when event_type in ('click', 'view') then ts end as processed_at from events
"""
MEMORIES = """
select concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as memory_id,
  concat('u', cast(conv_id % 10 as varchar(20))) as user_id, text as memory, role from conversations
"""
REMOTE = """
select page_id as id, regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 1) as host,
  regexp_extract(url, '^https?://([^/]+)/([^?#]*)', 2) as full_name,
  case when page_id % 3 = 0 then 'public' when page_id % 3 = 1 then 'private' end as visibility from pages
"""
_FROM = {"files": (FILES, "documents"), "vectors": (VECTORS, "embeddings"), "repos": (REPOS, "documents"), "jobs": (JOBS, "events"), "queue": (QUEUE, "events"), "memories": (MEMORIES, "conversations"), "remote": (REMOTE, "pages")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the store's tables from the driver's Parquet files."""
    text, source = _FROM[name]
    return spark.sql(text.replace(f"from {source}", f"from {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def cte(*names: str) -> str:
    """The same tables as a WITH clause."""
    return "WITH " + ", ".join(f"{n} AS ({_FROM[n][0]})" for n in names)
