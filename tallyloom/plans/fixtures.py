"""The model's tables and request batches, derived from the shared test tables.

Each statement runs unchanged in Spark SQL and in DuckDB, over whole tables. ``{name}`` is a test
table or an earlier statement. Ids are zero-padded to twelve digits, so that none contains another.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

USERS = """
select 'u' || lpad(cast(c_custkey as string), 12, '0') as id,
  case when c_custkey % 97 = 0 then 'shared@example.com' when c_custkey % 50 = 7 then 'no-at-sign'
       else lower(replace(c_name, '#', '.')) || '@example.com' end as email,
  c_name as full_name,
  case when c_custkey % 3 <> 0 then 'https://img.example.com/' || cast(c_custkey as string) end as avatar_url,
  'g' || cast(c_custkey as string) as google_id,
  c_acctbal >= 0 as is_active,
  (select min(o_orderdate) from {orders}) as created_at,
  (select min(o_orderdate) from {orders}) as updated_at
from {customer}
"""

PROJECTS = """
select 'p' || lpad(cast(o_orderkey as string), 12, '0') as id,
  'u' || lpad(cast(o_custkey as string), 12, '0') as user_id,
  'project-' || cast(o_orderkey as string) as name,
  case when o_orderkey % 4 = 0 then 'about ' || cast(o_orderkey as string) end as description,
  case o_orderpriority when '1-URGENT' then 'full_pipeline' when '2-HIGH' then 'dataset_and_fine_tune'
       when '3-MEDIUM' then 'fine_tune' when '4-NOT SPECIFIED' then 'dataset_generation'
       else 'batch_inference' end as execution_type,
  case o_orderstatus when 'O' then 'created' when 'P' then 'processing' else 'completed' end as status,
  case when o_orderkey % 43 <> 0 then 0 end as num_files,
  '{{' || concat_ws(',', case when o_orderkey % 2 = 0 then '"gen_model":"g1"' end,
       case when o_orderkey % 3 <> 0 then '"min_samples":' || cast(o_orderkey % 100 as string) end,
       case when o_orderkey % 5 <> 0 then '"base_model":null' end,
       case when o_orderkey % 7 <> 0 then '"deploy_instance_type":"m5"' end) || '}}' as metadata,
  '{{}}' as pipeline_status,
  cast(null as string) as error_message,
  case when o_orderkey % 41 <> 0 then o_orderdate end as created_at,
  case when o_orderkey % 41 <> 0 then o_orderdate end as updated_at
from {orders}
"""

FILES = """
select 'f' || substring(md5(cast(l_orderkey as string) || '/' || cast(l_linenumber as string) || '/'
    || cast(l_partkey as string) || '/' || cast(l_suppkey as string)), 1, 16) as id,
  'p' || lpad(cast(l_orderkey + case when l_partkey % 101 = 0 then 900000000000 else 0 end as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey as string), 12, '0') || '/projects/' || 'p' || lpad(cast(l_orderkey as string), 12, '0') || '/'
    || case l_returnflag when 'R' then 'Data' when 'A' then 'Output' else 'Chunks' end
    || '/part-' || cast(l_linenumber as string) || '.txt' as r2_key,
  'part-' || cast(l_linenumber as string) || '.txt' as filename,
  case l_returnflag when 'R' then 'Data' when 'A' then 'Output' else 'Chunks' end as folder,
  cast(floor(l_extendedprice) as bigint) as file_size,
  case when l_linestatus = 'O' then 'text/plain' end as content_type,
  l_shipdate as created_at
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

# A store holds one object per key.
OBJECTS = """
select r2_key as key, max(file_size) as size, max(created_at) as last_modified from {files} group by r2_key
"""

# The objects, and some in nested folders, the folders' markers and keys that repeat their prefix.
NESTED_OBJECTS = """
select key, size, last_modified from {objects}
union all
select case size % 4 when 0 then regexp_replace(key, '/[^/]*$', '/a/b/deep.txt') when 1 then regexp_replace(key, '/[^/]*$', '/')
       when 2 then regexp_replace(key, '/[^/]*$', '/') || key else regexp_replace(key, '/[^/]*/[^/]*$', '/loose.txt') end as key,
  max(size) as size, max(last_modified) as last_modified
from {objects} where size % 3 = 0 group by 1
"""

RESULTS = """
select event_id, 'p' || lpad(cast(user_id as string), 12, '0') as project_id,
  case event_id % 6 when 0 then 'validate_data' when 1 then 'ocr_extraction' when 2 then 'chunk_data'
       when 3 then 'generate_dataset' when 4 then 'fine_tune' else 'deploy_model' end as step,
  case when event_type = 'error' then 'failure' else 'success' end as status, ts
from {events}
"""

# No subject behind errors; every tenth subject does not exist.
CLAIMS = """
select event_id, case when event_type = 'error' then null
       else 'u' || lpad(cast(user_id + case when event_id % 10 = 0 then 900000000000 else 0 end as string), 12, '0')
       end as sub,
  case event_type when 'signup' then 'refresh' else 'access' end as token_type,
  event_id % 90 > 60 as expired, event_id % 2 = 0 as is_refresh
from {events}
"""

TOKENS = """
select event_id, case event_type when 'signup' then 'refresh' else 'access' end as token_type, ts as issued_at
from {events}
"""

# One request per project: one in eleven is made by somebody else, one in thirteen names no project.
PROJECT_REQUESTS = """
select o_orderkey as seq,
  'p' || lpad(cast(o_orderkey + case when o_orderkey % 13 = 0 then 900000000000 else 0 end as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey + case when o_orderkey % 11 = 0 then 1 else 0 end as string), 12, '0') as user_id
from {orders}
"""

# Each project's folders: one in seven requests leaves the folder out.
FOLDER_REQUESTS = """
select seq, project_id, user_id,
  case when seq % 7 = 0 then null when seq % 3 = 0 then 'Output' else 'Data' end as folder
from {project_requests}
"""

# Uploads of each file by the owner, a neighbour or to a project that does not exist.
UPLOADS = """
select l_orderkey as seq,
  'p' || lpad(cast(l_orderkey + case when l_partkey % 101 = 0 then 900000000000 else 0 end as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey + case when l_partkey % 17 = 0 then 1 else 0 end as string), 12, '0') as user_id,
  'Data' as folder, 'part-' || cast(l_linenumber as string) || '.txt' as filename
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

# Owners ask to delete their finished projects; for the others somebody else asks. Then all ask again.
DELETE_REQUESTS = """
select o_orderkey as seq, 'p' || lpad(cast(o_orderkey as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey + case when o_orderstatus = 'F' then 0 else 1 end as string), 12, '0') as user_id
from {orders}
union all
select 1000000000000 + o_orderkey as seq, 'p' || lpad(cast(o_orderkey as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey + case when o_orderstatus = 'F' then 0 else 1 end as string), 12, '0') as user_id
from {orders}
"""

# Users seen in the events; those behind errors do not exist.
USER_REQUESTS = """
select event_id as seq,
  'u' || lpad(cast(user_id + case when event_type = 'error' then 900000000000 else 0 end as string), 12, '0') as user_id
from {events}
"""

EMAIL_REQUESTS = """
select c_custkey as seq,
  case when c_custkey % 97 = 0 then 'shared@example.com' when c_custkey % 3 = 0 then c_name || '@example.com'
       else lower(replace(c_name, '#', '.')) || '@example.com' end as email
from {customer}
"""

# Downloads of each file by the owner; some keys belong to the neighbour's project or user.
DOWNLOADS = """
select o_orderkey as seq,
  'p' || lpad(cast(l_orderkey + case when l_partkey % 101 = 0 then 900000000000 else 0 end as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey + case when l_partkey % 17 = 0 then 1 else 0 end as string), 12, '0') as user_id,
  'u' || lpad(cast(o_custkey + case when l_suppkey % 5 = 0 then 1 else 0 end as string), 12, '0') || '/projects/p'
    || lpad(cast(l_orderkey + case when l_suppkey % 7 = 0 then 1 else 0 end as string), 12, '0')
    || '/Data/part-' || cast(l_linenumber as string) || '.txt' as r2_key
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

# The projects again as new ones, every ninth without metadata, every nineteenth without a name and
# every seventeenth with one that is too long.
CREATE_REQUESTS = """
select o_orderkey as seq, 'n' || substring(id, 2) as id, user_id,
  case when o_orderkey % 17 = 0 then repeat(name, 30) when o_orderkey % 19 <> 0 then name end as name,
  description, execution_type,
  case when o_orderkey % 27 = 0 then ' null ' when o_orderkey % 9 <> 0 then metadata end as metadata
from (select *, cast(substring(id, 2) as bigint) as o_orderkey from {projects}) p
"""

# Projects as they came in, with NULL and overlong names.
RAW_PROJECTS = """
select id, user_id, repeat(name, cast(1 + seq % 22 as int)) as name, execution_type,
  case when seq % 6 <> 0 then repeat('s', cast(40 + seq % 15 as int)) end as status from {create_requests}
"""

# Known users (some with a new name, without avatar or with a neighbour's email), the same users
# again with every fourth changed, and new users in pairs that share an email; some are incomplete.
PROFILES = """
select c_custkey as seq, 'g' || cast(c_custkey as string) as sub,
  case when c_custkey % 19 = 0 then '' when c_custkey % 97 = 0 then 'shared@example.com'
       when c_custkey % 50 = 7 then 'no-at-sign'
       when c_custkey % 23 = 0 then 'customer.' || lpad(cast(c_custkey + 1 as string), 9, '0') || '@example.com'
       else lower(replace(c_name, '#', '.')) || '@example.com' end as email,
  case when c_custkey % 31 = 0 then repeat(c_name, 20) when c_custkey % 2 = 0 then 'new ' || c_name else c_name end as name,
  case when c_custkey % 3 <> 0 and c_custkey % 7 <> 0 then 'https://img.example.com/' || cast(c_custkey as string) end as picture,
  cast(null as string) as new_id
from {customer}
union all
select 1000000000000 + c_custkey as seq, 'g' || cast(c_custkey as string) as sub,
  case when c_custkey % 97 = 0 then 'shared@example.com' when c_custkey % 50 = 7 then 'no-at-sign'
       else lower(replace(c_name, '#', '.')) || '@example.com' end as email,
  case when c_custkey % 4 <> 1 then c_name when c_custkey % 8 = 1 then 'again ' || c_name end as name,
  case when c_custkey % 3 <> 0 then 'https://img.example.com/' || cast(c_custkey as string) end as picture,
  cast(null as string) as new_id
from {customer}
union all
select 2000000000000 + c_custkey as seq, case when c_custkey % 29 <> 0 then 'x' || cast(c_custkey as string) end as sub,
  'new.' || cast(c_custkey - c_custkey % 2 as string) || '@example.com' as email, c_name as name,
  cast(null as string) as picture, 'x' || lpad(cast(c_custkey as string), 12, '0') as new_id
from {customer}
union all
-- New accounts whose second email is brought by another one in between.
select 3000000000000 + c_custkey as seq, 'y' || cast(c_custkey as string) as sub,
  'own.' || cast(c_custkey as string) || '@example.com' as email, c_name as name, cast(null as string) as picture,
  'y' || lpad(cast(c_custkey as string), 12, '0') as new_id
from {customer} where c_custkey % 3 = 0
union all
select 4000000000000 + c_custkey as seq, 'z' || cast(c_custkey as string) as sub,
  'both.' || cast(c_custkey as string) || '@example.com' as email, c_name as name, cast(null as string) as picture,
  'z' || lpad(cast(c_custkey as string), 12, '0') as new_id
from {customer} where c_custkey % 6 = 0
union all
select 5000000000000 + c_custkey as seq, 'y' || cast(c_custkey as string) as sub,
  'both.' || cast(c_custkey as string) || '@example.com' as email, c_name as name, cast(null as string) as picture,
  'y' || lpad(cast(c_custkey as string), 12, '0') as new_id
from {customer} where c_custkey % 3 = 0
"""

# One patch per project (one in eleven by somebody else, one in five with a wrong type or metadata as stored), then a second one for each.
PATCHES = """
select o_orderkey as seq, 'p' || lpad(cast(o_orderkey as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey + case when o_orderkey % 11 = 0 then 1 else 0 end as string), 12, '0') as user_id,
  case o_orderkey % 9
    when 0 then '{{"name":"renamed-' || cast(o_orderkey as string) || '"}}'
    when 1 then '{{"execution_type":"full_pipeline"}}'
    when 2 then '{{"metadata_":null}}'
    when 3 then '{{"status":"' || repeat('s', cast(40 + o_orderkey % 25 as int)) || '"}}'
    when 4 then '{{"metadata_":{{"gen_model":null,"min_samples":5,"base_model":"b"}},"status":"any text"}}'
    when 5 then '{{"name":null}}'
    when 6 then '{{"description":null}}'
    when 7 then '{{"execution_type":"fine_tune","metadata_":{{"base_model":1}},"description":"tuned"}}'
    else '{{"execution_type":"no_such_type","metadata_":null}}' end as patch
from {orders} where o_orderkey % 5 <> 0
union all
-- Wrong types, and the stored metadata written in another way.
select o_orderkey as seq, id as project_id, user_id,
  case o_orderkey / 5 % 8
    when 0 then '{{"name":5}}' when 1 then '{{"name":{{"a":1}}}}' when 2 then '{{"status":true}}'
    when 3 then '{{"description":[1,2]}}' when 4 then '{{"metadata_":"{{}}"}}' when 5 then '{{"metadata_":[1]}}'
    when 6 then '{{"execution_type":1.5,"name":"ok"}}'
    else '{{"metadata_":' || replace(replace(metadata, ':', ' : '), ',', ' , ') || '}}' end as patch
from (select *, cast(substring(id, 2) as bigint) as o_orderkey from {projects}) p where o_orderkey % 5 = 0
union all
select 1000000000000 + o_orderkey as seq, 'p' || lpad(cast(o_orderkey as string), 12, '0') as project_id,
  'u' || lpad(cast(o_custkey as string), 12, '0') as user_id, '{{"status":"second"}}' as patch
from {orders}
"""

# Two patches per user; every seventh is for an unknown user.
USER_PATCHES = """
select c_custkey as seq,
  'u' || lpad(cast(c_custkey + case when c_custkey % 7 = 0 then 900000000000 else 0 end as string), 12, '0') as user_id,
  case c_custkey % 6 when 0 then '{{}}' when 4 then '{{"full_name":"' || repeat(c_name, 20) || '"}}' when 1 then '{{"full_name":null}}'
    when 2 then '{{"full_name":"' || c_name || '"}}' when 3 then '{{"full_name":[1]}}'
    else '{{"full_name":"renamed ' || c_name || '"}}' end as patch
from {customer}
union all
select 1000000000000 + c_custkey as seq, 'u' || lpad(cast(c_custkey as string), 12, '0') as user_id,
  '{{"full_name":"second"}}' as patch
from {customer}
"""

# Documents as submitted: rows that repeat an id (too short, the same again, another text), that lack one, or that have
# the text of a document with a smaller id.
RAW_DOCUMENTS = """
select doc_id, text, lang, source, n_chars from {documents}
union all
select doc_id, 'short' as text, lang, source, cast(5 as bigint) as n_chars from {documents} where doc_id % 7 = 0
union all
select doc_id, text, lang, source, n_chars from {documents} where doc_id % 13 = 0
union all
select doc_id, text || ' again' as text, lang, source, n_chars + 6 as n_chars from {documents} where doc_id % 19 = 0
union all
select cast(null as bigint) as doc_id, text || ' unnamed' as text, lang, source, n_chars + 8 as n_chars
from {documents} where doc_id % 11 = 0
union all
select 1000000000000 + doc_id as doc_id, text, lang, source, n_chars from {documents} where doc_id % 17 = 0
"""

# Conversations as logged: turns without number, with negative ones, and repeated ones.
RAW_TURNS = """
select conv_id, turn, role, text from {conversations}
union all
select conv_id, cast(null as bigint) as turn, role, text from {conversations} where turn < 3 and conv_id % 3 = 0
union all
select conv_id, turn - 4 as turn, role, text || ' (before)' as text from {conversations} where conv_id % 4 = 1
union all
select conv_id, turn, role, text from {conversations} where conv_id % 5 < 2
union all
select conv_id, cast(1 as bigint) as turn, cast(null as string) as role, text || ' (once more)' as text
from {conversations} where conv_id % 6 = 0
"""

# Pages with what the crawled ones lack: references of every kind, raw elements with odd end tags or none, quoted
# angle brackets, comments in odd shapes, titles in comments.
RAW_PAGES = """
select page_id, html from {pages}
union all
select 1000000000000 + page_id as page_id, '<!-- <title>no</title> --><TITLE lang="de">F&uuml;r &#8222;' || cast(page_id as string)
  || '&#x201C;</TITLE >caf&#233; &eacute;&Eacute; &#X41;&#146; &NotEqualTilde; &bogus; &amp;lt; &#0; &#55296; &copy 1 < 2' as html
from {pages} where page_id % 3 = 0
union all
select 2000000000000 + page_id as page_id, '<script>var a = "<b>&amp;</scripts>";</script x>one<style>p {{}}</style
 y><i title="a>b" alt=''<''>two</i><!--> three <!-- four --!> five</p><br/>' || html as html
from {pages} where page_id % 3 = 1
union all
select 3000000000000 + page_id as page_id, '<p>shown</p><!doctype x><?php y ?>' || case when page_id % 2 = 0 then '<script>' else '<!-- ' end || html as html
from {pages} where page_id % 3 = 2
"""

STATEMENTS = {
    "raw_pages": RAW_PAGES,
    "raw_documents": RAW_DOCUMENTS, "raw_turns": RAW_TURNS,
    "users": USERS, "projects": PROJECTS, "files": FILES, "objects": OBJECTS, "nested_objects": NESTED_OBJECTS, "results": RESULTS,
    "claims": CLAIMS, "tokens": TOKENS, "project_requests": PROJECT_REQUESTS,
    "folder_requests": FOLDER_REQUESTS, "uploads": UPLOADS,
    "delete_requests": DELETE_REQUESTS, "user_requests": USER_REQUESTS, "email_requests": EMAIL_REQUESTS,
    "downloads": DOWNLOADS, "create_requests": CREATE_REQUESTS,
    "raw_projects": RAW_PROJECTS, "profiles": PROFILES, "patches": PATCHES,
    "user_patches": USER_PATCHES,
}


def inputs_of(name: str) -> list[str]:
    """Names of the tables and statements that a statement reads."""
    bare = STATEMENTS[name].replace("{{", "").replace("}}", "")
    return sorted(set(re.findall(r"\{(\w+)\}", bare)))


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in STATEMENTS:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    return spark.sql(STATEMENTS[name], **{used: fixture(spark, folder, used) for used in inputs_of(name)})


def with_fixtures(names: list[str], query: str) -> str:
    """The query for DuckDB, behind common table expressions for the named fixtures."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for used in inputs_of(name):
            if used in STATEMENTS:
                add(used)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    tables = {used: used for name in ordered for used in inputs_of(name)}
    parts = [f"{name} as ({STATEMENTS[name].format(**tables)})" for name in ordered]
    return "with " + ", ".join(parts) + "\n" + query
