"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from html.entities import html5

from tallyloom.plans.catalog import AS_OF, BATCH_SIZE, DEEP_LIMIT, DEEP_SKIP, LIMIT, MIN_SAMPLES, ONE_OWNER, SKIP
from tallyloom.plans.fixtures import with_fixtures as q

NOW = f"timestamp '{AS_OF}'"


def _lookup(requests: str, table: str, on: str, fields: list[str], key: str = "id", name: str = "") -> str:
    """``on`` joins r (requests) and t (table); ``key`` is a column of the table that is never NULL."""
    picks = ", ".join(f"case when count(t.{key}) = 1 then max(t.{f}) end as {f}" for f in fields)
    if name:
        picks = f"case when count(t.{key}) = 1 then max(t.{key}) end as {name}, " + picks
    return f"""
select r.*, {picks},
  case count(t.{key}) when 0 then 'missing' when 1 then 'found' else 'ambiguous' end as result
from {requests} r left join {table} t on {on} group by all"""


def _page(skip: int, limit: int) -> str:
    return f"""
select user_id, rn, id, name, created_at from (
  select *, row_number() over (partition by user_id order by created_at desc nulls first, id) as rn from projects)
where rn > {skip} and rn <= {skip + limit}"""


def _has(json: str, key: str) -> str:
    return f"coalesce(list_contains(json_keys({json}), '{key}'), false)"


def _error(kind: str, metadata: str) -> str:
    generates = f"{kind} in ('dataset_generation', 'dataset_and_fine_tune', 'full_pipeline')"
    tunes = f"{kind} in ('fine_tune', 'dataset_and_fine_tune', 'full_pipeline')"
    return f"""case
  when {kind} is null or {kind} not in ('dataset_generation', 'fine_tune', 'dataset_and_fine_tune', 'full_pipeline')
    then 'invalid_execution_type'
  when {generates} and not {_has(metadata, 'gen_model')} then 'missing_gen_model'
  when {generates} and not {_has(metadata, 'min_samples')} then 'missing_min_samples'
  when {tunes} and not {_has(metadata, 'base_model')} then 'missing_base_model'
  when {kind} = 'full_pipeline' and not {_has(metadata, 'deploy_instance_type')} then 'missing_deploy_instance_type'
end"""


VALIDATION = f"""
select project_id, execution_type, error_code, case error_code
  when 'invalid_execution_type' then 'Invalid execution type. Must be one of: '
    || '[''dataset_generation'', ''fine_tune'', ''dataset_and_fine_tune'', ''full_pipeline'']'
  when 'missing_gen_model' then 'Missing ''gen_model'' in metadata for dataset generation'
  when 'missing_min_samples' then 'Missing ''min_samples'' in metadata for dataset generation'
  when 'missing_base_model' then 'Missing ''base_model'' in metadata for fine tuning'
  when 'missing_deploy_instance_type' then 'Missing ''deploy_instance_type'' in metadata for deployment' end as message
from (select id as project_id, execution_type, {_error('execution_type', 'metadata')} as error_code from projects)"""

# Created projects, judged one by one.
CREATED = f"""
(select seq, id, user_id, name, description, execution_type, metadata,
  case when name is null then 'unprocessable' when error is not null then 'invalid:' || error
    when length(name) > 255 then 'error_too_long' else 'created' end as outcome
from (select *, {_error('execution_type', 'metadata')} as error
      from (select * replace (case when metadata is null or trim(metadata) = 'null' then '{{}}' else metadata end as metadata)
      from create_requests)))"""

# Profiles with their verdicts, as a chain of tables.
UPSERT = """,
alone as (
  select p.*, u.google_id is not null as own, u.email as old_email, u.full_name as old_name, u.avatar_url as old_avatar,
    coalesce(u.email = p.email, false) as kept,
    case when p.sub is null or p.sub = '' or p.email is null or p.email = '' then 'incomplete'
         when p.name is null then 'error_not_null'
         when length(p.sub) > 255 or length(p.email) > 255 or length(p.name) > 255 then 'error_too_long'
         when not coalesce(u.email = p.email, false)
           and exists (select 1 from users h where h.email = p.email and h.google_id <> p.sub) then 'email_conflict'
    end as verdict
  from profiles p left join users u on u.google_id = p.sub),
judged as (
  select * replace (case when verdict is null and not kept and sub <> first_value(sub) over
      (partition by email, kept, verdict order by seq) then 'email_conflict' else verdict end as verdict)
  from alone),
lasts as (
  select * from (select *, row_number() over (partition by sub order by seq desc) as nth from judged where verdict is null)
  where nth = 1),
settled as (
  select *, case
    when not own then 'inserted'
    when email = old_email and name = old_name and picture is not distinct from old_avatar then 'noop'
    else 'updated' end as outcome
  from lasts)
"""

PATCH_OUTCOME = f"""
    case when {_has('patch', 'execution_type')} or {_has('patch', 'metadata_')} then
      case when new_type is null or new_type not in
             ('dataset_generation', 'fine_tune', 'dataset_and_fine_tune', 'full_pipeline')
             then 'invalid:invalid_execution_type'
           when new_metadata is null then 'error_null_metadata'
           else 'invalid:' || ({_error('new_type', 'new_metadata')}) end end"""


def _set(key: str, column: str) -> str:
    return f"case when {_has('patch', key)} then json_extract_string(patch, '$.{key}') else {column} end"


def _mistyped(strings: list[str], objects: list[str]) -> str:
    wrong = [f"coalesce(json_type(patch, '$.{field}') not in ('VARCHAR', 'NULL'), false)" for field in strings]
    wrong += [f"coalesce(json_type(patch, '$.{field}') not in ('OBJECT', 'NULL'), false)" for field in objects]
    return f"case when {' or '.join(wrong)} then 'unprocessable' end"


def _entries(json: str) -> str:
    return f"list_sort(list_transform(json_keys({json}), lambda k: k || '=' || json_extract({json}, '$.' || k)::varchar))"


PATCHED = f""",
owned as (
  select a.seq, a.patch, p.*, row_number() over (partition by a.project_id, a.user_id order by a.seq) as nth
  from patches a join projects p on p.id = a.project_id and p.user_id = a.user_id),
merged as (
  select *, {_set('name', 'name')} as new_name, {_set('description', 'description')} as new_description,
    {_set('execution_type', 'execution_type')} as new_type, {_set('status', 'status')} as new_status,
    {_set('metadata_', 'metadata')} as new_metadata
  from owned where nth = 1),
settled as (
  select *, coalesce({_mistyped(["name", "description", "execution_type", "status"], ["metadata_"])}, {PATCH_OUTCOME},
    case when new_name is null then 'error_not_null'
      when length(new_name) > 255 or length(new_status) > 50 then 'error_too_long'
      when (new_name, new_type) = (name, execution_type) and new_description is not distinct from description
        and new_status is not distinct from status and (new_metadata is not distinct from metadata or {_entries('new_metadata')} = {_entries('metadata')}) then 'noop'
      else 'ok' end) as outcome
  from merged)
"""

CODES = """case when outcome like 'invalid:%' or outcome = 'incomplete' then 400
  when outcome in ('ok', 'noop', 'inserted', 'updated', 'superseded') then 200 when outcome = 'created' then 201
  when outcome = 'deleted' then 204 when outcome = 'not_found' then 404 when outcome = 'unprocessable' then 422
  when outcome in ('email_conflict', 'error_null_metadata', 'error_not_null', 'error_too_long') then 500 end::bigint as code"""

USER_PATCHED = f""",
owned as (
  select a.seq, a.patch, u.*, row_number() over (partition by a.user_id order by a.seq) as nth
  from user_patches a join users u on u.id = a.user_id),
settled as (
  select *, case when coalesce(json_type(patch, '$.full_name') not in ('VARCHAR', 'NULL'), false) then 'unprocessable'
    when new_name is null then 'error_not_null'
    when length(new_name) > 255 then 'error_too_long' when new_name = full_name then 'noop' else 'ok' end as outcome
  from (select *, {_set('full_name', 'full_name')} as new_name from owned where nth = 1))
"""

GONE_USERS = "(select user_id from user_requests)"
GONE_PROJECTS = f"(select id from projects where user_id in (select id from users where id in {GONE_USERS}))"
DELETED = """(select id from projects p where exists (
  select 1 from delete_requests d where d.project_id = p.id and d.user_id = p.user_id))"""

KEY = "split_part({0}, '/', 1) as user_id, split_part({0}, '/', 3) as project_id"

PLAN = """(
select p.id as project_id, p.execution_type, s.pos, s.step from projects p, (values
  (0, 'validate_data'), (1, 'ocr_extraction'), (2, 'chunk_data'),
  (3, 'generate_dataset'), (4, 'fine_tune'), (5, 'deploy_model')) s(pos, step)
where s.pos < 3
  or s.pos = 3 and execution_type in ('dataset_generation', 'dataset_and_fine_tune', 'full_pipeline')
  or s.pos = 4 and execution_type in ('fine_tune', 'dataset_and_fine_tune', 'full_pipeline')
  or s.pos = 5 and execution_type = 'full_pipeline')"""

NUMBERED_PLAN = f"(select project_id, row_number() over (partition by project_id order by pos) - 1 as pos, step from {PLAN})"

LATEST = """(
select project_id, step, status, ts from (
  select *, row_number() over (partition by project_id, step order by ts desc, event_id desc) as nth from results)
where nth = 1)"""

STEP_ORDER = """list_position(['validate_data', 'ocr_extraction', 'chunk_data',
  'generate_dataset', 'fine_tune', 'deploy_model'], step)"""

def _verdicts(documents: str) -> str:
    return rf"""(
select *, case when not coalesce(regexp_matches(text, '[^\x09-\x0D\x20]'), false) then 'empty'
  when length(text) <> coalesce(n_chars, -1) then 'length_mismatch' when length(text) < 50 then 'too_short'
  when doc_id > min(doc_id) over (partition by sha256(text)) then 'duplicate' else 'ok' end as verdict
from {documents})"""


VERDICTS = _verdicts("documents")

FILLED = r"(select *, ceil(greatest(length(text) - 100, 1) / 400)::bigint as n from documents where regexp_matches(text, '[^\x09-\x0D\x20]'))"


def _chunked(documents: str) -> str:
    return f"""(
select doc_id, chunk, chunk * 400 as start, substring(text, chunk * 400 + 1, 500) as text
from (select doc_id, text, unnest(generate_series(0, n - 1)) as chunk from {documents}))"""


SCRIPTS = "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}(?:[\s/][^>]*)?>|\z)" for t in ("script", "style"))
COMMENTS = r"<!--(?:-?>|.*?(?:--!?>|\z))"
TAGS = r"""</?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?/][^>]*>|</?[A-Za-z][^>]*>"""
TITLES = r"<title(?:[\s/][^>]*)?>(.*?)(?:</title(?:[\s/][^>]*)?>|\z)"
ENTITIES = "map {{{}}}".format(", ".join("'{}': '{}'".format(n[:-1], c.replace("'", "''")) for n, c in sorted(html5.items()) if n[-1] == ";"))
OLD_NUMBERS = "map {{{}}}".format(", ".join(f"{n}: '{bytes([n]).decode('cp1252')}'" for n in range(128, 160) if n not in (129, 141, 143, 144, 157)))


def _number(digits: str) -> str:
    return f"""case when map_contains({OLD_NUMBERS}, {digits}) then {OLD_NUMBERS}[{digits}]
  when {digits} > 0 and {digits} < 1114112 and not {digits} between 55296 and 57343 then chr({digits}) else '�' end"""


def _plain(html: str) -> str:
    """Markup goes in one scan, then each reference is decoded once."""
    bare = rf"regexp_replace({html}, '(?is){SCRIPTS}|{COMMENTS}|{TAGS}', ' ', 'g')"
    tokens = rf"regexp_extract_all({bare}, '(?s)&(?:#[0-9]{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&')"
    decoded = f"""array_to_string(list_transform({tokens}, lambda t: case when not (starts_with(t, '&') and ends_with(t, ';')) then t
  when lower(t[1:3]) = '&#x' then {_number("('0x' || t[4:-2])::integer")}
  when t[1:2] = '&#' then {_number("t[3:-2]::integer")}
  else coalesce({ENTITIES}[t[2:-2]], t) end), '')"""
    return rf"trim(regexp_replace(coalesce({decoded}, ''), '[\x09-\x0D\x20\x{{A0}}]+', ' ', 'g'))"


def _texts(pages: str) -> str:
    return f"select page_id, {_plain("coalesce(html, '')")} as text from {pages}"


def _titles(pages: str) -> str:
    return rf"""
select page_id, {_plain(f"coalesce(regexp_extract(found, '(?is)^{TITLES}', 1), '')")} as title
from (select page_id, list_filter(regexp_extract_all(coalesce(html, ''), '(?is){SCRIPTS}|{COMMENTS}|{TITLES}|{TAGS}'),
  lambda t: lower(t[1:6]) = '<title')[1] as found from {pages})"""


def _good(documents: str) -> str:
    return f"(select *, ceil(greatest(length(text) - 100, 1) / 400)::bigint as n from {_verdicts(documents)} where verdict = 'ok')"


def _records(documents: str) -> str:
    return f"""
select doc_id || '-' || chunk as record_id, doc_id, chunk,
  case when substring(md5(doc_id::varchar), 1, 2) < '1a' then 'val' else 'train' end as split, text
from {_chunked(_good(documents))}"""


def _gate(documents: str) -> str:
    return f"""
select source, coalesce(sum(n) filter (where verdict = 'ok'), 0)::bigint as n_records,
  case when coalesce(sum(n) filter (where verdict = 'ok'), 0) >= {MIN_SAMPLES} then 'ok' else 'insufficient' end as result
from (select *, ceil(greatest(length(text) - 100, 1) / 400)::bigint as n from {_verdicts(documents)}) group by source"""


def _chats(turns: str) -> str:
    return f"""
select conv_id, (rn - 1) // 8 as part, count(*) as n_turns,
  to_json(list({{'turn': turn, 'role': role, 'text': text}} order by rn))::varchar as sample
from (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as rn
  from {turns}) group by conv_id, (rn - 1) // 8"""


ORACLE: dict[str, str] = {
    "project_lookup": q(["project_requests", "projects"], _lookup(
        "project_requests", "projects", "r.project_id = t.id and r.user_id = t.user_id",
        ["name", "execution_type", "status", "metadata", "created_at"])),
    "user_by_id": q(["user_requests", "users"], _lookup(
        "user_requests", "users", "r.user_id = t.id", ["email", "full_name", "is_active"])),
    "user_by_email": q(["email_requests", "users"], _lookup(
        "email_requests", "users", "r.email = t.email", ["full_name", "is_active"], name="user_id")),
    "lookup_ambiguity": q(["users"], "select email, count(*) as n, count(*) > 1 as ambiguous from users group by email"),
    "download_key_audit": q(["downloads", "projects"], """
select d.*, case when not exists (select 1 from projects p where p.id = d.project_id and p.user_id = d.user_id) then 404
  when not (contains(r2_key, user_id) and contains(r2_key, project_id)) then 403 else 200 end::bigint as code
from downloads d"""),
    "user_view": q(["users"], "select id, email, full_name, avatar_url, is_active, created_at from users"),
    "project_view": q(["projects"], """
select * rename (metadata as metadata_) from projects where num_files is not null and status is not null
  and pipeline_status is not null and created_at is not null and updated_at is not null"""),
    "project_view_rejects": q(["projects"], " union all ".join(
        f"select id, '{c}' as column_name from projects where {c} is null"
        for c in ("num_files", "status", "pipeline_status", "created_at", "updated_at"))),
    "file_view": q(["files"], "select id, filename, folder, file_size, content_type, created_at from files"),
    "object_keys": q(["files", "projects"], """
select f.project_id, p.user_id, f.folder, f.filename,
  p.user_id || '/projects/' || f.project_id || '/' || f.folder || '/' || f.filename as r2_key
from files f join projects p on p.id = f.project_id"""),
    "object_key_parts": q(["objects"], f"""
select key, {KEY.format('key')}, split_part(key, '/', 4) as folder, split_part(key, '/', 5) as filename, true as conforms
from objects"""),
    "upload_keys": q(["uploads", "projects"], """
select u.*, case when p.id is not null
    then u.user_id || '/projects/' || u.project_id || '/' || folder || '/' || filename end as r2_key,
  case when p.id is not null then 3600 end::bigint as expires_in,
  case when p.id is not null then 200 else 404 end::bigint as code
from uploads u left join projects p on p.id = u.project_id and p.user_id = u.user_id"""),
    "object_listing": q(["nested_objects", "projects", "folder_requests"], """
select user_id, project_id, folder, replace(key, prefix, '') as filename, key as r2_key, size, last_modified
from (select distinct p.user_id, p.id as project_id, f.folder, p.user_id || '/projects/' || p.id || '/' || f.folder || '/' as prefix
  from (select user_id, project_id, coalesce(folder, 'Data') as folder from folder_requests) f
  join projects p on p.id = f.project_id and p.user_id = f.user_id)
join nested_objects o on split_part(key, '/', 3) = project_id and starts_with(key, prefix) and key <> prefix"""),
    "object_listing_outcomes": q(["projects", "folder_requests"], """
select f.*, case when exists (select 1 from projects p where p.id = f.project_id and p.user_id = f.user_id)
  then 200 else 404 end::bigint as code from folder_requests f"""),
    "project_owner": q(["projects", "users"], """
select p.id as project_id, p.name, p.status, p.user_id, u.email as owner_email, u.full_name as owner_name
from projects p join users u on u.id = p.user_id"""),
    "user_projects": q(["projects", "users"], """
select u.id as user_id, u.email, p.id as project_id, p.name as project_name, p.status
from users u left join projects p on p.user_id = u.id"""),
    "project_files_join": q(["projects", "files"], """
select p.id as project_id, p.name as project_name, r2_key, filename, folder, file_size, content_type
from projects p left join files f on f.project_id = p.id"""),
    "project_count_by_owner": q(["users", "projects"], """
select u.id as user_id, count(p.id) as total from users u left join projects p on p.user_id = u.id group by u.id"""),
    "project_num_files": q(["projects", "files"], """
select p.id as project_id, count(f.id) as num_files from projects p left join files f on f.project_id = p.id group by p.id"""),
    "project_page_one_owner": q(["projects"], f"""
select id, user_id, name, status, created_at from projects where user_id = '{ONE_OWNER}'
order by created_at desc nulls first, id limit {LIMIT} offset {SKIP}"""),
    "project_page_all_owners": q(["projects"], _page(SKIP, LIMIT)),
    "project_page_deep": q(["projects"], _page(DEEP_SKIP, DEEP_LIMIT)),
    "project_page_envelope": q(["users", "projects"], f"""
select u.id as user_id, coalesce(total, 0) as total, 2::bigint as page, 10::bigint as size, rn, i.id as project_id,
  i.name, p.status, i.created_at
from users u left join (select user_id, count(*) as total from projects group by user_id) c on c.user_id = u.id
left join ({_page(10, 10)}) i on i.user_id = u.id left join projects p on p.id = i.id"""),
    "metadata_validation": q(["projects"], VALIDATION),
    "metadata_error_counts": q(["projects"], f"""
select coalesce(error_code, 'ok') as error_code, count(*) as n from ({VALIDATION}) group by 1"""),
    "fk_orphans": q(["users", "projects", "files"], """
select 'projects' as table_name, 'user_id' as column_name, user_id as value from projects
where user_id not in (select id from users)
union all
select 'project_files', 'project_id', project_id from files where project_id not in (select id from projects)"""),
    "column_rule_violations": q(["users", "raw_projects", "files"], " union all ".join(
        f"select '{table}' as table_name, id as row_id, '{column}:{rule}' as rule from {source} where {condition}"
        for table, source, required, limits in [
            ("users", "users", ["id", "email", "full_name", "google_id"],
             [("email", 255), ("full_name", 255), ("google_id", 255)]),
            ("projects", "raw_projects", ["id", "user_id", "name", "execution_type"],
             [("name", 255), ("execution_type", 50), ("status", 50)]),
            ("project_files", "files", ["id", "project_id", "filename", "r2_key", "folder"],
             [("filename", 500), ("folder", 50), ("content_type", 255)])]
        for column, rule, condition in [(c, "not_null", f"{c} is null") for c in required]
        + [(c, f"max_{n}", f"length({c}) > {n}") for c, n in limits])),
    "unique_violations": q(["users", "projects", "files"], " union all ".join(
        f"select '{table}' as table_name, '{column}' as column_name, {column} as value, count(*) as n "
        f"from {source} group by {column} having count(*) > 1"
        for table, source, column in [
            ("users", "users", "id"), ("users", "users", "email"), ("users", "users", "google_id"),
            ("projects", "projects", "id"), ("project_files", "files", "id"), ("project_files", "files", "r2_key")])),
    "email_format": q(["users"], """
select id, email, regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') as valid from users"""),
    "project_create": q(["create_requests"], f"select seq, id as project_id, outcome, {CODES} from {CREATED}"),
    "project_create_table": q(["projects", "create_requests"], f"""
select * from projects
union all by name
select id, user_id, name, description, execution_type, 'created' as status, 0 as num_files, metadata,
  '{{}}' as pipeline_status, null as error_message, {NOW} as created_at, {NOW} as updated_at
from {CREATED} where outcome = 'created'"""),
    "user_upsert": q(["users", "profiles"], f"""{UPSERT}
select seq, sub, outcome, {CODES} from (
  select j.seq, j.sub, coalesce(j.verdict, s.outcome, 'superseded') as outcome
  from judged j left join settled s on s.seq = j.seq)"""),
    "user_upsert_table": q(["users", "profiles"], f"""{UPSERT},
applied as (select * from settled where outcome in ('inserted', 'updated'))
select u.id, coalesce(a.email, u.email) as email, coalesce(a.name, u.full_name) as full_name,
  case when a.sub is null then avatar_url else picture end as avatar_url, google_id, is_active, created_at,
  case when a.sub is null then updated_at else {NOW} end as updated_at
from users u left join applied a on a.sub = u.google_id
union all
select new_id, email, name, picture, sub, true, {NOW}, {NOW} from applied where outcome = 'inserted'"""),
    "project_patch": q(["projects", "patches"], f"""{PATCHED}
select seq, project_id, user_id, outcome, {CODES} from (
  select a.seq, a.project_id, a.user_id,
    coalesce(s.outcome, case when o.seq is null then 'not_found' else 'deferred' end) as outcome
  from patches a left join owned o on o.seq = a.seq left join settled s on s.seq = a.seq)"""),
    "project_patch_table": q(["projects", "patches"], f"""{PATCHED},
done as (select * from settled where outcome = 'ok')
select p.* replace (
  case when d.id is null then p.name else new_name end as name,
  case when d.id is null then p.description else new_description end as description,
  case when d.id is null then p.execution_type else new_type end as execution_type,
  case when d.id is null then p.status else new_status end as status,
  case when d.id is null then p.metadata else new_metadata end as metadata,
  case when d.id is null then p.updated_at else {NOW} end as updated_at)
from projects p left join done d on d.id = p.id"""),
    "user_patch": q(["users", "user_patches"], f"""{USER_PATCHED}
select seq, user_id, outcome, {CODES} from (
  select a.seq, a.user_id, coalesce(s.outcome, case when o.seq is null then 'not_found' else 'deferred' end) as outcome
  from user_patches a left join owned o on o.seq = a.seq left join settled s on s.seq = a.seq)"""),
    "user_patch_table": q(["users", "user_patches"], f"""{USER_PATCHED},
done as (select * from settled where outcome = 'ok')
select u.* replace (coalesce(new_name, u.full_name) as full_name,
  case when d.id is null then u.updated_at else {NOW} end as updated_at)
from users u left join done d on d.id = u.id"""),
    "project_delete": q(["projects", "delete_requests"], f"""
select seq, project_id, user_id, outcome, {CODES} from (
  select d.seq, d.project_id, d.user_id, case when p.id is not null
    and row_number() over (partition by d.project_id, d.user_id order by d.seq) = 1
    then 'deleted' else 'not_found' end as outcome
  from delete_requests d left join projects p on p.id = d.project_id and p.user_id = d.user_id)"""),
    "project_delete_table": q(["projects", "delete_requests"], f"select * from projects where id not in {DELETED}"),
    "project_delete_files": q(["projects", "files", "delete_requests"],
                              f"select * from files where project_id not in {DELETED}"),
    "user_deactivate": q(["users", "user_requests"], """
select seq, user_id, case when user_id in (select id from users) then 204 else 400 end::bigint as code
from user_requests"""),
    "user_deactivate_table": q(["users", "user_requests"], f"""
select * replace (is_active and id not in {GONE_USERS} as is_active,
  case when is_active and id in {GONE_USERS} then {NOW} else updated_at end as updated_at) from users"""),
    "user_cascade_delete": q(["users", "user_requests"], f"select * from users where id not in {GONE_USERS}"),
    "user_cascade_delete_projects": q(["users", "projects", "user_requests"],
                                      f"select * from projects where id not in {GONE_PROJECTS}"),
    "user_cascade_delete_files": q(["users", "projects", "files", "user_requests"],
                                   f"select * from files where project_id not in {GONE_PROJECTS}"),
    "delete_manifest": q(["objects", "project_requests"], f"""
select user_id, project_id, (row_number() over (partition by user_id, project_id order by key) - 1) // {BATCH_SIZE} as batch,
  key
from (select {KEY.format('key')}, key from objects) o
where exists (select 1 from project_requests r where r.user_id = o.user_id and r.project_id = o.project_id)"""),
    "run_transition": q(["projects", "project_requests"], """
select r.*, case when p.id is null then 404 else 200 end::bigint as code
from project_requests r left join projects p on p.id = r.project_id and p.user_id = r.user_id"""),
    "run_transition_table": q(["projects", "project_requests"], f"""
select p.* replace (case when r.seq is null then status else 'processing' end as status,
  case when r.seq is null or status = 'processing' then updated_at else {NOW} end as updated_at)
from projects p left join project_requests r on p.id = r.project_id and p.user_id = r.user_id"""),
    "access_outcomes": q(["claims", "users"], """
select c.*, case when expired or sub is null or token_type <> 'access' or u.id is null then 401
  when not is_active then 400 else 200 end::bigint as code
from claims c left join users u on u.id = c.sub"""),
    "refresh_outcomes": q(["claims", "users"], """
select c.*, case when expired then 401 when token_type <> 'refresh' then 400
  when u.id is null or not is_active then 401 else 200 end::bigint as code
from claims c left join users u on u.id = c.sub"""),
    "token_expiry": q(["tokens"], f"""
select *, date_trunc('second', expires_at) < {NOW} as expired from (
  select *, issued_at + case token_type when 'access' then interval 60 minutes else interval 7 days end as expires_at
  from tokens)"""),
    "stage_plan": q(["projects"], f"select * from {NUMBERED_PLAN}"),
    "latest_step_result": q(["results"], f"select * from {LATEST}"),
    "step_status_json": q(["results"], f"""
select project_id, '{{' || string_agg('"' || step || '":"' || status || '"', ',' order by {STEP_ORDER}) || '}}'
  as pipeline_status
from {LATEST} group by project_id"""),
    "project_outcome": q(["projects", "results"], f"""
select project_id, case when bool_or(coalesce(status = 'failure', false)) then 'failed'
  when bool_and(coalesce(status = 'success', false)) then 'completed' else 'processing' end as outcome
from {PLAN} left join {LATEST} using (project_id, step) group by project_id"""),
    "retained_results": q(["results"], f"select * from results where ts >= {NOW} - interval 24 hours"),
    "step_results_stream": q(["results"], """
select window_start, window_start + interval 24 hours as window_end, project_id, step,
  arg_max(status, (ts, event_id)) as status, max(ts) as ts
from (select *, date_trunc('day', ts) as window_start from results)
where window_start + interval 24 hours <= (select date_trunc('milliseconds', max(ts)) from results) - interval 24 hours
group by window_start, project_id, step"""),
    "document_verdicts": f"select doc_id, source, lang, verdict from {VERDICTS}",
    "validation_report": f"""
select source, lang, count(*) as n_documents, count(*) filter (where verdict = 'empty') as n_empty,
  count(*) filter (where verdict = 'length_mismatch') as n_length_mismatch,
  count(*) filter (where verdict = 'too_short') as n_too_short,
  count(*) filter (where verdict = 'duplicate') as n_duplicate, count(*) filter (where verdict = 'ok') as n_ok,
  count(*) filter (where verdict = 'ok') / count(*) as pass_rate
from {VERDICTS} group by source, lang""",
    "page_text": _texts("pages"),
    "page_titles": _titles("pages"),
    "raw_page_text": q(["raw_pages"], _texts("raw_pages")),
    "raw_page_titles": q(["raw_pages"], _titles("raw_pages")),
    "document_chunks": f"select * from {_chunked(FILLED)}",
    "chunk_stats": f"""
select doc_id, count(*) as n_chunks, sum(length(text))::bigint as total_chars, avg(length(text)) as mean_chars
from {_chunked(FILLED)} group by doc_id""",
    "dataset_records": _records("documents"),
    "min_samples_gate": _gate("documents"),
    "chat_samples": _chats("conversations"),
    "submitted_verdicts": q(["raw_documents"], f"select doc_id, source, lang, verdict from {_verdicts('raw_documents')}"),
    "submitted_records": q(["raw_documents"], _records("raw_documents")),
    "submitted_gate": q(["raw_documents"], _gate("raw_documents")),
    "logged_chat_samples": q(["raw_turns"], _chats("raw_turns")),
}
