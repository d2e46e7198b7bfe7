"""Batched writes.

Each takes the current table and a batch of requests and gives the new table and one outcome per
request. Requests carry ``seq``, the order in which they were made; ids of new rows and the clock
(``as_of``) are inputs, so a run can be repeated.

A batch may aim a third of its requests at one row. Requests are therefore folded to one row per
target by aggregation, which combines on the map side, and outcomes go back to the requests with
``attach``, which lets adaptive execution split them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import rules as R
from tallyloom.operators.joins import MANY_BITS, attach, without_listed
from tallyloom.operators.lookup import counted, guarded
from tallyloom.operators.ranking import split_rank
from tallyloom.schemas import MAX_LENGTH
from tallyloom.session import cut_lineage

# Response codes by outcome. A deferred request has no response yet.
CODES = {
    "created": 201, "ok": 200, "noop": 200, "deleted": 204, "not_found": 404, "unprocessable": 422,
    "error_null_metadata": 500, "error_not_null": 500, "error_too_long": 500, "email_conflict": 500,
    "ambiguous": 500, "incomplete": 400, "inserted": 200, "updated": 200, "superseded": 200,
}


def response_code(outcome: Column) -> Column:
    code = F.when(outcome.startswith("invalid:"), F.lit(400))
    for name, number in CODES.items():
        code = code.when(outcome == name, F.lit(number))
    return code.cast("bigint")


def with_code(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("code", response_code(F.col("outcome")))


def _replace(joined: DataFrame, columns: list[str], changes: dict[str, Column]) -> DataFrame:
    """The table's columns, some of them computed anew."""
    return joined.select(*[
        changes[column].alias(column) if column in changes else F.col(column) for column in columns])


def too_long(table: str, values: dict[str, str]) -> Column:
    """Whether any of the named frame columns is too long for the table column it is meant for."""
    return reduce(Column.__or__, [
        F.coalesce(F.length(value) > MAX_LENGTH[table][column], F.lit(False)) for column, value in values.items()])


def invalid(code: Column) -> Column:
    return F.concat(F.lit("invalid:"), code)


def _meant(requests: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct targets of requests that name exactly one row."""
    return requests.select(*keys).distinct().join(known.where("_n = 1").select(*keys), keys)


# --- creating projects -------------------------------------------------------------------------

def project_create(projects: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Requests: seq, id, user_id, name, description, execution_type, metadata."""
    # JSON null is no metadata either.
    metadata = F.when(F.trim(F.coalesce("metadata", F.lit("null"))) == "null", F.lit("{}")).otherwise(F.col("metadata"))
    judged = (
        requests.withColumn("metadata", metadata)
        .withColumn("_keys", R.json_keys(F.col("metadata")))
        .withColumn("_error", R.first_metadata_error(F.col("execution_type"), F.col("_keys")))
        .withColumn("_complete", F.col("name").isNotNull() & F.col("execution_type").isNotNull()
                    & F.col("_keys").isNotNull())
        .withColumn("_too_long", too_long("projects", {"name": "name"}))
    )
    # Defaults of a new project.
    new = judged.where("_complete and _error is null and not _too_long").select(
        "id", "user_id", "name", "description", "execution_type", F.lit("created").alias("status"),
        F.lit(0).alias("num_files"), "metadata", F.lit("{}").alias("pipeline_status"),
        F.lit(None).cast("string").alias("error_message"),
        as_of.alias("created_at"), as_of.alias("updated_at"))
    outcome = (F.when(~F.col("_complete"), "unprocessable")
               .when(F.col("_error").isNotNull(), invalid(F.col("_error")))
               .when(F.col("_too_long"), "error_too_long").otherwise("created"))
    outcomes = with_code(judged.select("seq", F.col("id").alias("project_id"), outcome.alias("outcome")))
    return projects.unionByName(new), outcomes


# --- upserting users ---------------------------------------------------------------------------

def _judge_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles with what can be told about each alone (``_verdict``, NULL if it may apply)."""
    known = counted(users.withColumnRenamed("google_id", "sub"), ["sub"], {
        "email": "_email", "full_name": "_name", "avatar_url": "_avatar"})
    own = F.col("_n").isNotNull()
    incomplete = R.is_blank(F.col("sub")) | R.is_blank(F.col("email"))
    verdict = (F.when(incomplete, "incomplete")
               .when(F.col("_n") > 1, "ambiguous")
               .when(F.col("name").isNull(), "error_not_null")
               .when(too_long("users", {"google_id": "sub", "email": "email", "full_name": "name"}), "error_too_long"))
    judged = attach(profiles, known, ["sub"], "left").withColumn("_own", own).withColumn("_verdict", verdict).select(
        *profiles.columns, "_own", "_email", "_name", "_avatar", "_verdict")
    return judged


# When a holder from before the batch came to its email, and when one that keeps it will leave it.
ALWAYS, NEVER = -1 << 62, 1 << 62


def _email_conflicts(users: DataFrame, judged: DataFrame) -> DataFrame:
    """``seq, sub, email`` of profiles whose email another account holds when their turn comes.

    Emails are taken and released in order of ``seq``. Only emails that several accounts bring or hold are looked at, and
    they all at once, in rounds. A round knows of each email its holder and since when, and finds the
    holder's first later profile with another email that is not refused. Other accounts' profiles before that
    are refused, the holder's own are accepted; if that profile is accepted, the email is free from then on and goes to
    the first profile after it. What comes behind an undecided profile waits. The earliest undecided profile is
    decided in every round, so the rounds end; as many are needed as an email changes hands in a chain.
    """
    claims = judged.where("_verdict is null").select("seq", "sub", "email")
    held = users.where("email is not null").select("email", F.col("google_id").alias("sub"))
    both = claims.select("email", "sub").unionByName(held).groupBy("email").agg(
        F.min("sub").alias("_one"), F.max("sub").alias("_other")).where("_one <> _other").select("email")
    owners = attach(held, both, ["email"], "left_semi").groupBy("email").agg(
        F.min("sub").alias("holder"), F.max("sub").alias("_last"))
    # An email that several accounts had before the batch is nobody's to take.
    shared = owners.where("holder <> _last").select("email", F.lit(True).alias("_shared"))
    contested = attach(claims, both, ["email"], "left_semi")
    open_ = attach(contested, shared, ["email"], "left")
    refused = open_.where("_shared").join(held.withColumnRenamed("email", "_own"), "sub", "left").where(
        ~F.col("email").eqNullSafe(F.col("_own"))).select("seq", "sub", "email")
    open_ = cut_lineage(open_.where("_shared is null").select("seq", "sub", "email", F.lit(None).cast("boolean").alias("ok")))
    if open_.isEmpty():
        return refused
    # All other profiles of the accounts that take part: they release emails, and are accepted.
    involved = open_.select("sub").unionByName(owners.select(F.col("holder").alias("sub"))).distinct()
    others = attach(claims, involved, ["sub"], "left_semi").join(open_.select("seq"), "seq", "left_anti").join(
        refused.select("seq"), "seq", "left_anti")
    moves = cut_lineage(open_.unionByName(others.withColumn("ok", F.lit(True))))
    state = cut_lineage(open_.select("email").distinct().join(owners.where("holder = _last").drop("_last"), "email", "left")
                        .withColumn("since", F.lit(ALWAYS)))
    while not moves.where("ok is null").isEmpty():
        later = moves.where("coalesce(ok, true)").withColumnRenamed("email", "_to").join(
            state.where("holder is not null").withColumnRenamed("holder", "sub"), "sub")
        leaves = later.where("seq > since and _to <> email").groupBy("email").agg(F.min(F.struct("seq", "ok")).alias("_leave"))
        now = state.join(leaves, "email", "left").withColumn("until", F.coalesce("_leave.seq", F.lit(NEVER))).withColumn(
            "freed", F.col("holder").isNull() | F.coalesce("_leave.ok", F.lit(False)))
        seen = attach(moves.where("ok is null"), now.select("email", "holder", "until", "freed", "since"), ["email"], "inner")
        before = F.col("holder").isNotNull() & (F.col("seq") < F.col("until"))
        seen = cut_lineage(seen.withColumn("ok", F.when(before, F.col("sub") == F.col("holder"))))
        first = seen.where("ok is null and freed").groupBy("email").agg(F.min(F.struct("seq", "sub")).alias("_first"))
        freed_at = F.when(F.col("holder").isNull(), F.col("since")).otherwise(F.col("until"))
        state = cut_lineage(now.join(first, "email", "left").select(
            "email", F.when(~F.col("freed"), F.col("holder")).otherwise(F.col("_first.sub")).alias("holder"),
            F.when(~F.col("freed"), F.col("since")).otherwise(F.coalesce("_first.seq", freed_at)).alias("since")))
        taken = first.select(F.col("_first.seq").alias("seq"), F.lit(True).alias("_taken"))
        decided = seen.select("seq", "ok").join(taken, "seq", "left").select("seq", F.coalesce("_taken", "ok").alias("_ok"))
        moves = cut_lineage(moves.join(decided, "seq", "left").select(
            "seq", "sub", "email", F.coalesce("ok", "_ok").alias("ok")))
    return refused.unionByName(moves.where("not ok").select("seq", "sub", "email"))


def _settle_profiles(judged: DataFrame) -> DataFrame:
    """The last applicable profile per ``sub`` with its ``outcome``."""
    fields = [c for c in judged.columns if c not in ("sub", "_verdict")]
    last = (judged.where("_verdict is null").groupBy("sub")
            .agg(F.max_by(F.struct(*fields), "seq").alias("_last")).select("sub", "_last.*"))
    same = (F.col("email").eqNullSafe(F.col("_email")) & F.col("name").eqNullSafe(F.col("_name"))
            & F.col("picture").eqNullSafe(F.col("_avatar")))
    outcome = F.when(~F.col("_own"), "inserted").when(same, "noop").otherwise("updated")
    return last.withColumn("outcome", outcome)


def user_upsert(users: DataFrame, profiles: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Profiles: seq, sub, email, name, picture, and new_id for a user not yet known.

    A known user takes email, name and avatar (even NULL) from the profile and is not
    reactivated; an unchanged one keeps ``updated_at``. Profiles that would break the unique
    email when their turn comes are left out: an email that its holder left earlier in the batch is free.
    ``seq`` is unique.
    """
    # The new table and the outcomes both start from the judged profiles.
    alone = cut_lineage(_judge_profiles(users, profiles))
    clashes = _email_conflicts(users, alone).select("seq", F.lit("email_conflict").alias("_clash"))
    judged = cut_lineage(alone.join(clashes, "seq", "left").withColumn("_verdict", F.coalesce("_verdict", "_clash")).drop("_clash"))
    settled = _settle_profiles(judged)

    change = settled.where("outcome = 'updated'").select(
        F.col("sub").alias("google_id"), F.col("email").alias("_new_email"), F.col("name").alias("_new_name"),
        F.col("picture").alias("_new_avatar"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    kept = _replace(users.join(change, "google_id", "left"), users.columns, {
        "email": F.when(hit, F.col("_new_email")).otherwise(F.col("email")),
        "full_name": F.when(hit, F.col("_new_name")).otherwise(F.col("full_name")),
        "avatar_url": F.when(hit, F.col("_new_avatar")).otherwise(F.col("avatar_url")),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))})
    new = settled.where("outcome = 'inserted'").select(
        F.col("new_id").alias("id"), "email", F.col("name").alias("full_name"), F.col("picture").alias("avatar_url"),
        F.col("sub").alias("google_id"), F.lit(True).alias("is_active"),
        as_of.alias("created_at"), as_of.alias("updated_at"))
    table = kept.unionByName(new)

    decided = settled.select("sub", F.col("seq").alias("_seq"), F.col("outcome").alias("_outcome"))
    outcomes = attach(judged, decided, ["sub"], "left").select(
        "seq", "sub",
        F.coalesce(F.col("_verdict"),
                   F.when(F.col("seq") == F.col("_seq"), F.col("_outcome")).otherwise("superseded")).alias("outcome"))
    return table, with_code(outcomes)


# --- patching ----------------------------------------------------------------------------------

# What a project patch may set, and the column each field is stored in.
PATCHABLE = {"name": "name", "description": "description", "execution_type": "execution_type",
             "metadata_": "metadata", "status": "status"}
# The JSON types that a field may have besides null.
STRING, OBJECT = "string", "object"
FIELD_TYPES = {field: OBJECT if field == "metadata_" else STRING for field in PATCHABLE}


def wrongly_typed(patch: Column, keys: Column, types: dict[str, str]) -> Column:
    """Whether a field that the patch sets holds neither null nor a value of its type."""
    parsed = F.try_parse_json(patch)

    def wrong(field: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
        fits = found.startswith("OBJECT") if kind == OBJECT else found == "STRING"
        return R.has_key(keys, field) & ~F.coalesce(fits | (found == "VOID"), F.lit(False))

    return reduce(Column.__or__, [wrong(field, kind) for field, kind in types.items()])


def same_json(left: Column, right: Column) -> Column:
    """Equal as text or as JSON, in which the order of keys and white space do not count."""
    return left.eqNullSafe(right) | F.coalesce(
        F.to_json(F.try_parse_json(left)) == F.to_json(F.try_parse_json(right)), F.lit(False))


def _first_patches(patches: DataFrame, keys: list[str]) -> DataFrame:
    return patches.groupBy(*keys).agg(F.min_by("patch", "seq").alias("patch"), F.min("seq").alias("_first"))


def _patched_project(joined: DataFrame) -> DataFrame:
    """Adds ``_new_<column>`` and ``_outcome`` to project rows joined with a ``patch``.

    Patch and merged metadata are parsed once each, into columns of their own, and the metadata
    only where a patch asks for validation.
    """
    schema = ", ".join(f"{field} string" for field in PATCHABLE)
    joined = joined.withColumns({"_set": R.json_keys(F.col("patch")), "_value": F.from_json("patch", schema)})
    joined = joined.withColumns({
        f"_new_{column}": F.when(R.has_key(F.col("_set"), field), F.col(f"_value.{field}")).otherwise(F.col(column))
        for field, column in PATCHABLE.items()})
    sets_metadata = R.has_key(F.col("_set"), "metadata_")
    checked = R.has_key(F.col("_set"), "execution_type") | sets_metadata
    joined = joined.withColumn("_keys", F.when(checked, R.json_keys(F.col("_new_metadata"))))
    kind, metadata = F.col("_new_execution_type"), F.col("_new_metadata")
    error = R.first_metadata_error(kind, F.col("_keys"))
    unchanged = reduce(Column.__and__, [
        same_json(F.col(f"_new_{column}"), F.col(column)) if column == "metadata"
        else F.col(f"_new_{column}").eqNullSafe(F.col(column)) for column in PATCHABLE.values()])
    outcome = (
        F.when(F.col("_set").isNull() | wrongly_typed(F.col("patch"), F.col("_set"), FIELD_TYPES), "unprocessable")
        .when(checked & ~R.is_known_type(kind), "invalid:invalid_execution_type")
        .when(checked & metadata.isNull(), "error_null_metadata")
        .when(checked & error.isNotNull(), invalid(error))
        .when(F.col("_new_name").isNull(), "error_not_null")
        .when(too_long("projects", {"name": "_new_name", "status": "_new_status"}), "error_too_long")
        .when(unchanged, "noop").otherwise("ok"))
    return joined.withColumn("_outcome", outcome)


def project_patch(projects: DataFrame, patches: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Patches: seq, project_id, user_id, patch (a JSON object; only the keys it holds are set).

    Type and metadata are validated together as they would be stored. Each patch would be
    validated against what earlier ones left behind, so one patch per project and owner is
    applied per batch and later ones come out as ``deferred``.
    """
    keys = ["project_id", "user_id"]
    firsts = _first_patches(patches, keys)
    hit = projects.join(firsts.withColumnRenamed("project_id", "id"), ["id", "user_id"], "left")
    judged = _patched_project(hit)
    apply = F.col("_first").isNotNull() & (F.col("_outcome") == "ok")
    changes = {column: F.when(apply, F.col(f"_new_{column}")).otherwise(F.col(column)) for column in PATCHABLE.values()}
    changes["updated_at"] = F.when(apply, as_of).otherwise(F.col("updated_at"))
    table = _replace(judged, projects.columns, changes)

    # Only patched projects reach the second join, so this side stays as small as the batch.
    verdicts = _patched_project(
        projects.join(firsts.withColumnRenamed("project_id", "id"), ["id", "user_id"])
    ).select(F.col("id").alias("project_id"), "user_id", "_first", "_outcome")
    outcomes = attach(patches, verdicts, keys, "left").select(
        "seq", *keys,
        F.when(F.col("_first").isNull(), "not_found")
        .when(F.col("seq") == F.col("_first"), F.col("_outcome")).otherwise("deferred").alias("outcome"))
    return table, with_code(outcomes)


def _patched_user(joined: DataFrame) -> DataFrame:
    joined = joined.withColumns({
        "_set": R.json_keys(F.col("patch")), "_value": F.get_json_object("patch", "$.full_name")})
    name = F.col("full_name")
    joined = joined.withColumn(
        "_new_name", F.when(R.has_key(F.col("_set"), "full_name"), F.col("_value")).otherwise(name))
    return joined.withColumn("_outcome", (
        F.when(F.col("_set").isNull() | wrongly_typed(F.col("patch"), F.col("_set"), {"full_name": STRING}), "unprocessable")
        .when(F.col("_new_name").isNull(), "error_not_null")
        .when(too_long("users", {"full_name": "_new_name"}), "error_too_long")
        .when(F.col("_new_name").eqNullSafe(name), "noop").otherwise("ok")))


def user_patch(users: DataFrame, patches: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Patches: seq, user_id, patch; only ``full_name`` can be set. Later patches are deferred."""
    firsts = _first_patches(patches, ["user_id"]).withColumnRenamed("user_id", "id")
    apply = F.col("_first").isNotNull() & (F.col("_outcome") == "ok")
    table = _replace(_patched_user(users.join(firsts, "id", "left")), users.columns, {
        "full_name": F.when(apply, F.col("_new_name")).otherwise(F.col("full_name")),
        "updated_at": F.when(apply, as_of).otherwise(F.col("updated_at"))})

    verdicts = _patched_user(users.join(firsts, "id")).select(
        F.col("id").alias("user_id"), "_first", "_outcome")
    outcomes = attach(patches, verdicts, ["user_id"], "left").select(
        "seq", "user_id",
        F.when(F.col("_first").isNull(), "not_found")
        .when(F.col("seq") == F.col("_first"), F.col("_outcome")).otherwise("deferred").alias("outcome"))
    return table, with_code(outcomes)


# --- deleting ----------------------------------------------------------------------------------

def project_delete(projects: DataFrame, files: DataFrame, requests: DataFrame
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests: seq, project_id, user_id. Gives projects, files and outcomes.

    Only the owner deletes a project; its files go with it. A repeated request finds nothing.
    """
    keys = ["project_id", "user_id"]
    asked = requests.groupBy(*keys).agg(F.min("seq").alias("_first"))
    owned = (projects.select(F.col("id").alias("project_id"), "user_id")
             .join(asked, keys).select(*keys, "_first"))
    left = projects.join(asked.withColumnRenamed("project_id", "id"), ["id", "user_id"], "left_anti")
    files_left = without_listed(files, owned.select("project_id"), ["project_id"], MANY_BITS)
    outcomes = attach(requests, owned, keys, "left").select(
        "seq", *keys,
        F.when(F.col("seq") == F.col("_first"), "deleted").otherwise("not_found").alias("outcome"))
    return left.select(*projects.columns), files_left.select(*files.columns), with_code(outcomes)


def user_deactivate(users: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Requests: seq, user_id. The row stays, inactive; an unknown user is a 400, an id of several users a 500."""
    known = counted(users.withColumnRenamed("id", "user_id"), ["user_id"])
    asked = _meant(requests, known, ["user_id"]).withColumnRenamed("user_id", "id").withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    changed = hit & ~F.col("is_active").eqNullSafe(F.lit(False))
    table = _replace(users.join(asked, "id", "left"), users.columns, {
        "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")),
        "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at"))})
    outcomes = attach(requests, known, ["user_id"], "left").select("seq", "user_id", guarded(400, F.lit(204)).alias("code"))
    return table, outcomes


def user_cascade_delete(users: DataFrame, projects: DataFrame, files: DataFrame, requests: DataFrame
                        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes users, their projects and the files of those. Requests: user_id."""
    gone = requests.select("user_id").distinct()
    users_left = users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti")
    # Only users that exist have projects to lose.
    known_gone = gone.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    projects_left = attach(projects, known_gone, ["user_id"], "left_anti")
    projects_gone = attach(projects, known_gone, ["user_id"], "left_semi").select(F.col("id").alias("project_id"))
    files_left = without_listed(files, projects_gone, ["project_id"], MANY_BITS)
    return (users_left.select(*users.columns), projects_left.select(*projects.columns),
            files_left.select(*files.columns))


def delete_manifest(listing: DataFrame, requests: DataFrame, batch_size: int = 1000) -> DataFrame:
    """Objects below the requested projects (user_id, project_id), in key order and batches.

    The prefix is ``{user}/projects/{project}/``, so keys of that shape are joined by equality of
    their user and project parts. Deleting is left to the caller; a single
    object is the case of one key.
    """
    if batch_size <= 0:
        raise ValueError(f"batch_size must be at least 1, got {batch_size}")
    parted = listing.where(K.in_project(F.col("key"))).select(
        K.key_user(F.col("key")).alias("user_id"), K.key_project(F.col("key")).alias("project_id"), "key")
    asked = requests.select("user_id", "project_id").distinct()
    below = attach(parted, asked, ["user_id", "project_id"], "left_semi")
    ranked = split_rank(below, ["user_id", "project_id"], {"key": False})
    return ranked.select("user_id", "project_id", F.expr(f"(rn - 1) div {batch_size}").alias("batch"), "key")


# --- starting runs -----------------------------------------------------------------------------

def run_transition(projects: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Requests: seq, project_id, user_id. Owned projects become ``processing``, whatever they were; a request that
    names several rows is a 500 and changes none."""
    keys = ["project_id", "user_id"]
    known = counted(projects.withColumnRenamed("id", "project_id"), keys)
    asked = _meant(requests, known, keys).withColumnRenamed("project_id", "id").withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    changed = hit & ~F.col("status").eqNullSafe(F.lit("processing"))
    table = _replace(projects.join(asked, ["id", "user_id"], "left"), projects.columns, {
        "status": F.when(hit, F.lit("processing")).otherwise(F.col("status")),
        "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at"))})
    outcomes = attach(requests, known, keys, "left").select("seq", *keys, guarded(404, F.lit(200)).alias("code"))
    return table, outcomes
