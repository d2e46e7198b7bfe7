"""The registered queries: each operator over the fixtures, by name."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import access, audits, documents, joins, lookup, merges, paging, progress
from tallyloom.plans.fixtures import STATEMENTS, fixture
from tallyloom.session import cut_lineage, remove_folder, shared_folder
from tallyloom.streaming import progress as stream

Query = Callable[[SparkSession, str], DataFrame]

# Latest means last by time; the id tells apart results of the same moment.
LATEST = ["ts", "event_id"]

AS_OF = "2024-01-30 00:00:00"

# Page parameters of the registered paging queries.
SKIP, LIMIT = 2, 5
DEEP_SKIP, DEEP_LIMIT = 3, 2000
ONE_OWNER = "u000000000001"

# Records that a source must give; some of the test tables' sources do not.
MIN_SAMPLES = 350

# So small that batches split on the test tables, too.
BATCH_SIZE = 4


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


PROJECT_FIELDS = ["name", "execution_type", "status", "metadata", "created_at"]
USER_FIELDS = ["full_name", "is_active"]


class _Inputs:
    """Fixtures by attribute: ``_Inputs(spark, folder).users``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self._spark, self._folder, name)

    def all(self) -> dict[str, DataFrame]:
        return {"users": self.users, "projects": self.projects, "project_files": self.files}


# Parts that the events arrive in, each as files of its own.
ARRIVALS = 4


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """Runs the results of the events table through the streaming operator to its end.

    The events arrive in parts, in order of time. Each is written by as many tasks as read the table, then the stream
    goes on from its state until that part is used up.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    base = os.path.join(shared_folder(spark), f"step-results-{uuid.uuid4().hex}")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    bounds = [first + (last - first) * k / ARRIVALS for k in range(1, ARRIVALS)] if first is not None else []
    arrival = reduce(Column.__add__, [(F.col("ts") > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    for number in range(ARRIVALS):
        events.where(F.coalesce(arrival, F.lit(0)) == number).write.parquet(f"{base}/in/{number}")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/in/*")
        latest = stream.latest_step_results(_stream_results(arriving), LATEST)
        stream.write_stream(latest, f"{base}/rows", f"{base}/state").awaitTermination()
    rows = cut_lineage(spark.read.schema(latest.schema).parquet(f"{base}/rows"))
    remove_folder(spark, base)
    return _as_ntz(rows, ["window_start", "window_end", "ts"])


def _stream_results(events: DataFrame) -> DataFrame:
    """The results fixture over a stream; event time must be a TIMESTAMP, read as UTC."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        raise ValueError("the events' times are UTC: set spark.sql.session.timeZone to UTC, as build_session does")
    results = spark.sql(STATEMENTS["results"], events=events)
    return results.withColumn("ts", F.col("ts").cast("timestamp"))


def _as_ntz(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _on(build: Callable[[_Inputs], DataFrame]) -> Query:
    return lambda spark, folder: build(_Inputs(spark, folder))


QUERIES: dict[str, Query] = {
    # Lookups, views and keys
    "project_lookup": _on(lambda t: lookup.project_lookup(t.project_requests, t.projects, PROJECT_FIELDS)),
    "user_by_id": _on(lambda t: lookup.user_by_id(t.user_requests, t.users, ["email", *USER_FIELDS])),
    "user_by_email": _on(lambda t: lookup.user_by_email(
        t.email_requests, t.users.withColumnRenamed("id", "user_id"), ["user_id", *USER_FIELDS])),
    "lookup_ambiguity": _on(lambda t: lookup.lookup_ambiguity(t.users, "email")),
    "download_key_audit": _on(lambda t: lookup.download_key_audit(t.downloads, t.projects)),
    "user_view": _on(lambda t: lookup.user_view(t.users)),
    "project_view": _on(lambda t: lookup.project_view(t.projects)[0]),
    "project_view_rejects": _on(lambda t: lookup.project_view(t.projects)[1]),
    "file_view": _on(lambda t: lookup.file_view(t.files)),
    "object_keys": _on(lambda t: lookup.object_keys(t.files, t.projects)),
    "object_key_parts": _on(lambda t: lookup.object_key_parts(t.objects)),
    "upload_keys": _on(lambda t: lookup.upload_keys(t.uploads, t.projects)),
    "object_listing": _on(lambda t: lookup.object_listing(t.folder_requests, t.projects, t.nested_objects)),
    "object_listing_outcomes": _on(lambda t: lookup.object_listing_outcomes(t.folder_requests, t.projects)),
    # Relationships
    "project_owner": _on(lambda t: joins.project_owner(t.projects, t.users)),
    "user_projects": _on(lambda t: joins.user_projects(t.users, t.projects)),
    "project_files_join": _on(lambda t: joins.project_files_join(t.projects, t.files)),
    # Counts and pages
    "project_count_by_owner": _on(lambda t: paging.project_count_by_owner(t.users, t.projects)),
    "project_num_files": _on(lambda t: paging.project_num_files(t.projects, t.files)),
    "project_page_one_owner": _on(lambda t: paging.project_page_one_owner(t.projects, ONE_OWNER, SKIP, LIMIT).select(
        "id", "user_id", "name", "status", "created_at")),
    "project_page_all_owners": _on(lambda t: paging.project_page_all_owners(t.projects, SKIP, LIMIT).select(
        "user_id", "rn", "id", "name", "created_at")),
    "project_page_deep": _on(lambda t: paging.project_page_all_owners(t.projects, DEEP_SKIP, DEEP_LIMIT).select(
        "user_id", "rn", "id", "name", "created_at")),
    "project_page_envelope": _on(lambda t: paging.project_page_envelope(t.users, t.projects, 10, 10)),
    # Rules and constraints
    "metadata_validation": _on(lambda t: audits.metadata_validation(t.projects)),
    "metadata_error_counts": _on(lambda t: audits.metadata_error_counts(t.projects)),
    "fk_orphans": _on(lambda t: audits.fk_orphans(t.all())),
    "column_rule_violations": _on(lambda t: (
        audits.column_rule_violations(t.users, "users")
        .unionByName(audits.column_rule_violations(t.raw_projects, "projects"))
        .unionByName(audits.column_rule_violations(t.files, "project_files")))),
    "unique_violations": _on(lambda t: audits.unique_violations(t.all())),
    "email_format": _on(lambda t: audits.email_format(t.users)),
    # Writes: the outcomes, then the new tables
    "project_create": _on(lambda t: merges.project_create(t.projects, t.create_requests, as_of())[1]),
    "project_create_table": _on(lambda t: merges.project_create(t.projects, t.create_requests, as_of())[0]),
    "user_upsert": _on(lambda t: merges.user_upsert(t.users, t.profiles, as_of())[1]),
    "user_upsert_table": _on(lambda t: merges.user_upsert(t.users, t.profiles, as_of())[0]),
    "project_patch": _on(lambda t: merges.project_patch(t.projects, t.patches, as_of())[1]),
    "project_patch_table": _on(lambda t: merges.project_patch(t.projects, t.patches, as_of())[0]),
    "user_patch": _on(lambda t: merges.user_patch(t.users, t.user_patches, as_of())[1]),
    "user_patch_table": _on(lambda t: merges.user_patch(t.users, t.user_patches, as_of())[0]),
    "project_delete": _on(lambda t: merges.project_delete(t.projects, t.files, t.delete_requests)[2]),
    "project_delete_table": _on(lambda t: merges.project_delete(t.projects, t.files, t.delete_requests)[0]),
    "project_delete_files": _on(lambda t: merges.project_delete(t.projects, t.files, t.delete_requests)[1]),
    "user_deactivate": _on(lambda t: merges.user_deactivate(t.users, t.user_requests, as_of())[1]),
    "user_deactivate_table": _on(lambda t: merges.user_deactivate(t.users, t.user_requests, as_of())[0]),
    "user_cascade_delete": _on(lambda t: merges.user_cascade_delete(t.users, t.projects, t.files, t.user_requests)[0]),
    "user_cascade_delete_projects": _on(
        lambda t: merges.user_cascade_delete(t.users, t.projects, t.files, t.user_requests)[1]),
    "user_cascade_delete_files": _on(
        lambda t: merges.user_cascade_delete(t.users, t.projects, t.files, t.user_requests)[2]),
    "delete_manifest": _on(lambda t: merges.delete_manifest(t.objects, t.project_requests, BATCH_SIZE)),
    "run_transition": _on(lambda t: merges.run_transition(t.projects, t.project_requests, as_of())[1]),
    "run_transition_table": _on(lambda t: merges.run_transition(t.projects, t.project_requests, as_of())[0]),
    # Access
    "access_outcomes": _on(lambda t: access.access_outcomes(t.claims, t.users)),
    "refresh_outcomes": _on(lambda t: access.refresh_outcomes(t.claims, t.users)),
    "token_expiry": _on(lambda t: access.token_expiry(t.tokens, as_of())),
    # Runs
    "stage_plan": _on(lambda t: progress.stage_plan(t.projects)),
    "latest_step_result": _on(lambda t: progress.latest_step_result(t.results, LATEST)),
    "step_status_json": _on(lambda t: progress.step_status_json(t.results, LATEST)),
    "project_outcome": _on(lambda t: progress.project_outcome(t.projects, t.results, LATEST)),
    "retained_results": _on(lambda t: progress.retained_results(t.results, as_of())),
    "step_results_stream": _stream,
    # The work of the run steps
    "document_verdicts": _on(lambda t: documents.document_verdicts(t.documents)),
    "validation_report": _on(lambda t: documents.validation_report(t.documents)),
    "page_text": _on(lambda t: documents.page_text(t.pages)),
    "page_titles": _on(lambda t: documents.page_titles(t.pages)),
    "document_chunks": _on(lambda t: documents.document_chunks(t.documents)),
    "chunk_stats": _on(lambda t: documents.chunk_stats(t.documents)),
    "dataset_records": _on(lambda t: documents.dataset_records(t.documents)),
    "min_samples_gate": _on(lambda t: documents.min_samples_gate(t.documents, MIN_SAMPLES)),
    "chat_samples": _on(lambda t: documents.chat_samples(t.conversations)),
    "raw_page_text": _on(lambda t: documents.page_text(t.raw_pages)),
    "raw_page_titles": _on(lambda t: documents.page_titles(t.raw_pages)),
    "submitted_verdicts": _on(lambda t: documents.document_verdicts(t.raw_documents)),
    "submitted_records": _on(lambda t: documents.dataset_records(t.raw_documents)),
    "submitted_gate": _on(lambda t: documents.min_samples_gate(t.raw_documents, MIN_SAMPLES)),
    "logged_chat_samples": _on(lambda t: documents.chat_samples(t.raw_turns)),
}

