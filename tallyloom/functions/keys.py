"""Object keys: ``{user}/projects/{project}/{folder}/{filename}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_prefix(user_id: Column, project_id: Column) -> Column:
    return F.concat(user_id, F.lit("/projects/"), project_id, F.lit("/"))


def folder_prefix(user_id: Column, project_id: Column, folder: Column) -> Column:
    return F.concat(project_prefix(user_id, project_id), folder, F.lit("/"))


def object_key(user_id: Column, project_id: Column, folder: Column, filename: Column) -> Column:
    """``concat`` gives NULL for a NULL part, where ``concat_ws`` would give a wrong key."""
    return F.concat(folder_prefix(user_id, project_id, folder), filename)


def has_key_layout(key: Column) -> Column:
    return key.rlike("^[^/]+/projects/[^/]+/[^/]+/")


def in_project(key: Column) -> Column:
    """Whether the key is below some project, be it in a folder or not."""
    return key.rlike("^[^/]+/projects/[^/]+/")


# The parts below hold for keys that pass the tests above.

def key_user(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def key_project(key: Column) -> Column:
    return F.substring_index(F.substring_index(key, "/", 3), "/", -1)


def key_folder(key: Column) -> Column:
    return F.substring_index(F.substring_index(key, "/", 4), "/", -1)


def key_filename(key: Column) -> Column:
    """Everything behind the folder; it may itself hold slashes."""
    return F.substring(key, F.length(F.substring_index(key, "/", 4)) + 2, F.length(key))


def key_folders(key: Column) -> Column:
    """Every folder the key is in, from the top one down: ``a`` and ``a/b`` for a file ``a/b/c``.

    NULL for a key that is in no folder. The common case of one level needs no splitting.
    """
    below = F.split(F.substring(key, F.length(F.substring_index(key, "/", 3)) + 2, F.length(key)), "/")
    nested = F.transform(
        F.sequence(F.lit(1), F.size(below) - 1), lambda depth: F.array_join(F.slice(below, 1, depth), "/"))
    return F.when(key.rlike("^([^/]*/){4}[^/]*$"), F.array(key_folder(key))).when(key.rlike("^([^/]*/){5}"), nested)
