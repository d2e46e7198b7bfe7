"""Outcomes of requests made with access and refresh tokens, from their decoded claims.

Claims: event_id, sub, token_type, expired (also set for tokens that could not be verified).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import tokens as T
from tallyloom.operators.joins import attach
from tallyloom.operators.lookup import AMBIGUOUS, counted


def _resolve(claims: DataFrame, users: DataFrame, early: Column, late: Column) -> DataFrame:
    """``early`` decides without the user or is NULL; only the undecided rows are joined. A ``sub`` that several
    users have is a 500.

    So rows without ``sub`` do not meet in one partition on a NULL key.
    """
    judged = claims.withColumn("_early", early)
    decided = judged.where("_early is not null").select(*claims.columns, F.col("_early").alias("code"))
    known = counted(users.select(F.col("id").alias("sub"), F.coalesce("is_active", F.lit(False)).alias("_flag")), ["sub"], {"_flag": "_active"})
    asked = attach(judged.where("_early is null").drop("_early"), known, ["sub"], "left")
    late = F.when(F.col("_n") > 1, AMBIGUOUS).otherwise(late)
    return decided.unionByName(asked.select(*claims.columns, late.alias("code"))).withColumn(
        "code", F.col("code").cast("bigint"))


def access_outcomes(claims: DataFrame, users: DataFrame) -> DataFrame:
    """401 for a bad token, a wrong type or an unknown user; 400 for an inactive user; else 200."""
    early = F.when(F.col("expired") | F.col("sub").isNull()
                   | ~F.col("token_type").eqNullSafe(F.lit("access")), 401)
    late = F.when(F.col("_active").isNull(), 401).when(~F.col("_active"), 400).otherwise(200)
    return _resolve(claims, users, early, late)


def refresh_outcomes(claims: DataFrame, users: DataFrame) -> DataFrame:
    """401 for a bad token, then 400 for a wrong type, 401 for an unknown or inactive user; else 200."""
    early = (F.when(F.col("expired"), 401)
             .when(~F.col("token_type").eqNullSafe(F.lit("refresh")), 400)
             .when(F.col("sub").isNull(), 401))
    late = F.when(F.coalesce("_active", F.lit(False)), 200).otherwise(401)
    return _resolve(claims, users, early, late)


def token_expiry(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Adds expiry and ``expired`` to issued tokens (token_type, issued_at)."""
    expiring = tokens.withColumn("expires_at", T.expires_at(F.col("token_type"), F.col("issued_at")))
    return expiring.withColumn("expired", T.is_expired(F.col("expires_at"), as_of))
