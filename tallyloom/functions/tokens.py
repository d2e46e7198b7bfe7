"""Token lifetimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token lifetimes.
ACCESS_LIFETIME = "INTERVAL 60 MINUTES"
REFRESH_LIFETIME = "INTERVAL 7 DAYS"


def expires_at(token_type: Column, issued_at: Column) -> Column:
    """NULL for a type that is never issued."""
    return (F.when(token_type == "access", issued_at + F.expr(ACCESS_LIFETIME))
            .when(token_type == "refresh", issued_at + F.expr(REFRESH_LIFETIME)))


def is_expired(expiry: Column, as_of: Column) -> Column:
    """Tokens carry whole seconds, and one is still good in the second in which it expires."""
    return F.date_trunc("second", expiry) < F.date_trunc("second", as_of)
