"""Access review: who holds which role, and what it lets them do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.access import collect_groups, resolve_actor, resolve_role

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Which role may use which endpoint.
MATRIX = [
    ("inference", "operator", True),
    ("inference", "auditor", False),
    ("audit_list", "operator", True),
    ("audit_list", "auditor", True),
    ("audit_export", "operator", False),
    ("audit_export", "auditor", True),
]
# ---------------------------------------------------------------------------


def access_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATRIX, "endpoint string, role string, permitted boolean")


def review_claims(claims: DataFrame, operator_groups: list[str], auditor_groups: list[str]) -> DataFrame:
    """Add ``all_groups``, ``role`` and ``actor`` to a claims table."""
    return (
        claims.withColumn("all_groups", collect_groups(F.col("groups"), F.col("realm_access.roles")))
        .withColumn("role", resolve_role(F.col("all_groups"), operator_groups, auditor_groups))
        .withColumn("actor", resolve_actor(F.col("email"), F.col("preferred_username"), F.col("sub")))
    )


def access_decision(events: DataFrame, matrix: DataFrame, *, role_keys_with_tokens: bool = False) -> DataFrame:
    """Add ``status`` to access events of ``endpoint``, ``credential`` and ``role``.

    ``credential`` is ``none``, ``invalid``, ``token`` or ``key``.  No or a bad
    credential is 401; a known one without a permitted role is 403.  Where tokens
    are in use as well (``role_keys_with_tokens``), a shared key of the wrong
    role is answered with 401.  The matrix is joined as its size suggests.
    """
    allowed = matrix.where("permitted").select("endpoint", "role", F.lit(True).alias("__ok"))
    ok = F.coalesce("__ok", F.lit(False))
    wrong_key = (F.col("credential") == "key") & F.lit(role_keys_with_tokens)
    status = (
        F.when(F.col("credential").isin("none", "invalid") | F.col("credential").isNull(), F.lit(401))
        .when(ok, F.lit(200))
        .when(wrong_key, F.lit(401))
        .otherwise(F.lit(403))
    )
    return (
        events.join(allowed, ["endpoint", "role"], "left")
        .withColumn("status", status)
        .select(*events.columns, "status")
    )
