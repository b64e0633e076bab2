"""Roles and actors from identity claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_GROUPS = "array<string>"


def collect_groups(groups: Column, realm_roles: Column) -> Column:
    """Direct groups followed by realm roles; a missing list counts as empty."""
    empty = F.array().cast(NO_GROUPS)
    return F.concat(F.coalesce(groups, empty), F.coalesce(realm_roles, empty))


def resolve_role(groups: Column, operator_groups: list[str], auditor_groups: list[str]) -> Column:
    """``operator`` before ``auditor``; null when no group is known."""
    named = lambda names: F.array(*[F.lit(n) for n in names]).cast(NO_GROUPS)
    return F.when(F.arrays_overlap(groups, named(operator_groups)), F.lit("operator")).when(
        F.arrays_overlap(groups, named(auditor_groups)), F.lit("auditor")
    )


def resolve_actor(email: Column, preferred_username: Column, sub: Column) -> Column:
    return F.coalesce(email, preferred_username, sub)
