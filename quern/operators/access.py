"""Who may see what: access contexts and the predicate that every retrieval carries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import trim

DEPARTMENTS = ("engineering", "finance", "hr")
MOST_CONTEXTS = 1000
ROLES = ("public", "admin", *DEPARTMENTS)


@dataclass(frozen=True)
class AccessContext:
    role: str
    tenant: str | None
    department: str | None

    @classmethod
    def of(cls, role: str | None, tenant: str | None) -> "AccessContext":
        role = (role or "").strip().lower()
        role = role if role in ROLES else "public"
        tenant = (tenant or "").strip() or (None if role == "admin" else "default")
        return cls(role, tenant, role if role in DEPARTMENTS else None)

    def predicate(self) -> Column:
        """Depends on the documents' columns only, so that it reaches their scan."""
        seen = F.lit(True) if self.role == "admin" else F.col("access_level") == "public"
        if self.department is not None:
            seen = seen | (F.col("department") == self.department)
        return seen if self.tenant is None else seen & (F.col("tenant_id") == self.tenant)


def with_contexts(df: DataFrame, role: str, tenant: str) -> DataFrame:
    """The same derivation for contexts in a table: adds role, tenant_id and department."""
    low = F.lower(trim(F.coalesce(F.col(role), F.lit(""))))
    df = df.withColumn("role", F.when(low.isin(*ROLES), low).otherwise("public"))
    asked = trim(F.coalesce(F.col(tenant), F.lit("")))
    return df.withColumn("tenant_id", F.when(asked != "", asked).when(F.col("role") != "admin", "default")).withColumn("department", F.when(F.col("role").isin(*DEPARTMENTS), F.col("role")))


def visible(contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """Context and document pairs that the predicate lets pass. Each pair is looked at, so the contexts are a few: more than
    MOST_CONTEXTS are an error."""
    if contexts.limit(MOST_CONTEXTS + 1).count() > MOST_CONTEXTS:
        raise ValueError(f"more than {MOST_CONTEXTS} access contexts")
    c, d = contexts.alias("c"), documents.alias("d")
    seen = (F.col("c.role") == "admin") | (F.col("d.access_level") == "public") | F.coalesce(F.col("d.department") == F.col("c.department"), F.lit(False))
    return d.join(F.broadcast(c), seen & (F.col("c.tenant_id").isNull() | (F.col("d.tenant_id") == F.col("c.tenant_id"))))


def admin_allowed(server_token: str | None, given: Column) -> Column:
    """Whether a request's token opens the administration. Digests are compared, so that the time says nothing of the token; where
    the server has no token, or a blank one, nothing opens it."""
    if not (server_token or "").strip():
        return F.lit(False)
    return F.coalesce(F.sha2(given, 256) == F.sha2(F.lit(server_token), 256), F.lit(False))
