"""Access: roles that gate requests, masks that follow columns by lineage, and policies."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from fnmatch import fnmatchcase
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.errors import Refusal

MASK = "***MASKED***"


def require_tool(roles: Mapping[str, Any] | None, role: str | None, tool: str) -> None:
    """Without a role or a roles block everything is open; an unknown role and a tool that isn't granted are refused."""
    if role is None or not roles:
        return
    if role not in roles:
        raise Refusal("role_not_recognized", role)
    tools = roles[role].get("tools") or ()
    if "*" not in tools and tool not in tools:
        raise Refusal("role_not_permitted", f"{role}: {tool}")


class Masking:
    """Sensitive fields, roles that see them, and the token that others see."""

    def __init__(self, sensitive: Sequence[str] = (), unmasked_roles: Sequence[str] = (), token: str = MASK):
        self.sensitive, self.unmasked, self.token = tuple(sensitive), frozenset(unmasked_roles), token

    def applies(self, role: str | None) -> bool:
        return bool(self.sensitive) and role is not None and role not in self.unmasked

    def table(self, df: DataFrame, source: str, table: str, role: str | None, keys: Collection[str] = ()) -> DataFrame:
        """The governed table with its sensitive columns replaced, nulls too. Being masked at the scan, a column stays
        masked under any alias, filter or expression, and its values never leave the source.

        Text becomes the token. Other types become null, so that expressions keep their types; so do ``keys``, columns
        that relations use: as a token they would join every row with every other."""
        if not self.applies(role):
            return df
        columns = [f.split(".")[2] for f in self.sensitive if f.split(".")[:2] == [source, table]]
        made = {c: F.lit(self.token) if isinstance(df.schema[c].dataType, StringType) and c not in keys else F.lit(None).cast(df.schema[c].dataType) for c in columns if c in df.columns}
        return df.withColumns(made)

    def result(self, df: DataFrame, role: str | None) -> DataFrame:
        """A finished result masked by column names, with or without a left_ or right_ prefix."""
        if not self.applies(role):
            return df
        names = {f.split(".")[2] for f in self.sensitive}
        return df.withColumns({c: F.lit(self.token) for c in df.columns if c.removeprefix("left_").removeprefix("right_") in names})


def _matches(value: str, pattern: str | None) -> bool:
    return pattern in (None, "*") or fnmatchcase(value, pattern)


def decide(rules: Sequence[Mapping[str, Any]], request: Mapping[str, str]) -> dict[str, Any]:
    """The first rule that matches role, source, operation and metric decides; without one the request is allowed."""
    for r in rules:
        if all(_matches(str(request.get(k, "")), r.get(k)) for k in ("role", "source", "operation", "metric")):
            return {"allowed": r.get("effect", "deny") == "allow", "rule_id": r["id"]}
    return {"allowed": True, "rule_id": None}


def _like(value: Column, pattern: Column) -> Column:
    """Glob match of columns: * and ? as in file names."""
    escaped = F.regexp_replace(pattern, r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.rlike(value, F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))


def policy_matrix(requests: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """decide() for every row of requests (role, source, operation, metric): adds allowed and rule_id.

    The rules are one literal expression, so requests of any number are a map without a join."""
    rule, allowed = F.lit(None).cast("string"), F.lit(True)
    for r in reversed(rules):
        hit = F.lit(True)
        for k in ("role", "source", "operation", "metric"):
            if r.get(k) not in (None, "*"):
                hit &= _like(F.coalesce(F.col(k), F.lit("")), F.lit(r[k]))
        rule = F.when(hit, F.lit(r["id"])).otherwise(rule)
        allowed = F.when(hit, F.lit(r.get("effect", "deny") == "allow")).otherwise(allowed)
    return requests.withColumn("allowed", allowed).withColumn("rule_id", rule)


def governed_views(spark: SparkSession, contract, masking: Masking, role: str | None) -> dict[str, DataFrame]:
    """Every declared table with its rules and masks."""
    seen = contract.seen_by(masking, role)
    return {t: seen.table(spark, t) for t in contract.data["tables"]}
