"""Guarded SQL: any read-only query over declared tables, checked on Spark's own parse of it and run on governed views."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.errors import ParseException
from pyspark.errors.exceptions.base import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import Refusal
from tessera.plans.contract import Contract
from tessera.plans.semantic_plan import clamp

#: Statements that change something, wherever the word stands.
MUTATING = ("insert", "update", "delete", "drop", "alter", "truncate", "create", "grant", "revoke", "copy", "merge")
#: Functions that a query may use: pure ones over the rows it reads.
ALLOWED = frozenset("""
    any any_value approx_count_distinct array_agg avg bool_and bool_or collect_list collect_set corr count count_if covar_pop covar_samp every first first_value grouping grouping_id last last_value
    max max_by mean median min min_by mode percentile percentile_approx percentile_cont percentile_disc some std stddev stddev_pop stddev_samp sum try_avg try_sum var_pop var_samp variance
    cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    abs between bround cbrt ilike like ceil ceiling cos degrees div e exp floor greatest hypot least ln log log10 log2 mod negative pi pmod positive pow power radians round sign signum sin sqrt tan try_add try_divide try_multiply try_subtract width_bucket
    ascii btrim char_length character_length concat concat_ws contains endswith format_number initcap instr lcase left length levenshtein locate lower lpad ltrim octet_length overlay position regexp_count regexp_extract regexp_like
    regexp_replace replace reverse right rlike rpad rtrim split split_part startswith substr substring substring_index translate trim ucase upper
    add_months cast date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear extract hour last_day make_date minute month months_between next_day quarter second timestamp to_date to_timestamp
    trunc unix_date weekday weekofyear year
    coalesce if ifnull isnotnull isnull nanvl nullif nvl nvl2 when
    array array_contains array_distinct array_join array_max array_min array_position array_size cardinality element_at explode explode_outer get_json_object json_array_length map_keys map_values named_struct posexplode size sort_array struct
""".split())  # fmt: skip
#: Functions whose names say why they are refused: they reach outside the data or wait.
FORBIDDEN = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user version uuid raise_error assert_true sleep pg_sleep pg_read_file dblink lo_import lo_export read_csv read_parquet read_json read_files current_setting set_config".split())
#: Parts of parsed plans that only read.
_READING = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Join Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases WithWindowDefinition OneRowRelation UnresolvedInlineTable Generate UnresolvedHaving LateralJoin Pivot UnresolvedPivot Unpivot UnresolvedHint Tail Sample UnresolvedTVFAliases ResolvedInlineTable LocalRelation UnresolvedOrderBy".split())


def _seq(seq) -> Iterator[Any]:
    return (seq.apply(k) for k in range(seq.size()))


class ParsedQuery:
    """What a parsed plan refers to: relations (common table expressions taken out), functions, kinds of nodes, filters."""

    def __init__(self, spark: SparkSession, sql: str):
        try:
            self.plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            if isinstance(e, ParseException) or "ParseException" in type(e).__name__ or "ParseException" in str(e):
                raise Refusal("sql_parse_failed", str(e).strip().splitlines()[0][:300]) from None
            raise
        self.relations: set[str] = set()
        self.names: set[str] = set()
        self.functions: set[str] = set()
        self.kinds: set[str] = set()
        self._walk(self.plan, frozenset())

    def _walk(self, node, ctes: frozenset) -> None:
        kind = node.getClass().getSimpleName()
        self.kinds.add(kind)
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                self._walk(pair._2(), ctes)
                ctes = ctes | {pair._1().lower()}
        if kind == "UnresolvedRelation":
            parts = list(_seq(node.multipartIdentifier()))
            if len(parts) > 1 or parts[0].lower() not in ctes:
                self.relations.add(".".join(parts))
        for e in _seq(node.expressions()):
            self._expression(e, ctes)
        for child in _seq(node.children()):
            self._walk(child, ctes)

    def _expression(self, e, ctes: frozenset) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.functions.add(e.nameParts().apply(e.nameParts().size() - 1).lower())
        elif kind == "UnresolvedAttribute":
            self.names.add(e.nameParts().apply(e.nameParts().size() - 1).lower())
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self._walk(e.plan(), ctes)
        elif kind == "InSubquery":
            self._walk(e.query().plan(), ctes)
        for child in _seq(e.children()):
            self._expression(child, ctes)


def check(spark: SparkSession, contract: Contract, sql: str) -> ParsedQuery:
    """Raise a refusal unless sql is one read-only query over declared tables.

    Reads the parsed plan, so words in literals, comments and column names don't matter, and names of common table
    expressions aren't tables. Statements that Spark's parser doesn't take for queries are told apart by their first word.
    """
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL).strip()
    head = re.match(r"\(*\s*([A-Za-z]+)", bare)
    word = head[1].lower() if head else ""
    if word in MUTATING:
        raise Refusal("mutating_sql", word)
    if word not in ("select", "with"):
        raise Refusal("not_read_only_select", word or "no statement")
    parsed = ParsedQuery(spark, sql)
    if odd := sorted(k for k in parsed.kinds if k not in _READING):
        raise Refusal("mutating_sql" if any("Insert" in k or "Command" in k for k in odd) else "not_read_only_select", ", ".join(odd))
    if found := sorted(parsed.functions & FORBIDDEN) or sorted(parsed.functions - ALLOWED):
        raise Refusal("forbidden_function", ", ".join(found))
    if not parsed.relations:
        raise Refusal("no_table_source", "the query reads no table")
    owners = contract.owners()
    if unknown := sorted(r for r in parsed.relations if r not in owners):
        raise Refusal("table_not_allowed", ", ".join(unknown), tables=sorted(owners), relations=contract.data["relations"])
    return parsed


def _without_exclusions(spark: SparkSession, contract: Contract, parsed: ParsedQuery, sql: str) -> list[str]:
    """Exclusions that the text itself doesn't state (they are in force through the views all the same)."""
    out = []
    for t in sorted(parsed.relations):
        for x in contract.exclusions(t):
            value = re.escape(str(x["value"]))
            if not re.search(rf"\b{re.escape(x['column'])}\b\s*(?:!=|<>)\s*'{value}'", sql, re.IGNORECASE):
                out.append(x["field_id"])
    return out


def guarded_sql(spark: SparkSession, contract: Contract, sql: str, limit: int | None = None, strict: bool = False, citation_mode: str = "exploratory", purpose: str | None = None, most: int = 100) -> tuple[DataFrame, dict[str, Any]]:
    """(result, facts) of a guarded query.

    It runs on views with the declared columns alone, without excluded rows, so neither SELECT * nor an alias reaches
    more. ``strict`` also refuses (missing_global_exclusion) a text that doesn't state an exclusion. Claim-supporting
    queries need a purpose. limit is 1 to ``most``, 50 by default.
    """
    contract.require_valid()
    if citation_mode not in ("exploratory", "claim_support"):
        raise Refusal("unknown_citation_mode", citation_mode)
    if citation_mode == "claim_support" and not purpose:
        raise Refusal("purpose_required", "claim-supporting SQL needs a purpose")
    parsed = check(spark, contract, sql)
    unstated = _without_exclusions(spark, contract, parsed, sql)
    if strict and unstated:
        raise Refusal("missing_global_exclusion", ", ".join(unstated))
    owners = {contract.owners()[t] for t in parsed.relations}
    if len(owners) > 1:
        raise Refusal("single_query_spans_sources", ", ".join(sorted(owners)))
    session = spark.newSession()  # views of this request alone
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for t in parsed.relations:
        contract.table(session, t).createOrReplaceTempView(t)
    try:
        df = session.sql(sql)
        df.schema  # noqa: B018  analysis happens here
    except AnalysisException as e:
        text = str(e)
        code = "column_not_allowed" if "UNRESOLVED_COLUMN" in text else "forbidden_function" if "UNRESOLVED_ROUTINE" in text else "sql_parse_failed"
        raise Refusal(code, text.strip().splitlines()[0][:300]) from None
    fields = contract.data["tables"]
    named = sorted({fields[t]["columns"][c] for t in parsed.relations for c in fields[t]["columns"] if c.lower() in parsed.names})
    facts = {
        "tables": sorted(parsed.relations), "fields": named, "joins": "Join" in parsed.kinds, "aggregates": sorted(parsed.functions & {"sum", "avg", "count", "min", "max"}),
        "exclusions": [x["field_id"] for t in sorted(parsed.relations) for x in contract.exclusions(t)], "citation_mode": citation_mode, "purpose": purpose, "may_support_claims": citation_mode == "claim_support",
    }
    return df.limit(clamp(limit, most, 50)), facts
