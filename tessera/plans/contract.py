"""The semantic contract: what may be asked. Parsed from a Markdown text, validated, and identified by its content."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import TYPE_CHECKING, Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import Issue, Refusal
from tessera.functions.hashing import digest
from tessera.plans.roles import field_roles
from tessera.plans.rules import STATES, compile_rules, exclude, exclusions_of, split_state
from tessera.sources.registry import Sources

if TYPE_CHECKING:
    from tessera.operators.access import Masking

_FIELD = re.compile(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)\.([A-Za-z_]\w*)")


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.casefold()).strip("_")


def split_field(token: str) -> tuple[str, str, str] | None:
    """source, table and column of a field id, or None if it doesn't have exactly these parts."""
    m = _FIELD.fullmatch(token.strip())
    return m.groups() if m else None


def canonical_json(contract: Mapping[str, Any]) -> str:
    return json.dumps(contract, indent=2, sort_keys=True) + "\n"


class Item(NamedTuple):
    """A line of a section: its parts by the section's grammar (None where it doesn't fit), and a rule's lifecycle state."""

    section: str
    text: str
    parts: tuple[str, ...] | None
    state: str | None = None


def _pair(mark: str) -> Callable[[str], tuple[str, ...] | None]:
    def read(text: str) -> tuple[str, ...] | None:
        sides = [x.strip() for x in text.split(mark, 1 if mark == ":" else -1)]
        return tuple(sides) if len(sides) == 2 else None

    return read


def _field_line(text: str) -> tuple[str, ...] | None:
    token, description = _pair(":")(text) or ("", "")
    where = split_field(token)
    return (token, *where, description) if where else None


def _relation_line(text: str) -> tuple[str, ...] | None:
    sides = _pair("=")(text)
    return sides if sides and all(map(split_field, sides)) else None


#: Section -> grammar of its lines, and the code of one that doesn't fit.
GRAMMAR: dict[str, tuple[Callable[[str], tuple[str, ...] | None], str]] = {
    "metrics": (_pair(":"), "malformed_metric"), "rules": (lambda text: (text,), ""), "dimensions": (_field_line, "malformed_field_token"),
    "measures": (_field_line, "malformed_field_token"), "relations": (_relation_line, "malformed_relation"),
}


def _read(text: str) -> tuple[list[Item], bool, list[Issue]]:
    """Items, whether the rules have headings of their own, and issues of the text's form."""
    items, issues, sectioned, section, state = [], [], False, None, None
    for line in map(str.strip, text.splitlines()):
        marks = len(line) - len(line.lstrip("#"))
        if marks:
            name = line[marks:].strip().casefold()
            if marks == 1:
                section, state = name, None
                form = None if name in GRAMMAR else "unknown_section"
            else:
                inside = section == "rules"
                sectioned, state = sectioned or inside, name if inside and name in STATES else None
                form = "subsection_outside_rules" if not inside else None if state else "rule_status_unknown"
            if form:
                issues.append(Issue(form, f"contract:{section or ''}", name))
        elif line.startswith("- "):
            body = line[2:].strip()
            if section is None:
                issues.append(Issue("bullet_ignored", "contract:", body))
            elif section in GRAMMAR:
                items.append(Item(section, body, GRAMMAR[section][0](body), state))
    return items, sectioned, issues


def _sources_of(item: Item) -> list[str]:
    tokens = {"relations": item.parts, "dimensions": item.parts[:1], "measures": item.parts[:1]}.get(item.section, ())
    return [split_field(t)[0] for t in tokens]


def _repeated(values: Iterable[tuple[Any, str]], code: str, section: str) -> Iterator[Issue]:
    """Issues of the names that come again. values: (name, detail)."""
    seen = set()
    for name, detail in values:
        if name in seen:
            yield Issue(code, f"contract:{section}", detail)
        seen.add(name)


def _check_form(items: list[Item], known: set[str]) -> Iterator[Issue]:
    return (Issue(GRAMMAR[i.section][1], f"contract:{i.section}", i.text) for i in items if i.parts is None)


def _check_sources(items: list[Item], known: set[str]) -> Iterator[Issue]:
    return (Issue("unknown_source", f"contract:{i.section}", i.text) for i in items if i.parts and not known.issuperset(_sources_of(i)))


def _check_names(items: list[Item], known: set[str]) -> Iterator[Issue]:
    fields = [i for i in items if i.parts and i.section in ("dimensions", "measures")]
    yield from _repeated(((slug(i.parts[0]), i.parts[0]) for i in items if i.parts and i.section == "metrics"), "metric_id_collision", "metrics")
    yield from _repeated(((i.parts[0], i.parts[0]) for i in fields), "duplicate_field_id", "dimensions")
    owners: dict[str, str] = {}
    for i in fields:
        if owners.setdefault(i.parts[2], i.parts[1]) != i.parts[1]:
            yield Issue("table_in_multiple_sources", f"contract:{i.section}", i.parts[2])


#: Checks of all items together.
ITEM_CHECKS = (_check_form, _check_sources, _check_names)


def _declared(item: Item) -> dict[str, str]:
    _, source, table, column, description = item.parts
    made = {"source": source, "table": table, "column": column, "description": description}
    low = description.casefold()
    default = next((name for words, name in (("default sum", "sum"), ("default average", "avg")) if words in low), None)
    return {**made, "default_aggregation": default} if default and item.section == "measures" else made


def parse(text: str, sources: Iterable[str]) -> tuple[dict[str, Any], list[Issue]]:
    """Contract and issues of a text with ``# section`` headings and ``- `` items; items with an issue of form or source
    are left out."""
    known = set(sources)
    items, sectioned, issues = _read(text)
    issues += [issue for check in ITEM_CHECKS for issue in check(items, known)]
    good = [i for i in items if i.parts and known.issuperset(_sources_of(i))]
    of = lambda section: [i for i in good if i.section == section]
    contract: dict[str, Any] = {
        "sources": sorted(known), "rules": [], "tables": {},
        "metrics": {slug(a): {"metric_id": slug(a), "label": a, "definition": b} for a, b in (i.parts for i in of("metrics"))},
        "dimensions": {i.parts[0]: _declared(i) for i in of("dimensions")}, "measures": {i.parts[0]: _declared(i) for i in of("measures")},
        "relations": [dict(zip(("left", "right"), i.parts, strict=True)) for i in of("relations")],
    }
    for i in good:
        if i.section in ("dimensions", "measures"):
            contract["tables"].setdefault(i.parts[2], {"source": i.parts[1], "columns": {}})["columns"][i.parts[3]] = i.parts[0]
    stated = [(*split_state(i.text), i.state) for i in of("rules")]
    issues += compile_rules([(bare, own or under) for own, bare, under in stated], sectioned, contract)
    contract["field_roles"] = field_roles(contract)
    contract["contract_hash"] = "sha256:" + digest(canonical_json(contract), 64)
    return contract, issues


def _presence(contract: Mapping[str, Any]) -> Iterator[Issue]:
    needed = {"dimensions": True, "measures": True, "metrics": False, "rules": False, "relations": len(contract["sources"]) > 1}
    for section, required in needed.items():
        if not contract[section]:
            yield Issue(f"no_{section}", section, f"no {section} declared", "error" if required else "warning")


def _references(contract: Mapping[str, Any]) -> Iterator[Issue]:
    fields = contract["dimensions"].keys() | contract["measures"].keys()
    for k, relation in enumerate(contract["relations"]):
        for side in relation.values():
            if side not in fields:
                yield Issue("relation_references_undeclared_field", f"relations[{k}]", side)


def validate(contract: Mapping[str, Any]) -> list[Issue]:
    """Relations between declared fields, and presence of the sections."""
    return [*_references(contract), *_presence(contract)]


@dataclass(frozen=True)
class Contract:
    """A compiled contract together with its sources. Hands out governed tables."""

    data: dict[str, Any]
    issues: tuple[Issue, ...]
    sources: Sources
    mask: Callable[[DataFrame, str, str], DataFrame] | None = None

    def seen_by(self, masking: Masking, role: str | None) -> Contract:
        """The contract whose tables are masked for a role, whoever scans them."""
        keys: dict[tuple[str, str], set[str]] = {}
        for r in self.data["relations"]:
            for source, table, column in map(split_field, r.values()):
                keys.setdefault((source, table), set()).add(column)
        return replace(self, mask=lambda df, source, table: masking.table(df, source, table, role, keys.get((source, table), ()))) if masking.applies(role) else self

    @property
    def hash(self) -> str:
        return self.data["contract_hash"]

    @property
    def errors(self) -> list[Issue]:
        return [i for i in self.issues if i.is_error]

    def require_valid(self) -> None:
        if self.errors:
            raise Refusal("contract_invalid", self.errors[0].code, issues=[i.code for i in self.errors])

    def field(self, field_id: str) -> dict[str, Any]:
        found = self.data["dimensions"].get(field_id) or self.data["measures"].get(field_id)
        if not found:
            raise Refusal("field_not_allowed", field_id)
        return found

    def owners(self) -> dict[str, str]:
        return {t: e["source"] for t, e in self.data["tables"].items()}

    def related(self, left: str, right: str) -> bool:
        """Whether a relation connects the fields, in either direction."""
        return any({r["left"], r["right"]} == {left, right} for r in self.data["relations"])

    def table(self, spark: SparkSession, table: str, rules: bool = True, keep_missing: bool = False) -> DataFrame:
        """Governed view: the declared columns alone, without excluded rows and with masks. Catalyst pushes all to the scan."""
        entry = self.data["tables"].get(table)
        if not entry:
            raise Refusal("table_not_allowed", table)
        df = self.sources.by_id[entry["source"]].scan(spark, table).select(*entry["columns"])
        df = exclude(df, self.data, table, keep_missing) if rules else df
        return self.mask(df, entry["source"], table) if self.mask else df

    def exclusions(self, table: str) -> list[dict[str, Any]]:
        return exclusions_of(self.data, table)

    def check_columns(self, spark: SparkSession) -> list[Issue]:
        """Declared columns that a source doesn't have."""
        out = []
        for t, e in self.data["tables"].items():
            there = set(self.sources.by_id[e["source"]].scan(spark, t).columns)
            out += [Issue("declared_column_missing", f"{e['source']}.{t}", c) for c in e["columns"] if c not in there]
        return out


@lru_cache(32)
def _compiled(text: str, ids: tuple[str, ...]) -> tuple[dict[str, Any], tuple[Issue, ...]]:
    data, issues = parse(text, ids)
    return data, (*issues, *validate(data))


def load(text: str, sources: Sources) -> Contract:
    """The contract of a text; parsing is cached by content."""
    data, issues = _compiled(text, tuple(sorted(sources.by_id)))
    return Contract(data, issues, sources)


def is_current(compiled: str, contract: Contract) -> bool:
    """Whether a stored compiled contract is byte for byte what the text compiles to now."""
    return compiled == canonical_json(contract.data)
