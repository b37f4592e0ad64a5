"""Declared sources: what they can do, which one answers a request, and how Spark scans them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import Issue, Refusal

STRUCTURED, DOCUMENT, TEXT, VECTOR = "structured_query", "document_query", "text_search", "vector_search"

#: Source types: Spark format, capabilities, and required settings. Network sources read through Spark's connectors,
#: whose class is ``driver``; a type with ``exports`` has no connector that reads, and is there for tables exported as files.
TYPES: dict[str, dict[str, Any]] = {
    "parquet": {"format": "parquet", "capabilities": (STRUCTURED, DOCUMENT, TEXT, VECTOR), "required": ("path",)},
    "csv": {"format": "csv", "capabilities": (STRUCTURED,), "required": ("path",)},
    "json": {"format": "json", "capabilities": (STRUCTURED, DOCUMENT), "required": ("path",)},
    "duckdb": {"format": "jdbc", "capabilities": (STRUCTURED,), "required": ("path",), "driver": "org.duckdb.DuckDBDriver"},
    "postgres": {"format": "jdbc", "capabilities": (STRUCTURED,), "required": ("host", "port", "database"), "driver": "org.postgresql.Driver"},
    "snowflake": {"format": "snowflake", "capabilities": (STRUCTURED,), "required": ("url", "database"), "driver": "net.snowflake.spark.snowflake.DefaultSource"},
    "mongodb": {"format": "mongodb", "capabilities": (DOCUMENT,), "required": ("url", "database"), "driver": "com.mongodb.spark.sql.connector.MongoTableProvider"},
    "opensearch": {"format": "opensearch", "capabilities": (TEXT,), "required": ("url", "index"), "driver": "org.opensearch.spark.sql.DefaultSource"},
    "qdrant": {"format": "parquet", "capabilities": (VECTOR,), "required": ("url", "collection"), "exports": True},
}
SECRETS = ("password", "token", "secret", "api_key")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class Source:
    """One source. ``tables`` maps a table to its path, or to a function of the session that scans it."""

    source_id: str
    source_type: str
    config: dict[str, Any] = field(default_factory=dict)
    tables: dict[str, str | Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    available: bool = True

    @property
    def capabilities(self) -> tuple[str, ...]:
        return tuple(self.config.get("operations") or TYPES[self.source_type]["capabilities"])

    @property
    def readable(self) -> bool:
        """Whether its tables can be scanned at all."""
        return self.available and (not TYPES[self.source_type].get("exports") or bool(self.tables))

    def options(self, table: str) -> dict[str, str]:
        """Options of Spark's reader for a table of a network source."""
        c, kind = self.config, self.source_type
        own = {str(k): str(v) for k, v in c.get("options", {}).items()}
        name = self.tables.get(table, table) if isinstance(self.tables.get(table, table), str) else table
        made = {
            "postgres": lambda: {"url": f"jdbc:postgresql://{c['host']}:{c['port']}/{c['database']}", "dbtable": f"{c['schema']}.{name}" if c.get("schema") else name, "driver": TYPES[kind]["driver"]},
            "duckdb": lambda: {"url": f"jdbc:duckdb:{c['path']}", "dbtable": name, "driver": TYPES[kind]["driver"]},
            "snowflake": lambda: {"sfURL": c["url"], "sfDatabase": c["database"], "sfSchema": c.get("schema", "PUBLIC"), "dbtable": name},
            "mongodb": lambda: {"connection.uri": c["url"], "database": c["database"], "collection": name},
            "opensearch": lambda: {"opensearch.nodes": c["url"], "opensearch.resource": c["index"]},
        }.get(kind, dict)()
        login = {"postgres": ("user", "password"), "snowflake": ("sfUser", "sfPassword"), "opensearch": ("opensearch.net.http.auth.user", "opensearch.net.http.auth.pass")}.get(kind, ())
        return made | {option: str(c[setting]) for option, setting in zip(login, ("user", "password"), strict=False) if c.get(setting)} | own

    def scan(self, spark: SparkSession, table: str) -> DataFrame:
        """The table as Spark's reader gives it: columns and filters of a query reach the scan."""
        where, about = self.tables.get(table), TYPES[self.source_type]
        if callable(where):
            return where(spark)
        file = self.source_type == "duckdb" and os.path.splitext(str(self.config.get("path", "")))[1] in (".duckdb", ".db")
        if "driver" in about and (self.source_type != "duckdb" or file):
            if self.tables and table not in self.tables:
                raise Refusal("table_not_allowed", table)
            if not has_class(spark, about["driver"]):
                raise Refusal("connector_missing", f"{self.source_type}: {about['driver']} is not on the class path")
            return spark.read.format(about["format"]).options(**self.options(table)).load()
        if where is None and "path" not in self.config:
            raise Refusal("table_not_allowed", table)
        where = where or f"{self.config['path'].rstrip('/')}/{table}.parquet"
        kind = "parquet" if "driver" in about else about["format"]
        reader = spark.read.format(kind).options(**self.options(table))
        if kind == "csv":
            reader = reader.option("header", "true")
            if schema := self.config.get("schemas", {}).get(table):
                reader = reader.schema(schema)
        return reader.load(where)

    def health(self, spark: SparkSession) -> dict[str, Any]:
        """Whether every declared table opens; a placeholder without tables is ``declared``."""
        if not self.tables:
            return {"source_id": self.source_id, "status": "declared"}
        try:
            for t in self.tables:
                self.scan(spark, t).limit(1).count()
        except Exception as e:  # a source's own failure is the answer here
            return {"source_id": self.source_id, "status": "error", "detail": str(e).splitlines()[0][:200]}
        return {"source_id": self.source_id, "status": "ok", "tables": sorted(self.tables)}


def has_class(spark: SparkSession, name: str) -> bool:
    """Whether the driver's class path has a class."""
    try:
        spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(name)
    except Exception:  # whatever the bridge raises for a missing class
        return False
    return True


def register_type(name: str, fmt: str, capabilities: Iterable[str], required: Iterable[str] = ()) -> None:
    TYPES[name] = {"format": fmt, "capabilities": tuple(capabilities), "required": tuple(required)}


class Sources:
    """All declared sources by id."""

    def __init__(self, sources: Iterable[Source]):
        self.by_id = {s.source_id: s for s in sources}

    def capability_map(self) -> dict[str, list[str]]:
        """Capability -> ids of available sources."""
        out: dict[str, list[str]] = {}
        for s in self.by_id.values():
            for c in s.capabilities if s.readable else ():
                out.setdefault(c, []).append(s.source_id)
        return {c: sorted(ids) for c, ids in sorted(out.items())}

    def resolve(self, capability: str, source_id: str | None = None) -> Source:
        """The explicit source if it has the capability, else the only one that has."""
        able = self.capability_map().get(capability, [])
        if source_id is not None:
            if source_id not in able:
                raise Refusal("source_not_found_for_capability", f"{source_id} / {capability}")
            return self.by_id[source_id]
        if not able:
            raise Refusal("no_source_for_capability", capability)
        if len(able) > 1:
            raise Refusal("source_selection_required", capability, candidates=able)
        return self.by_id[able[0]]

    def owner(self, tables: Iterable[str], owners: Mapping[str, str]) -> Source:
        """The structured source that owns all of the tables."""
        able = self.capability_map().get(STRUCTURED, [])
        if len(able) == 1:
            return self.by_id[able[0]]
        found = sorted({owners[t] for t in tables if t in owners})
        if len(found) > 1:
            raise Refusal("single_query_spans_sources", ", ".join(found), sources=found)
        return self.resolve(STRUCTURED, found[0] if found else None)

    def listing(self) -> list[dict[str, Any]]:
        """Sources with their secrets left out."""
        return [{"source_id": s.source_id, "source_type": s.source_type, "available": s.readable, "capabilities": list(s.capabilities), "config": redact(s.config)} for s in self.by_id.values()]


def redact(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {k: "***" if any(x in str(k).lower() for x in SECRETS) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def resolve_value(value: Any, env: Mapping[str, str]) -> Any:
    """An inline value, or one with ${NAME} replaced from the environment."""
    if isinstance(value, Mapping):
        return {k: resolve_value(v, env) for k, v in value.items()}
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value) if isinstance(value, str) else value


class _Strict(yaml.SafeLoader):
    """YAML in which a repeated key is an error."""


def _mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
    keys = [loader.construct_object(k) for k, _ in node.value]
    if twice := sorted({str(k) for k in keys if keys.count(k) > 1}):
        raise ValueError(f"duplicate key {', '.join(twice)}")
    return {loader.construct_object(k): loader.construct_object(v, deep=True) for k, v in node.value}


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load_yaml(text: str) -> Any:
    return yaml.load(text, _Strict)  # noqa: S506


def load_sources(text: str, folder: str | Path = ".", env: Mapping[str, str] | None = None) -> Sources:
    """Sources of a YAML text ``sources: {id: {type, ...}}``. Values: inline, else from an ``env:`` file, else ${NAME}."""
    env = dict(os.environ if env is None else env)
    out = []
    for source_id, raw in (load_yaml(text) or {}).get("sources", {}).items():
        own = dict(env)
        if file := raw.get("env"):
            for line in (Path(folder) / file).read_text().splitlines():
                if "=" in line and not line.lstrip().startswith("#"):
                    k, v = line.split("=", 1)
                    own[k.strip()] = v.strip()
        conf = resolve_value({k: v for k, v in raw.items() if k not in ("type", "tables", "env")}, own)
        for key in TYPES.get(raw.get("type"), {}).get("required", ()):
            if not conf.get(key) and own.get(key.upper()):
                conf[key] = own[key.upper()]
        if conf.get("path") and "://" not in conf["path"] and not os.path.isabs(conf["path"]):
            conf["path"] = str(next((p for p in (Path(folder) / conf["path"], Path.cwd() / conf["path"]) if p.exists()), Path(folder) / conf["path"]))
        out.append(Source(source_id, raw["type"], conf, dict(raw.get("tables") or {}), bool(raw.get("available", True))))
    return Sources(out)


#: Settings that any source may have beside those its type requires.
COMMON_SETTINGS = frozenset("type tables env available options operations schemas schema user password token secret api_key path url host port database index collection warehouse role account description".split())


def check_config(text: str, folder: str | Path | None = None) -> list[Issue]:
    """Everything that is wrong with a source configuration; with ``folder``, also env files that aren't there."""
    try:
        raw = load_yaml(text)
    except ValueError as e:
        return [Issue("duplicate_key", "sources", str(e))]
    except yaml.YAMLError as e:
        return [Issue("config_not_yaml", "sources", str(e).splitlines()[0])]
    if not isinstance(raw, Mapping) or not isinstance(raw.get("sources"), Mapping):
        return [Issue("sources_missing", "sources", "expected a mapping 'sources'")]
    if not raw["sources"]:
        return [Issue("no_sources", "sources", "no source declared")]
    out = []
    for name, conf in raw["sources"].items():
        at = f"sources.{name}"
        if not _IDENTIFIER.fullmatch(str(name)):
            out.append(Issue("invalid_identifier", at, f"{name!r} is not an identifier"))
        if not isinstance(conf, Mapping):
            out.append(Issue("source_not_mapping", at, "expected a mapping"))
            continue
        if "type" not in conf:
            out.append(Issue("type_missing", at, "no type"))
            continue
        if conf["type"] not in TYPES:
            out.append(Issue("unknown_type", at, str(conf["type"])))
            continue
        for key in TYPES[conf["type"]]["required"]:
            if conf.get(key) in (None, "") and "env" not in conf:
                out.append(Issue("required_setting_missing", f"{at}.{key}", key))
        if folder is not None and conf.get("env") and not (Path(folder) / str(conf["env"])).is_file():
            out.append(Issue("env_file_missing", f"{at}.env", str(conf["env"])))
        for key in sorted(map(str, conf)):
            if key not in COMMON_SETTINGS:
                out.append(Issue("unexpected_setting", f"{at}.{key}", key, "warning"))
        port = conf.get("port")
        if port is not None and not (isinstance(port, int) and 0 < port < 65536 or str(port).startswith("${")):
            out.append(Issue("invalid_port", f"{at}.port", str(port)))
        url = conf.get("url")
        if url is not None and not re.match(r"(\w+://|\$\{)", str(url)):
            out.append(Issue("invalid_url", f"{at}.url", str(url)))
        for key, value in conf.items():
            if any(x in str(key).lower() for x in SECRETS) and value and not str(value).startswith("${"):
                out.append(Issue("plaintext_secret", f"{at}.{key}", "secrets come from the environment", "warning"))
        for op in conf.get("operations") or ():
            if op not in TYPES[conf["type"]]["capabilities"]:
                out.append(Issue("operation_not_supported", f"{at}.operations", str(op)))
        for table in conf.get("tables") or {}:
            if not _IDENTIFIER.fullmatch(str(table)):
                out.append(Issue("invalid_identifier", f"{at}.tables", str(table)))
    return out
