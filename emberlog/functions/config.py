"""Parser configuration from TOML text or a dict."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from emberlog.functions.patterns import ConfigError, Pattern, compile_pattern, require, spark_time_format


@dataclass
class Parser:
    name: str
    kind: str  # single or span
    time_format: str | None
    include_raw: bool = True
    glob: str | None = None
    pattern: Pattern | None = None
    start: Pattern | None = None
    end: Pattern | None = None
    fields: list[str] = field(default_factory=list)  # inherited, then own
    nested: list["Parser"] = field(default_factory=list)


def _need(raw: dict, key: str, where: str):
    if key not in raw:
        raise ConfigError(f"{where}: missing {key}")
    return raw[key]


def _parser(raw: dict, components: dict[str, str], default: str | None, inherited: list[str], top: bool) -> Parser:
    name = _need(raw, "name", "parser")
    kind = _need(raw, "type", name)
    fmt = raw.get("timestamp_format", default)
    if fmt is None:
        raise ConfigError(f"{name}: no timestamp format")
    out = Parser(name, kind, spark_time_format(fmt), raw.get("include_raw", True), _need(raw, "glob", name) if top else None)
    if kind == "single":
        out.pattern = compile_pattern(_need(raw, "pattern", name), components)
        out.fields = inherited
        require(out.pattern, inherited, name)
        return out
    if kind != "span":
        raise ConfigError(f"{name}: unknown type {kind!r}")
    own = raw.get("reference_fields", [])
    if not own:
        raise ConfigError(f"{name}: a span needs reference_fields")
    if again := [f for f in own if f in inherited]:
        raise ConfigError(f"{name}: {again[0]!r} duplicates an inherited reference field")
    out.fields = [*inherited, *own]
    out.start, out.end = (compile_pattern(_need(raw, key, name), components) for key in ("start_pattern", "end_pattern"))
    if out.start.python == out.end.python:
        raise ConfigError(f"{name}: start and end patterns must be different")
    require(out.start, out.fields, f"{name}, start"), require(out.end, out.fields, f"{name}, end")
    out.nested = [_parser(x, components, fmt, out.fields, False) for x in raw.get("nested", [])]
    return out


def load_config(source: str | dict) -> list[Parser]:
    """The parsers of a configuration, in order; raises ConfigError before any job runs."""
    raw = tomllib.loads(source) if isinstance(source, str) else source
    default = raw.get("defaults", {}).get("timestamp_format")
    return [_parser(x, raw.get("components", {}), default, [], True) for x in raw.get("parsers", [])]


def path_pattern(glob: str) -> str:
    """A regular expression for the paths of a glob. A star stays within a folder, two cross folders; a glob without a
    folder holds in any. A path may come with its scheme."""
    part = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = re.sub(r"\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|.", lambda m: part.get(m[0]) or (m[0].replace("[!", "[^", 1) if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0])), glob)
    return ("^(?:[a-z0-9]+:(?://[^/]*)?)?" if "/" in glob else "^(?:.*/)?") + body + "$"


def parsers_of(path: str, parsers: list[Parser]) -> list[Parser]:
    """The parsers whose glob matches a file, in the order of the configuration."""
    return [p for p in parsers if re.search(path_pattern(p.glob), path)]
