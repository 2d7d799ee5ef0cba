"""Parser patterns: component expansion, validation and the dialect of Spark's regular expressions and time formats."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from emberlog.functions.times import complete, format_pattern


class ConfigError(ValueError):
    """A parser configuration that can't be used."""


#: Strftime directives and their Spark pattern letters.
DIRECTIVES = {
    "%Y": "y", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%.f": "[.SSSSSS]", "%b": "MMM", "%B": "MMMM",
    "%I": "h", "%p": "a", "%F": "y-M-d", "%T": "H:m:s", "%R": "H:m",
}
WIDTH = {"y": "yyyy", "M": "MM", "d": "dd", "H": "HH", "m": "mm", "s": "ss", "h": "hh"}


#: What a format begins with that an Arrow helper reads.
STRPTIME = "strptime "


def spark_time_format(fmt: str) -> str | None:
    """Spark's pattern for a strftime format, or STRPTIME and the format if Spark has no pattern for it; None if a time in it
    never has both hour and minute."""
    found = re.findall(r"%\.f|%:z|%[A-Za-z%]|[A-Za-z]+|[^%]|%", fmt)
    if unknown := [x for x in found if x[0] == "%" and x not in DIRECTIVES]:
        rare = format_pattern(fmt)
        if rare is None:
            raise ConfigError(f"timestamp format {fmt!r}: {unknown[0]} isn't supported")
        return STRPTIME + fmt if complete(rare) else None
    if not ({"%H", "%I", "%T", "%R"} & set(found) and {"%M", "%T", "%R"} & set(found)):
        return None
    out = []
    for k, x in enumerate(found):
        if x[0] != "%":
            out.append("''" if x == "'" else f"'{x}'" if x.isalpha() else x)
            continue
        java = DIRECTIVES[x]
        beside = any(0 <= j < len(found) and found[j] in DIRECTIVES and DIRECTIVES[found[j]] in WIDTH for j in (k - 1, k + 1))
        out.append(WIDTH[java] if beside and java in WIDTH else java)
    return "".join(out)


def expand(pattern: str, components: dict[str, str]) -> str:
    """Blank runs of the pattern become \\s+, then each ${name} its component in a group; a backslash keeps the next character."""
    def instead(token: re.Match) -> str:
        if token["name"] is None:
            return r"\s+" if token[0].isspace() else token[0]
        if token["close"] != "}":
            raise ConfigError(f"unclosed ${{ in pattern {pattern!r}")
        if token["name"] not in components:
            raise ConfigError(f"missing component {token['name']!r}")
        return f"(?:{components[token['name']]})"

    return re.sub(r"\\[^\s]|\s+|\$\{(?P<name>[^}]*)(?P<close>\}?)", instead, pattern)


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern: the Python form, the Java form, and the number of each named group.

    optional: a group may be absent, and one may match the empty text, so that an empty capture can mean both.
    """

    python: str
    java: str
    groups: dict[str, int]
    optional: bool
    solid: bool = False

    @property
    def names(self) -> list[str]:
        return list(self.groups)


def compile_pattern(pattern: str, components: dict[str, str]) -> Pattern:
    text = expand(pattern, components)
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=", text):
        raise ConfigError(f"look-around and back-references aren't supported: {pattern!r}")
    if re.search(r"\(\?[a-z]*(?:[UR]|-u)", text):
        raise ConfigError(f"unsupported inline flag: {pattern!r}")
    text = re.sub(r"\\([pP])([A-Z])", r"\\\1{\2}", text)
    python = re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", text)
    python = re.sub(r"\[:alpha:\]", "A-Za-z", re.sub(r"\[:digit:\]", "0-9", re.sub(r"\[:alnum:\]", "A-Za-z0-9", re.sub(r"\[:space:\]", r"\\s", python))))
    try:
        groups = regex.compile(python).groupindex
    except regex.error as error:
        raise ConfigError(f"bad pattern {pattern!r}: {error}") from error
    java = "(?dU)" + re.sub(r"\(\?P<\w+>", "(", python)
    java = re.sub(r"\\([pP])\{(\w{3,})\}", r"\\\1{Is\2}", java)  # long names of scripts and classes
    optional = bool(re.search(r"\||\)[?*]|\)\{0", text)) and any(_may_be_empty(body) for body in _bodies(python).values())
    return Pattern(python, java, dict(groups), optional, not any(map(_may_be_empty, _bodies(python).values())))


def _bodies(pattern: str) -> dict[str, str]:
    """What stands in each named group."""
    out, stack, inside = {}, [], False
    for m in re.finditer(r"\\.|\(\?P<(\w+)>|\(|\)|\[\^?\]?|\]", pattern):
        if inside:
            inside = m[0] != "]"
        elif m[0][0] == "[":
            inside = True
        elif m[0][0] == "(":
            stack.append((m[1], m.end()))
        elif m[0] == ")" and stack:
            name, start = stack.pop()
            if name:
                out[name] = pattern[start : m.start()]
    return out


def _may_be_empty(body: str) -> bool:
    try:
        return regex.fullmatch(body, "") is not None
    except regex.error:  # cut at a place that isn't a group's end
        return True


def require(pattern: Pattern, fields: list[str], where: str) -> None:
    for field in ["timestamp", *fields]:
        if field not in pattern.groups:
            raise ConfigError(f"{where}: no group named {field!r}")
