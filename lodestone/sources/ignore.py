"""Ignore rules: compiled once on the driver into regular expressions that both Python and the JVM run.

A rule belongs to the directory of its file and is tried on paths relative to it. The nearest directory whose rules
have an opinion decides; no opinion means not ignored."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    regex: str
    negated: bool
    directory_only: bool
    anchored: bool


#: One element of a pattern's path segment: a set, an escape, a star, a question mark, any other letter.
_PIECE = re.compile(r"\[([!^]?\]?[^\]/]*)\]|\\(.)|(\*+)|(\?)|(.)", re.S)


def _segment(text: str) -> str:
    """The regular expression of one path segment; nothing in it matches a slash."""
    out = []
    for members, escaped, star, one, plain in _PIECE.findall(text):
        if members:
            flip, listed = ("^/", members[1:]) if members[0] in "!^" else ("", members)
            listed = re.sub(r"([\\\[\]^&~|])", r"\\\1", listed)
            out.append(f"[{flip}{listed}]" if listed else re.escape(f"[{members}]"))
        elif star:
            out.append("[^/]*")
        elif one:
            out.append("[^/]")
        else:
            out.append(re.escape(escaped or plain))
    return "".join(out)


def _without_trailing_blanks(text: str) -> str:
    """Blanks at the end don't count, but for one behind a backslash."""
    end = len(text)
    while end and text[end - 1] == " " and not text[: end - 1].endswith("\\"):
        end -= 1
    return text[:end]


def parse_rule(line: str) -> Rule | None:
    """The rule of a line; comments, blank lines and lone slashes have none.

    A pattern is read segment by segment: a slash before its end ties it to the rule's directory, one at its end to
    directories, and a segment of two stars stands for any number of directories."""
    text = line.rstrip("\n")
    if text[:1] == "#" or text.isspace():
        return None
    negated = text[:1] == "!"
    segments = _without_trailing_blanks(text.removeprefix("!")).split("/")
    if not any(x.strip() for x in segments):
        return None
    directory_only = segments[-1] == ""
    if directory_only:
        segments.pop()
    anchored = len(segments) > 1
    if segments[0] == "":
        segments.pop(0)
    deep = lambda x: len(x) > 1 and not x.strip("*")
    if segments and deep(segments[0]):  # any depth below the directory: as good as no anchor
        segments, anchored = segments[1:] or ["*"], False
    out, last = [], len(segments) - 1
    for i, x in enumerate(segments):
        if deep(x):
            out.append(".*" if i == last else "(?:.*/)?")
        else:
            out.append(_segment(x) + ("/" if i < last else ""))
    tail = ("/$" if negated else "(?:$|/)") if directory_only else "$"
    return Rule(text, ("^" if anchored else "(?:^|/)") + "".join(out) + tail, negated, directory_only, anchored)


def parse_rules(text: str) -> tuple[Rule, ...]:
    return tuple(r for r in map(parse_rule, text.split("\n")) if r)


def opinion(rules: Iterable[Rule], path: str, is_dir: bool = False) -> bool | None:
    """True or False by the last rule that matches, None without one. Negated directory rules match directories only."""
    for rule in reversed(tuple(rules)):
        if re.search(rule.regex, path + "/" if rule.negated and is_dir else path):
            return not rule.negated
    return None


class IgnoreTree:
    """The rule sets of a tree by directory ("" is the root)."""

    def __init__(self, by_directory: dict[str, tuple[Rule, ...]] | None = None):
        self.by_directory = dict(by_directory or {})

    def add(self, directory: str, text: str) -> None:
        self.by_directory[directory] = parse_rules(text)

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        directory = path
        while directory:
            directory = directory.rpartition("/")[0]
            if rules := self.by_directory.get(directory):
                said = opinion(rules, path[len(directory) + 1 :] if directory else path, is_dir)
                if said is not None:
                    return said
        return False

    def hides(self, path: str) -> bool:
        """Whether the file or any directory above it is ignored, as a walk from the root would find."""
        parts = path.split("/")
        return any(self.ignored("/".join(parts[:i]), i < len(parts)) for i in range(1, len(parts) + 1))


def last_match(path: Column, rules: Iterable[Rule]) -> Column:
    """opinion() of one rule set as a column expression: the last rule that matches decides."""
    out = F.lit(None).cast("boolean")
    for rule in rules:
        out = F.when(path.rlike(rule.regex), F.lit(not rule.negated)).otherwise(out)
    return out


def with_ignored(paths: DataFrame, tree: IgnoreTree, path: str = "path") -> DataFrame:
    """The rows with `ignored`; rules nearest to the path decide."""
    out = F.lit(None).cast("boolean")
    for directory, rules in sorted(tree.by_directory.items(), key=lambda kv: kv[0].count("/") + bool(kv[0])):
        if not rules:
            continue
        prefix = directory + "/" if directory else ""
        said = F.when(F.col(path).startswith(prefix), last_match(F.substring(F.col(path), F.lit(len(prefix) + 1), F.length(path)), rules))
        out = F.coalesce(said, out)
    return paths.withColumn("ignored", F.coalesce(out, F.lit(False)))
