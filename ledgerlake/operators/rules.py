"""Path rules: ignore patterns where the last match wins, and scopes where the longest prefix wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors
from .scale import small


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negate: bool
    dir_only: bool


def compile_ignore_rules(lines: list[str], ignore_case: bool = False) -> list[IgnoreRule]:
    """Rules from lines: blank ones and # comments go, ! negates, a trailing slash means directories only, a slash
    before or inside anchors at the root, ** spans directories, * and ? stay within one."""
    out = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        negate = text.startswith("!")
        text = text[1:] if negate else text
        dir_only = text.endswith("/")
        text = text.rstrip("/") if dir_only else text
        anchored = "/" in text
        text = text.lstrip("/")
        if not text:
            continue
        parts = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(parts.get(t, re.escape(t)) for t in re.findall(r"\*\*/|/\*\*(?=\Z)|\*\*|\*|\?|[^*?]", text))
        out.append(IgnoreRule(("(?i)" if ignore_case else "") + "^" + ("" if anchored else "(?:.*/)?") + body + "$", negate, dir_only))
    return out


def is_ignored(path: Column, is_dir: Column | bool, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that matches the path itself ignores it. Rules are compiled into one expression."""
    out = F.lit(False)
    directory = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    for rule in rules:
        hit = path.rlike(rule.regex) & (directory if rule.dir_only else F.lit(True))
        out = F.when(hit, F.lit(not rule.negate)).otherwise(out)
    return out


def is_ignored_below(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether a file, or any directory above it, is ignored."""
    return is_ignored(path, False, rules) | F.exists(ancestors(path), lambda a: is_ignored(a, True, rules))


def normalize_scope(rules: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """(prefix, included) rules without . and .. segments, each prefix once (the last rule stays), and without rules
    that say what their nearest ancestor, or the default (included), says already."""
    by = {}
    for prefix, included in rules:
        parts = [p.strip() for p in prefix.replace("\\", "/").split("/")]
        by["/".join(p for p in parts if p and p not in (".", ".."))] = included
    out: dict[str, bool] = {}
    for prefix in sorted(by, key=lambda p: (p.count("/") + bool(p), p)):
        above, said = prefix, True
        while above:
            above = above.rpartition("/")[0]
            if above in out:
                said = out[above]
                break
        if by[prefix] != said:
            out[prefix] = by[prefix]
    return sorted(out.items())


def with_scope_rule(rules: list[tuple[str, bool]], prefix: str, included: bool) -> list[tuple[str, bool]]:
    """The rules with one more, and without those below it."""
    return normalize_scope([r for r in rules if r[0] != prefix and not r[0].startswith(f"{prefix}/" if prefix else "")] + [(prefix, included)])


def in_scope(rows: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """rows with in_scope: what the longest matching prefix of rules(prefix, included) says, else true. Paths are
    joined by their ancestors and themselves, so it is an equality join for any number of rules; a short list is
    broadcast, and what is said of the root, which all paths are below, is no key of the join."""
    keyed = rows.select(path).distinct().withColumn("prefix", F.explode(F.concat(ancestors(F.col(path)), F.array(F.col(path)))))
    root = rules.where("prefix = ''").agg(F.max("included").alias("_root"))  # one row
    said = keyed.join(small(rules.where("prefix <> ''")), "prefix").groupBy(path).agg(F.max_by("included", F.length("prefix")).alias("_said"))
    return rows.join(said, path, "left").crossJoin(F.broadcast(root)).withColumn("in_scope", F.coalesce("_said", "_root", F.lit(True))).drop("_said", "_root")


def may_contain_included(dirs: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """dirs with in_scope, may_contain (in scope, or a rule below includes) and partial (a rule below disagrees)."""
    below = rules.withColumn(path, F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("prefix"))))).where(F.col("prefix") != F.col(path))
    inner = below.groupBy(path).agg(F.bool_or("included").alias("_some"), F.bool_and("included").alias("_all"))
    out = in_scope(dirs, rules, path).join(inner, path, "left")
    partial = F.when(F.col("in_scope"), ~F.col("_all")).otherwise(F.col("_some"))
    return out.select(*dirs.columns, "in_scope", (F.col("in_scope") | F.coalesce("_some", F.lit(False))).alias("may_contain"), F.coalesce(partial, F.lit(False)).alias("partial"))
