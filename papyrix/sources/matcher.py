"""Include and exclude patterns over relative paths, as anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and files that are never content.
NOISE = [
    ".git/", ".svn/", ".vscode/", ".idea/",
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.webp", "*.mp4", "*.mov", "*.mp3", "*.m4a", "*.pdf", "*.zip", "*.css", "*.js", "*.woff", "*.woff2", "*.ttf",
    ".DS_Store", "Thumbs.db", "desktop.ini",
]


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression in which * and ? never cross a slash; None for a malformed one."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
            i += 1
        elif c == "[":
            end = pattern.find("]", i + (pattern[i : i + 1] == "^") + 1)
            inside = pattern[i:end] if end > 0 else ""
            if not inside or inside == "^" or inside.endswith("-"):
                return None
            out += "[" + re.sub(r"([\[\]&])", r"\\\1", inside) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


class Matcher:
    """Rules by kind: a trailing slash makes a directory rule; with a slash inside, the whole path counts, else the name."""

    def __init__(self, patterns: list[str] | None):
        self.rules: dict[tuple[bool, bool], list[str]] = {(d, p): [] for d in (False, True) for p in (False, True)}
        for p in patterns or []:
            p = p.strip()
            if not p or p.startswith("#"):
                continue
            p = p.replace("\\", "/").removeprefix("**/")
            directory, p = p.endswith("/"), p.removesuffix("/")
            if p and (rule := glob_regex(p)) is not None:
                self.rules[directory, "/" in p].append(rule)

    def _regex(self, directory: bool, whole: bool) -> str | None:
        rules = self.rules[directory, whole]
        return "^(?:" + "|".join(rules) + r")\z" if rules else None

    def _match(self, path: str, directory: bool) -> bool:
        name = path.rsplit("/", 1)[-1]
        return any((r := self._regex(directory, whole)) and re.match(r.replace(r"\z", r"\Z"), target) for whole, target in ((False, name), (True, path)))

    def match_file(self, path: str) -> bool:
        return self._match(path, False)

    def match_dir(self, path: str) -> bool:
        return self._match(path, True)

    def file_column(self, path: Column) -> Column:
        """``match_file`` as an expression."""
        out = F.lit(False)
        for whole, target in ((False, F.substring_index(path, "/", -1)), (True, path)):
            if r := self._regex(False, whole):
                out = out | target.rlike(r)
        return out

    def inside_excluded(self, path: Column) -> Column:
        """Whether any directory above the file matches a directory rule."""
        parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
        named, whole = self._regex(True, False), self._regex(True, True)
        out = F.lit(False)
        if named:
            out = out | F.exists(parts, lambda d: d.rlike(named))
        if whole:
            heads = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
            out = out | F.coalesce(F.exists(heads, lambda d: d.rlike(whole)), F.lit(False))
        return out
