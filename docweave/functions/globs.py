"""Path patterns: anchored at the root, ``*`` crosses ``/``, ``?`` is one character."""

from __future__ import annotations

import re


def valid(glob: str) -> bool:
    """Absolute patterns and negations are not patterns."""
    return bool(glob) and not glob.startswith(("/", "!", "~")) and not re.match(r"[A-Za-z]:[\\/]", glob)


def to_regex(glob: str) -> str:
    """An anchored pattern that Java and Python read alike."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            if glob[i + 1 : i + 2] == "/" and (i < 2 or glob[i - 2] == "/") and glob[i - 1 : i + 1] == "**":
                out.append("(?:.*/)?")  # **/ also matches no folder at all
                i += 1
            else:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(to_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_/-" else c)
        i += 1
    return "^" + "".join(out) + "$"


def any_of(globs: list[str]) -> str:
    """One pattern for a set of globs; invalid ones match nothing."""
    parts = [to_regex(g)[1:-1] for g in globs if valid(g)]
    return "^(?:" + "|".join(parts) + ")$" if parts else "(?!)"
