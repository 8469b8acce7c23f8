"""A vault's own entity patterns and names, from a small YAML file."""

from __future__ import annotations

import re
from pathlib import Path


def parse(text: str) -> tuple[dict[str, list[str]], list[str]]:
    """(patterns by type, names) of a glossary; what isn't valid is left out.

    Reads the YAML that glossaries use: two keys, ``entities`` with a list and ``patterns`` with
    a list for each type.
    """
    patterns: dict[str, list[str]] = {}
    names: list[str] = []
    top, kind = "", ""
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        item = re.match(r"\s*-\s+(.*)$", line)
        key = re.match(r"\s*([^\s:#][^:]*):\s*$", line)
        if key and indent == 0:
            top, kind = key[1].strip(), ""
        elif key:
            kind = key[1].strip()
        elif item:
            value = item[1].strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1].replace("\\\\", "\\") if value[0] == '"' else value[1:-1].replace("''", "'")
            if top == "entities" and value:
                names.append(value)
            elif top == "patterns" and kind:
                try:
                    re.compile(value)
                except re.error:
                    continue
                patterns.setdefault(kind, []).append(value)
    return patterns, names


def load(path: str) -> tuple[dict[str, list[str]], list[str]]:
    """The glossary at a path; an absent or unreadable file is an empty one."""
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError):
        return {}, []
