"""Column expressions over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import settings


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased suffix; leading dots of the name do not start a suffix."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]*)$", 1))


def has_extension(ext: Column) -> Column:
    return ~ext.isin("", ".")


def language(ext: Column, languages: dict[str, str] = settings.LANGUAGE_OF_EXTENSION) -> Column:
    """Language by extension from a literal map; small and fixed, so no join."""
    pairs = [F.lit(x) for item in languages.items() for x in item]
    known = F.element_at(F.create_map(*pairs), F.lower(ext))
    return F.coalesce(known, F.lit(settings.UNKNOWN_LANGUAGE))


def is_text_language(lang: Column) -> Column:
    return lang.isin(settings.TEXT_LANGUAGES)


def roles(path: Column, patterns: dict[str, list[str]] = settings.ROLE_PATTERNS) -> Column:
    """Roles whose list holds the file's name or a directory on its path."""
    rooted = F.concat(F.lit("/"), path)
    found = []
    for role, entries in patterns.items():
        names = [e for e in entries if not e.endswith("/")]
        hit = basename(path).isin(names)
        for directory in (e for e in entries if e.endswith("/")):
            hit = hit | F.contains(rooted, F.lit("/" + directory))
        found.append(F.when(hit, F.lit(role)))
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def glob_regex(glob: str) -> str:
    """A shell glob as a regex over a relative path, at any directory depth."""
    body = "".join(
        ".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob
    )
    return f"(?:^|/){body}$"


def is_ignored(path: Column, globs=tuple(settings.IGNORE_PATTERNS),
               directories=tuple(settings.SKIPPED_DIRECTORIES)) -> Column:
    hit = F.lit(False)
    for glob in globs:
        hit = hit | path.rlike(glob_regex(glob))
    rooted = F.concat(F.lit("/"), path)
    for directory in directories:
        hit = hit | F.contains(rooted, F.lit(f"/{directory}/"))
    return hit


def in_directories(path: Column, directories: list[str]) -> Column:
    """Focus on some top directories of a project, given as `src/`."""
    hit = F.lit(False)
    for directory in directories:
        hit = hit | path.startswith(directory)
    return hit
