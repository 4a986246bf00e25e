"""Document ids from paths: theme|stem."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = re.compile(r"\|md_\d+$")
EXTENSION = re.compile(r"\.(md|markdown|bin|txt|html?)$", re.I)


def sanitize(text: str) -> str:
    """Letters without marks, in lower case; whatever is no ASCII letter or digit becomes one underscore."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "_", bare.lower()).strip("_")


def derive(path: str, theme: str | None = None, conflict: str = "silent") -> str:
    """theme|stem of a path (its folder and file name); an id stays as it is, but for a time stamp. A given theme wins; ``conflict``: silent or throw."""
    path = STAMP.sub("", path)
    parts = [p for p in (path.split("|") if "|" in path else re.split(r"[/\\]+", re.sub(r"[?#].*$", "", path))) if p]
    stem = sanitize(EXTENSION.sub("", parts[-1])) if parts else ""
    own = sanitize(parts[-2]) if len(parts) > 1 else ""
    if theme:
        if own and "|" in path and sanitize(theme) != own and conflict == "throw":
            raise ValueError(f"{path!r} has theme {own!r}, not {theme!r}")
        own = sanitize(theme)
    return f"{own}|{stem}" if own else stem


def document_id(path: Column, theme: str | None = None) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else derive(x, theme))

    return run(path)
