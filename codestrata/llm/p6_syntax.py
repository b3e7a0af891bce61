"""Problem 6: source files that do not parse.

Each file is read as a token stream of the language its extension claims, and the grammar is derived token by token (``derivative``). An
empty derivative marks the exact token that can't stand where it does; a text whose last derivative is not nullable is cut off. For Python
an exact check follows: a text that the interpreter's own parser reads is valid whatever the grammar here says (nested f-strings).
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread
from codestrata.llm.lexers import LANGUAGES, grammar, lex, unified

SCHEMA = "file_id long, repo string, path string, lang string, valid boolean, reason string, line int, token string"


def language_of(path: str | None) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower()) if path and "." in path else None


def examine(language: str, text: str) -> tuple[bool, str | None, int | None, str | None]:
    """(valid, reason, line, token): reason ``unexpected`` with the failing token's line and text, or ``truncated`` with the last line."""
    u = unified(text)
    kinds, places = lex(language, u)
    k = grammar(language).failure(kinds)
    if k is None:
        return True, None, None, None
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return True, None, None, None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    at = places[k] if k < len(kinds) else len(u)
    if k >= len(kinds) or (at >= len(u) and kinds[k] in ("NEWLINE", "DEDENT", ";")):
        return False, "truncated", u.count("\n") + 1, None
    end = places[k + 1] if k + 1 < len(places) else len(u)
    return False, "unexpected", u.count("\n", 0, at) + 1, u[at : max(end, at + 1)].strip()[:80]


def syntax(files: DataFrame) -> DataFrame:
    """One row per file (file_id, repo, path, text): its language by extension, whether the text is valid, and where it fails.

    Unknown extensions and null texts have null ``valid``; an empty text is valid except in Go, which needs a package clause. Exact duplicate
    rows give one row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, repo, path, text in zip(b.file_id, b.repo, b.path, b.text):
                lang = language_of(path)
                res = examine(lang, text) if lang and text is not None else (None, None, None, None)
                rows.append((i, repo, path, lang, *res))
            df = pd.DataFrame(rows, columns=["file_id", "repo", "path", "lang", "valid", "reason", "line", "token"])
            yield df.astype({"valid": "boolean", "line": "Int32"})

    return spread(files.select("file_id", "repo", "path", "text")).mapInPandas(run, SCHEMA).distinct()


def rates(results: DataFrame) -> DataFrame:
    """(repo, lang, files, invalid, rate) per repository and language; files of unknown language are left out."""
    g = results.filter(F.col("valid").isNotNull()).groupBy("repo", "lang")
    return g.agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
