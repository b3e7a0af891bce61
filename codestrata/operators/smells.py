"""Leftovers in code and prose: markers, stubs, commented-out code, versioned names, paragraphs and tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import text as X

# Fixed patterns.
ELISION = (
    r"(?i)(\.\.\.\s*(existing|rest of|remaining|other|previous|unchanged)\b|\b(existing|rest of the|remaining|other) (code|implementation|methods|functions|logic|file)\b.{0,20}"
    r"(\.\.\.|unchanged|here|goes here|remains|as before|stays the same)|\b(same as (before|above)|unchanged from (before|above)|code omitted|omitted for brevity)\b)"
)
CHAT = (
    r"(?i)\b(in a real (game|app|application|implementation|project|world|scenario)|for (simplicity|brevity|demonstration purposes)|simplified (version|implementation|example)"
    r"|you (can|could|may|might|would)( want to)? (add|replace|extend|implement|customi[sz]e)|as an ai\b|here('s| is) (the|an?|your) (updated|complete|full|revised|new)"
    r"|i('ve| have) (added|updated|changed|fixed)|let me know|hope this helps)"
)
STUB = r"(?i)\b(placeholder|stub(bed)?|not (yet )?implemented|implement (this|me)|dummy (data|value|implementation)|fake (data|implementation)|hard-?coded for now|temporary (hack|fix|workaround))\b"
TODO = r"\b(TODO|FIXME|XXX|HACK)\b"
CODEISH = (
    r"^\s*(func |var |const |if .*:$|elif |else:$|for .* in .*:|while .*:|return\b|match .*:|await |print\(|[\w.\[\]\"]+\s*[-+*/]?=\s*\S|[\w.]+\(.*\)\s*$|def |import |class \w+|let |function )"
)
VERSIONED = r"(?i)(^|[_\-. ])(old|new|v\d+|copy|backup|bak|final|tmp|temp|orig|deprecated|unused)([_\-. ]|$)|\(\d\)"
IGNORES = r"eslint-disable|@ts-(ignore|nocheck|expect-error)|#\s*noqa|#\s*type:\s*ignore|#\s*pylint:\s*disable|#\s*nosec|@SuppressWarnings|#pragma warning disable"
PRINTS = r"\b(print|prints|print_debug|console\.log)\("


def comment_lines(lines: DataFrame) -> DataFrame:
    """Lines (.., line, text_line) that are comments, with ``body`` without signs and ``is_doc`` for documentation comments."""
    c = lines.filter(F.col("text_line").rlike(r"^\s*(#|//|/\*|\*)"))
    raw = F.trim("text_line")
    return c.withColumns({"body": F.trim(F.regexp_replace(raw, r"^[#/*! \t]+", "")), "is_doc": raw.rlike(r"^(##|///|/\*\*)")})


def marker_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., elision, chat, stub, todo, ignores, prints) per file over its lines: the first four in comments only."""
    is_c = F.col("text_line").rlike(r"^\s*(#|//|/\*|\*)")
    n = lambda p, cond=None: F.count_if(F.col("text_line").rlike(p) & cond if cond is not None else F.col("text_line").rlike(p))
    return lines.groupBy(*keys).agg(n(ELISION, is_c).alias("elision"), n(CHAT, is_c).alias("chat"), n(STUB, is_c).alias("stub"), n(TODO, is_c).alias("todo"), n(IGNORES).alias("ignores"), n(PRINTS).alias("prints"))


def commented_code(lines: DataFrame, key: str | list[str], least: int = 3) -> DataFrame:
    """(key, first_line, n): runs of ``least`` or more successive comment lines that look like code; documentation comments break a run.
    A file's lines are ordered within the file (bounded by one text)."""
    keys = [key] if isinstance(key, str) else key
    c = comment_lines(lines).filter(~F.col("is_doc") & F.col("body").rlike(CODEISH)).select(*keys, "line")
    island = F.col("line") - F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    return c.withColumn("i", island).groupBy(*keys, "i").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*keys, "first_line", "n")


def versioned(files: DataFrame) -> DataFrame:
    """Files whose name carries a version or copy mark."""
    stem = F.regexp_replace(X.basename(F.col("path")), r"\.[^.]*$", "")
    return files.filter(stem.rlike(VERSIONED))


def fenced(files: DataFrame) -> DataFrame:
    """(repo, path, line): the first Markdown fence in source files (repo, path, text) other than Python and Markdown."""
    l = X.lines_of(files.filter(~F.col("path").rlike(r"\.(md|py)$")), ["repo", "path"])  # noqa: E741
    return l.filter(F.col("text_line").rlike(r"^\s*```")).groupBy("repo", "path").agg(F.min("line").alias("line"))


def scattered_constants(literals: DataFrame, least: int = 3) -> DataFrame:
    """(repo, value, files): literals (repo, path, value) that stand in ``least`` or more files."""
    return literals.groupBy("repo", "value").agg(F.count_distinct("path").alias("files")).filter(F.col("files") >= least)


def paragraphs(lines: DataFrame, key: str, gap: int = 2) -> DataFrame:
    """(key, paragraph, first_line, last_line, lines, text): non-empty lines grouped; a new group where more than ``gap`` lines lie between, at a
    heading, and where a list item begins. Ordered within one document."""
    w = Window.partitionBy(key).orderBy("line")
    l = lines.filter(F.trim("text_line") != "")  # noqa: E741
    new = F.lag("line").over(w).isNull() | (F.col("line") - F.lag("line").over(w) > gap) | F.col("text_line").rlike(r"^\s*([-*+]|[0-9]+[.)])\s") | F.col("text_line").rlike(r"^#{1,6}\s")
    g = l.withColumn("new", new.cast("int")).withColumn("paragraph", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text_line").alias("t")))), lambda x: x["t"]), " ")
    return g.groupBy(key, "paragraph").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("lines"), text.alias("text"))


def table_headers(rows: DataFrame, key: str, gap: int = 2) -> DataFrame:
    """Table rows (key, line, cells) with the ``header`` of their table: its first row; a table ends where more than ``gap`` lines lie between."""
    w = Window.partitionBy(key).orderBy("line")
    g = rows.withColumn("new", (F.lag("line").over(w).isNull() | (F.col("line") - F.lag("line").over(w) > gap)).cast("int"))
    g = g.withColumn("t", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return g.withColumn("header", F.first("cells").over(Window.partitionBy(key, "t").orderBy("line"))).drop("new")


def prompt_status(prompts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, prompt_id, status, class): the last cell of the last table row whose first cell is the prompt's id, markup stripped."""
    first = F.regexp_replace(F.get("cells", F.lit(0)), r"[*_`~\s]+", "")
    r = rows.select("doc", "line", first.alias("prompt_id"), F.trim(F.get("cells", F.size("cells") - 1)).alias("status"))
    j = prompts.select("doc", "prompt_id").distinct().join(r.groupBy("doc", "prompt_id").agg(F.max_by("status", "line").alias("status")), ["doc", "prompt_id"], "left")
    return j.select("doc", "prompt_id", "status", X.status_class(F.col("status")).alias("class"))
