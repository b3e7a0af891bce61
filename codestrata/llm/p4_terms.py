"""Problem 4: how distinctive a term is for its record.

Terms are runs of letters of any script, split once more between a lower-case and a following upper-case letter, lower-cased, of
``shortest`` letters or more. Within each text unit of a record (one symbol name, one documentation text, one subject line) a term is
linked with the terms up to ``window - 1`` places after it; the number of distinct neighbours over the whole record takes the place of the
term frequency: weight = (1 + neighbours) * ln((records + 1) / records with the term). The one keeps terms that stand alone.
All of it runs in the JVM: regular expressions, array functions, partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut


def term_array(text: Column, shortest: int = 3) -> Column:
    """The terms of a text in order; null or empty text has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Ll})(\p{Lu})", "$1 $2")
    runs = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+)"), F.lit(1))
    return F.filter(F.transform(runs, lambda t: F.lower(t)), lambda t: F.char_length(t) >= shortest)


def neighbour_pairs(terms: Column, window: int) -> Column:
    """Array of (a, b) for terms at most ``window - 1`` places apart, both ways, without a term being its own neighbour."""
    n = F.size(terms)
    sides = []
    for d in range(1, window):
        head, tail = F.slice(terms, F.lit(1), F.greatest(n - d, F.lit(0))), F.slice(terms, F.lit(1 + d), F.greatest(n - d, F.lit(0)))
        sides += [F.arrays_zip(head.alias("a"), tail.alias("b")), F.arrays_zip(tail.alias("a"), head.alias("b"))]
    pairs = F.array_distinct(F.flatten(F.array(*[F.transform(s, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))) for s in sides])))
    return F.filter(pairs, lambda p: p["a"] != p["b"])


def term_weights(units: DataFrame, window: int = 4, shortest: int = 3) -> DataFrame:
    """(record_kind, record_key, term, tf, neighbours, df, records, weight) of text units (record_kind, record_key, text).

    Rarity is measured among records of the same kind. Records without terms give no rows and do not count as records of the rarity.
    A term that a third of all records hold costs one combined row per map task in the counts; the join with its count is left to skew
    handling by size (adaptive execution). The neighbours of a term in one record are collected as a set: at most the record's vocabulary.
    """
    t = units.select("record_kind", "record_key", term_array(F.col("text"), shortest).alias("terms")).filter(F.size("terms") > 0)
    # one row per occurrence (no neighbour) and per neighbour of a unit; both are counted for a record's term in one pass, combined before the shuffle
    alone = F.transform("terms", lambda x: F.struct(x.alias("a"), F.lit(None).cast("string").alias("b")))
    e = t.select("record_kind", "record_key", F.explode(F.concat(alone, neighbour_pairs(F.col("terms"), window))).alias("p"))
    tf = e.groupBy("record_kind", "record_key", F.col("p.a").alias("term")).agg(F.count_if(F.col("p.b").isNull()).alias("tf"), F.size(F.collect_set("p.b")).cast("long").alias("neighbours"))
    tf = cut(tf)
    df = tf.groupBy("record_kind", "term").agg(F.count(F.lit(1)).alias("df"))
    records = tf.select("record_kind", "record_key").distinct().groupBy("record_kind").agg(F.count(F.lit(1)).alias("records"))
    scored = tf.join(df, ["record_kind", "term"]).join(F.broadcast(records), "record_kind")
    deg = F.col("neighbours")
    return scored.select(
        "record_kind", "record_key", "term", "tf", deg.alias("neighbours"), "df", "records",
        ((1 + deg) * F.ln((F.col("records") + 1) / F.col("df"))).alias("weight"),
    )


def least_weight(df: int) -> Column:
    """The weight that a term of at most ``df`` records can't fall below, whatever its neighbours: from (records)."""
    return F.ln((F.col("records") + 1) / F.lit(df))


def units_of(symbols: DataFrame, facts: DataFrame, commits: DataFrame) -> DataFrame:
    """Text units of files (symbol names, documentation) and commits (subjects); exact duplicate rows count once, re-loaded commits by sha."""
    s = symbols.distinct().select(F.lit("file").alias("record_kind"), F.col("file_id").cast("string").alias("record_key"), F.col("symbol").alias("text"))
    d = facts.distinct().select(F.lit("file").alias("record_kind"), F.col("file_id").cast("string").alias("record_key"), F.col("doc").alias("text"))
    c = commits.select("sha", "subject").distinct().select(F.lit("commit").alias("record_kind"), F.col("sha").alias("record_key"), F.col("subject").alias("text"))
    return s.unionByName(d).unionByName(c).filter(F.col("record_key").isNotNull())
