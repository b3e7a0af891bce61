"""The pN_ queries: each operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import p1_spans, p2_pairs, p3_origin, p4_terms, p5_functions, p6_syntax, p7_ranking, p8_leaks, p9_mixing, p10_abuse
from codestrata.session import table

MEASURES = ["pagerank", "fan_in", "churn_commits", "loc"]


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return p1_spans.spans(table(spark, d, "files").select(F.col("file_id").alias("id"), "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_spans.record_pairs(*_runs(spark, d))


def p1_shared(spark: SparkSession, d: str) -> DataFrame:
    """Every file, with the characters of it that also stand in another file."""
    s = p1_spans.shared_lengths(*_runs(spark, d)).withColumnRenamed("id", "file_id")
    files = table(spark, d, "files").select("file_id", "path", F.char_length("text").alias("chars")).distinct()
    return files.join(s, "file_id", "left").select("file_id", "path", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"))


def p2_surprise(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs.surprise(table(spark, d, "commit_files"), "repo", "sha", "path", least=1).withColumnsRenamed({"g": "repo", "a": "path_a", "b": "path_b"})


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every observed pair with its exact counts and lift."""
    b = p2_pairs.baskets(table(spark, d, "commit_files"), "repo", "sha", "path", 2, 30)
    n = b.select("g", "c").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    lift = F.round(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")), 6)
    return p2_pairs.pair_counts(b, 1)[0].join(F.broadcast(n), "g").select(F.col("g").alias("repo"), F.col("a").alias("path_a"), F.col("b").alias("path_b"), "n", "n_a", "n_b", "n_ab", lift.alias("lift"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose joint count the null model makes unlikely (see ``p2_pairs.UNLIKELY``), then the exact check of the definition. Pairs below 6 common
    commits can't be cases, so their tails aren't asked for."""
    s = p2_pairs.surprise(table(spark, d, "commit_files"), "repo", "sha", "path", least=6).filter(F.col("p_value") <= p2_pairs.UNLIKELY)
    s = s.filter((F.col("n_ab") >= 6) & (F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b")))
    return s.select(F.col("g").alias("repo"), F.col("a").alias("path_a"), F.col("b").alias("path_b"))


def p3_origins(spark: SparkSession, d: str) -> DataFrame:
    return p3_origin.origins(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_origins(spark, d).filter("found").select("file_id").distinct()


def p4_terms_of_records(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).withColumn("weight", F.round("weight", 6))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms.term_weights(p4_terms.units_of(table(spark, d, "symbols"), table(spark, d, "file_facts"), table(spark, d, "commits")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms whose weight reaches what five records leave to any term, then the exact check of the definition."""
    w = _weights(spark, d).filter(F.col("weight") >= p4_terms.least_weight(5))
    exact = F.col("df").between(2, 5) & ((F.col("record_kind") == "commit") | (F.col("tf") >= 3))
    return w.filter(exact).select("record_kind", "record_key", "term")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code-description pairs of the functions with a real description."""
    p = p5_functions.documented(table(spark, d, "funcs"), table(spark, d, "files"))
    return p.filter("real").select("file_id", "path", "func_name", "line", "params", "code", "description", "origin")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("file_id", "line").distinct()


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return p6_syntax.syntax(table(spark, d, "files"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return p6_syntax.rates(p6_files(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_files(spark, d).filter(~F.col("valid")).select("file_id").distinct()


def _order(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics")
    return p7_ranking.leximin(p7_ranking.latest(m, "file_id", "scanned_at", ["repo", *MEASURES]), "file_id", "repo", MEASURES)


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    """Every file with its ascending vector and its place in the repository."""
    return _order(spark, d).select("file_id", "repo", *[F.round(F.col("percentiles")[i], 6).alias(f"p{i + 1}") for i in range(len(MEASURES))], "place")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose leximin vector, but for its weakest score, lies within the repository's top tenth."""
    return p7_ranking.tops(_order(spark, d)).select("file_id")


def p8_leaks_in_documents(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks_in_documents(spark, d).filter("words >= 12").select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return p9_mixing.plan(p9_mixing.measured(table(spark, d, "documents")), table(spark, d, "source_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the flow leaves short, then the exact check of the definition."""
    return p9_report(spark, d).filter("short and capacity_tokens < target_tokens").select("source")


def p9_blend(spark: SparkSession, d: str) -> DataFrame:
    m = p9_mixing.measured(table(spark, d, "documents"))
    return p9_mixing.select(m, p9_mixing.plan(m, table(spark, d, "source_targets"))[1])


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return p10_abuse.abuse(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return p10_abuse.rates(p10_scores(spark, d), table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter("score >= 0.5").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
