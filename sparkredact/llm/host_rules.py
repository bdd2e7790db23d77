"""Host-level quality rules.

Per document, counts of words, symbols, repeated lines and repeated five-word
windows decide a few rules.  Per host the failures of each rule are summed and
shrunk to the corpus with a beta prior fitted by moments; a host whose shrunk
rate is too high is rejected, and its verdict joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table

_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the counts of each text; arrays stay inside the row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), text.alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    rows = rows.select(
        "doc_id", "host", F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"))
    rows = rows.select(
        "doc_id", "host", "word_chars", "n_symbols", "h", F.size("h").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # Hashes of pairs, of fours, of the windows of five: each from the one before, shifted.
    rows = rows.withColumn("h2", _shifted("h", "h", 1))
    rows = rows.withColumn("h4", _shifted("h2", "h2", 2))
    rows = rows.withColumn("windows", F.when(F.col("n_words") >= 5, F.slice(_shifted("h4", "h", 4), 1, (F.col("n_words") - 4).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.drop("h", "h2", "h4")
    # Windows with their place, equal ones side by side; only where any is repeated.
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x: bigint, i: int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none)).drop("windows")
    n = F.size("placed")
    after = F.when(n > 1, F.slice("placed", 2, n)).otherwise(none)
    before = F.concat(F.array(F.lit(None).cast("struct<x: bigint, i: int>")), F.when(n > 1, F.slice("placed", 1, n - 1)).otherwise(none))
    rows = rows.withColumn("after", after).withColumn("before", before)
    same = F.zip_with(F.zip_with("placed", "before", lambda a, b: F.struct(a.i.alias("i"), a.x.alias("x"), (a.x == b.x).alias("eq"))),
                      "after", lambda a, b: F.when(F.coalesce(a.eq, F.lit(False)) | F.coalesce(a.x == b.x, F.lit(False)), a.i))
    rows = rows.withColumn("at", F.sort_array(F.filter(F.when(n > 0, same).otherwise(F.array().cast("array<int>")), lambda i: i.isNotNull()))).drop("placed", "before", "after")
    # Each repeated window covers its words up to the next repeated one.
    following = F.when(F.size("at") > 1, F.slice("at", 2, F.size("at"))).otherwise(F.array().cast("array<int>"))
    covered = F.aggregate(F.zip_with("at", following, lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5))), F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("at")


def _shifted(left: str, right: str, by: int) -> Column:
    """Hash of each element of ``left`` with the one of ``right`` that many places on; null past the end."""
    moved = F.when(F.size(right) > by, F.slice(right, by + 1, F.size(right))).otherwise(F.array().cast("array<bigint>"))
    return F.zip_with(left, moved, lambda a, b: F.xxhash64(a, b))


# Rules of a document; a host is judged by each. The first two make base_failed.
def rules() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_verdicts(counts: DataFrame, limit: float = 0.5) -> DataFrame:
    """host, rejected and each rule's shrunk failure rate.

    Each rule's prior is a beta distribution with the mean of all documents and
    the variance of the hosts' rates beyond what their sizes explain; with no
    such variance every host has the corpus' rate.
    """
    names = list(rules())
    hosts = write_table(counts.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(c.cast("int")).alias(k) for k, c in rules().items())), "hosts")
    moments = []
    for k in names:
        moments += [(F.sum(k) / F.sum("n")).alias(f"m_{k}"), F.sum(F.col(k) * F.col(k) / F.col("n")).alias(f"q_{k}")]
    whole = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("nn"), *moments).first()
    out = hosts
    for k in names:
        mean = whole[f"m_{k}"] or 0.0
        strength = None
        if whole["hosts"] and whole["hosts"] > 1 and 0 < mean < 1:
            # Moments of the beta-binomial: between-host variance over n * mean * (1 - mean).
            spread = (whole[f"q_{k}"] - whole["n"] * mean * mean) / (mean * (1 - mean))
            room = whole["n"] - whole["nn"] / whole["n"]
            rho = min(max((spread - (whole["hosts"] - 1)) / max(room - (whole["hosts"] - 1), 1e-9), 0.0), 0.999)
            strength = (1 - rho) / rho if rho > 0 else None
        elif whole["hosts"]:
            strength = 1.0
        rate = F.lit(float(mean)) if strength is None else (F.col(k) + strength * mean) / (F.col("n") + strength)
        out = out.withColumn(f"{k}_rate", rate)
    bad = F.greatest(*(F.col(f"{k}_rate") for k in names), F.lit(0.0)) > limit
    return out.select("host", bad.alias("rejected"), *(f"{k}_rate" for k in names))


def judge(docs: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed, host_rejected and kept.

    A null text has no words and fails the base rules.  Documents of a null host
    are judged together as one host.  Repeated rows count each.  An empty table
    gives no row.  Only the three named columns are read.
    """
    counts = write_table(_counts(docs, id_col, text_col, host_col), "counts")
    verdicts = host_verdicts(counts, limit).withColumnRenamed("host", "_of")
    failed = rules()["short"] | rules()["repeats"]
    return (counts.join(verdicts, F.col("host").eqNullSafe(F.col("_of")), "left").drop("_of")
            .withColumn("base_failed", failed).withColumnRenamed("rejected", "host_rejected")
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))
