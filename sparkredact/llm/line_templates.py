"""Line dedup by a log-template tree of fixed depth.

A line's digits are masked; its leaf is its token count and its leading tokens.
In a leaf that holds several lines the tokens most of them share position by
position are the template and the rest are variable fields; lines near enough to
it belong to it, the others part by a frequent token and grow templates in turn.  A template that recurs in
documents which are otherwise their own is boilerplate and its lines are dropped.

Copies and near copies of a document repeat most of its lines: a group of texts
that the Jaccard join links is one voice, however many texts it has, and a template
recurs if enough voices hold it, whatever share of each text it makes up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkredact.llm import jaccard_join
from sparkredact.llm.common import write_table

# Runs of blanks and tabs that are not one blank already.
_RUNS = "[ \\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]"
# Masks that may be broadcast, 32 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _long_lines(texts: DataFrame, min_tokens: int, *cols: str) -> DataFrame:
    """``cols``, line, tokens: each masked line of at least ``min_tokens`` tokens once a text.

    Tokens are what runs of blanks and tabs part.  Digits and runs are masked in the
    whole text at once, and the outer explode keeps that from being done twice, for a filter too.
    """
    lines = F.transform(F.array_distinct(_masked_lines(F.col("_text"))), lambda x: F.struct(x.alias("line"), _tokens(x).alias("tokens")))
    rows = texts.select(*cols, F.explode_outer(F.filter(lines, lambda x: x.tokens >= min_tokens)).alias("x"))
    return rows.where("x is not null").select(*cols, "x.line", "x.tokens")


def _masked_lines(text: Column) -> Column:
    """Lines of the text, digits masked, trimmed, each run of blanks and tabs one blank."""
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "#"), _RUNS, " ")
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x))


def _tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _entries(texts: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """Per text and mask (hash of the masked line) once: doc (hash of the text), mask, leaf (tokens and ``leading`` first ones)."""
    rows = _long_lines(texts, min_tokens, "_doc")
    return rows.select(F.col("_doc").alias("doc"), F.xxhash64("line").alias("mask"),
                       F.xxhash64("tokens", F.substring_index("line", " ", leading)).alias("leaf"))


def _generalised(texts: DataFrame, entries: DataFrame, min_tokens: int, likeness: float, min_docs: int) -> DataFrame:
    """mask, template: lines that belong to one of the templates of a leaf with several lines."""
    masks = entries.groupBy("leaf", "mask").agg(F.count("*").alias("n"))
    several = masks.groupBy("leaf").agg(F.count("*").alias("masks"), F.sum("n").alias("total")).where((F.col("masks") > 1) & (F.col("total") >= min_docs))
    masks = write_table(masks.join(several.drop("masks"), "leaf"), "shared-leaves")
    # The words of those lines, once each.
    rows = _long_lines(texts, min_tokens).select(F.xxhash64("line").alias("mask"), "line")
    rows = rows.join(F.broadcast(masks) if masks.count() <= BROADCAST_ROWS else masks, "mask").groupBy("mask").agg(
        F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("total").alias("total"), F.min("line").alias("line"))
    tokens = F.split("line", " ")
    rows = write_table(rows.select("leaf", "mask", "n", "total", tokens.alias("tokens")), "leaf-lines")
    found = []
    while not rows.isEmpty():
        done, rows = _round(rows, likeness, min_docs)
        found.append(done)
    return reduce(DataFrame.unionAll, found) if found else rows.select("mask", F.lit(0).cast("long").alias("template"))


def _round(rows: DataFrame, likeness: float, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """mask, template of the lines near the majority of their leaf, and the others in smaller leaves.

    The others part by their token at the position of the most frequent token
    outside the majority; rare tokens there stay together.  That position then
    never parts them again, so rounds end.
    """
    counts = (rows.select("leaf", "n", "total", F.posexplode("tokens").alias("pos", "token"))
              .groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
              .withColumn("major", 2 * F.col("n") > F.col("total")).where(F.col("major") | (F.col("n") >= min_docs)))
    counts = write_table(counts, "leaf-tokens")
    forms = counts.groupBy("leaf").agg(
        F.collect_list(F.when(F.col("major"), F.struct("pos", "token"))).alias("shared"),  # one token a position at most
        F.max(F.when(~F.col("major"), F.struct("n", (-F.col("pos")).alias("at")))).alias("next"))
    forms = forms.withColumn("at", -F.col("next.at")).drop("next")
    own = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    hits = F.size(F.array_intersect(own, "shared"))
    judged = rows.join(forms, "leaf", "left").withColumn("near", F.coalesce(hits >= likeness * F.size("tokens"), F.lit(False)))
    judged = write_table(judged.drop("shared"), "leaf-judged")
    done = judged.where("near").select("mask", F.xxhash64("leaf", F.lit("template")).alias("template"))
    left = judged.where("not near and at is not null").withColumn("token", F.get("tokens", F.col("at")))
    frequent = counts.where(F.col("n") >= min_docs).select("leaf", F.col("pos").alias("at"), "token", F.lit(True).alias("frequent"))
    left = left.join(frequent, ["leaf", "at", "token"], "left")
    left = left.withColumn("leaf", F.xxhash64("leaf", "at", F.when(F.col("frequent"), F.col("token")), F.coalesce("frequent", F.lit(False))))
    left = write_table(left.select("leaf", "mask", "n", "tokens"), "leaf-rest")
    several = left.groupBy("leaf").agg(F.count("*").alias("masks"), F.sum("n").alias("total")).where((F.col("masks") > 1) & (F.col("total") >= min_docs))
    return done, write_table(left.join(several.drop("masks"), "leaf").select(*rows.columns), "leaf-lines")


def _voices(texts: DataFrame, carriers: DataFrame) -> DataFrame:
    """doc, voice: the least text of the group of copies and near copies that a carrier (doc) is in."""
    # The carriers grow with the texts: never broadcast, so the plan is the same at any size.
    # The join reads the texts several times, so they are picked once and written.
    held = texts.join(carriers.hint("merge"), F.col("_doc") == F.col("doc"), "left_semi").dropDuplicates(["_doc"])
    held = write_table(held, "carrier-texts")
    found = jaccard_join.join(held, "_doc", "_text")
    return write_table(found.select(F.col("doc_id").alias("doc"), F.col("component_id").alias("voice")).distinct(), "voices")


def recurring(texts: DataFrame, leading: int, min_tokens: int, likeness: float, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Lines to drop, as (doc, mask), and the templates that recur, as (template, voices)."""
    entries = write_table(_entries(texts, leading, min_tokens).distinct(), "lines")
    general = write_table(_generalised(texts, entries, min_tokens, likeness, min_docs), "templates")
    placed = entries.join(general, "mask", "left").withColumn("template", F.coalesce("template", "mask"))
    # A text counts once for a template, whichever of its lines belong to it.
    several = placed.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    shared = write_table(placed.join(several, "template", "left_semi").select("doc", "mask", "template"), "shared-lines")
    voices = _voices(texts, write_table(shared.select("doc").distinct(), "carriers"))
    found = (shared.join(voices, "doc").select("template", "voice").distinct().groupBy("template").agg(F.count("*").alias("voices"))
             .where(F.col("voices") >= min_docs))
    found = write_table(found, "recurring")
    return shared.join(found, "template", "left_semi").select("doc", "mask"), found


def drop_recurring(docs: DataFrame, text_col: str = "text", leading: int = 3, min_tokens: int = 5, likeness: float = 0.75,
                   min_docs: int = 3, count_col: str | None = None) -> DataFrame:
    """``docs``, all columns, without the lines of recurring templates in ``text_col``.

    A template recurs if texts of at least ``min_docs`` groups have it; copies and
    near copies (five-word shingles of similarity 0.75) are one group.  Lines
    of fewer than ``min_tokens`` tokens stay.  Null texts stay null, a text whose
    lines all go becomes empty, and every row is kept; repeated rows are cleaned
    alike.  ``count_col`` names a column for the number of dropped lines.
    """
    doc = F.xxhash64(text_col, F.length(text_col))
    texts = docs.select(doc.alias("_doc"), docs[text_col].alias("_text")).where("_text is not null")
    gone, _ = recurring(texts, leading, min_tokens, likeness, min_docs)
    # Bounded by the lines of one text.
    gone = gone.groupBy("doc").agg(F.collect_set("mask").alias("masks")).select(F.col("doc").alias("_doc"), F.col("masks").alias("_masks"))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    # Texts meet their lines by a shuffle at any size, since these grow with them; a text is dealt once.
    rows = docs.select(row, doc.alias("_doc")).join(gone.hint("merge"), "_doc", "left")
    text = F.col(f"_row.`{text_col}`")
    lines = F.split(text, "\n")
    kept = F.filter(F.arrays_zip(lines.alias("raw"), _masked_lines(text).alias("masked")), lambda x: ~(
        (_tokens(x.masked) >= min_tokens) & F.array_contains("_masks", F.xxhash64(x.masked))))
    rows = rows.withColumn("_kept", F.when(F.col("_masks").isNotNull(), F.transform(kept, lambda x: x.raw)))
    clean = F.when(F.col("_masks").isNull(), text).otherwise(F.array_join("_kept", "\n"))
    out = [clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if count_col:
        out.append(F.when(F.col("_masks").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).alias(count_col))
    return rows.select(*out)
