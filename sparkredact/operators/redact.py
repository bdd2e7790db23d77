"""Value de-duplication (R1), placeholder numbering (W1/W2) and substitution.

All three work on the packed per-document entity array, so the whole
anonymisation of a document happens inside the task that holds its text --
no shuffle of text, no driver round-trip.  The array holds the entities of one
document, so its size is bounded by that document's length.

Entity struct fields used: ``seq, value, category, entity_type, semantic_role``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.binding import let
from ..functions.labels import label_for, localise
from ..functions.value_scan import substitute_once

MAPPING_FIELDS = ("ord", "original", "replacement", "category", "entity_type", "semantic_role")


def _related(a: Column, b: Column) -> Column:
    """Of lower-cased values."""
    return (F.instr(b, a) > 0) | (F.instr(a, b) > 0)


def greedy_dedup(ents: Column) -> Column:
    """Shortest-first (stable by seq); drop a value already kept, or one
    substring-related to a kept value when the two share entity_type or the
    longer (current) value carries a bundling marker.  Dropped values never
    suppress others, hence a fold rather than an anti-join."""
    ordered = F.array_sort(F.transform(ents, lambda e: F.struct(
        F.length(e["value"]).alias("len"), e["seq"].alias("seq"), F.lower(e["value"]).alias("low"), e.alias("e"))))

    def step(acc, x):
        dominated = F.exists(acc, lambda p: (p["e"]["value"] == x["e"]["value"]) | (
            _related(p["low"], x["low"])
            & ((p["e"]["entity_type"] == x["e"]["entity_type"]) | x["e"]["value"].rlike(vocab.BUNDLED_VALUE_PATTERN))))
        return F.when(dominated, acc).otherwise(F.array_append(acc, x))

    return let(ordered, lambda o: F.transform(F.aggregate(o, F.slice(o, 1, 0), step), lambda x: x["e"]))


def longest_first(ents: Column) -> Column:
    """Stable longest-first order (ties keep the input order)."""
    return F.transform(
        F.array_sort(F.transform(ents, lambda e, i: F.struct(
            (-F.length(e["value"])).alias("neg_len"), i.alias("i"), e.alias("e")))),
        lambda x: x["e"])


def localised_labels(ents: Column, language: Column) -> Column:
    """The label of each entity; each distinct one is translated once."""
    labels = F.transform(ents, lambda e: label_for(e["category"], e["entity_type"], e["semantic_role"]))
    translated = lambda d: F.transform(d, lambda x: localise(x, language))
    return let(labels, lambda names: let(F.array_distinct(names), lambda d: let(translated(d), lambda t: F.transform(
        names, lambda x: F.get(t, (F.array_position(d, x) - 1).cast("int"))))))


def running_numbers(labels: Column) -> Column:
    """Per element how many equal ones there are up to it: from its place among
    the sorted labels, less the place of the first equal one."""
    by_label = F.array_sort(F.transform(labels, lambda x, i: F.struct(x.alias("label"), i.alias("i"))))
    numbered = lambda s: let(F.transform(s, lambda x: x["label"]), lambda names: F.transform(
        s, lambda x, k: F.struct(x["i"].alias("i"), (k + 2 - F.array_position(names, x["label"])).alias("n"))))
    return F.transform(F.array_sort(let(by_label, numbered)), lambda x: x["n"])


def number_placeholders(ents: Column, language: Column) -> Column:
    """Walk entities longest-first; each gets ``[LABEL_n]`` where LABEL is
    the localised label and n counts that label so far in the document."""
    def mapped(ordered, labels, numbers):
        return F.transform(ordered, lambda e, i: F.struct(
            (i + 1).alias("ord"), e["value"].alias("original"),
            F.concat(F.lit("["), F.get(labels, i), F.lit("_"), F.get(numbers, i).cast("string"), F.lit("]")).alias("replacement"),
            e["category"].alias("category"), e["entity_type"].alias("entity_type"), e["semantic_role"].alias("semantic_role")))

    return let(longest_first(ents), lambda ordered: let(localised_labels(ordered, language), lambda labels: let(
        running_numbers(labels), lambda numbers: mapped(ordered, labels, numbers))))


def proposed_replacements(ents: Column, language: Column) -> Column:
    """The placeholder each entity is shown with, in the entities' own order;
    numbered longest-first over all of them, repeats included."""
    order = F.transform(F.array_sort(F.transform(ents, lambda e, i: F.struct((-F.length(e["value"])).alias("neg_len"), i.alias("i")))), lambda x: x["i"])
    shown = lambda at, m: F.transform(F.array_sort(F.arrays_zip(at.alias("i"), F.transform(m, lambda x: x["replacement"]).alias("r"))), lambda x: x["r"])
    return let(F.struct(order.alias("at"), number_placeholders(ents, language).alias("m")), lambda x: shown(x["at"], x["m"]))


def substitute(content: Column, mappings: Column) -> Column:
    """Literal, case-sensitive, replace-all, in mapping order; a later
    value may rewrite text inside an earlier placeholder (faithful mode)."""
    return F.aggregate(mappings, content,
                       lambda acc, m: F.replace(acc, m["original"], m["replacement"]))


def anonymize_packed(df: DataFrame, entities_col: str, content_col: str = "content",
                     language_col: str = "language", out_col: str = "anonymized",
                     mappings_col: str = "mappings", isolate: bool = False) -> DataFrame:
    """R1 -> W1 -> R5 for each document row; language defaults to ``it``.

    ``isolate`` substitutes in one pass over the text: leftmost, longest value
    first, and an inserted placeholder is never read again."""
    lang = F.coalesce(F.nullif(F.col(language_col), F.lit("")), F.lit("it"))
    return (df.withColumn(mappings_col, number_placeholders(greedy_dedup(F.col(entities_col)), lang))
              .withColumn(out_col, (substitute_once if isolate else substitute)(F.col(content_col), F.col(mappings_col))))
