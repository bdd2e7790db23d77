"""URL filter: fixed host and path rules first, then a path-template tree per host.

Level by level a host's paths become templates: a segment with few urls and labels
among many such siblings is variable and turns into ``*``, the others stay.  Sibling
templates that differ in their last plain segment and whose labelled shares
don't differ significantly are merged, and a merged template whose smoothed share
of bad labels is high is rejected.  All steps are joins and aggregates over
distinct paths with counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table

# A segment is plain with this many urls or labelled ones, whatever its share; and with two urls
# where its parent's children vary little: as many urls a child, or more, on average.
PLAIN_URLS, PLAIN_LABELS, FEW_URLS = 10, 4, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does.

    ``rules`` are (verdict, host and path): a rule fits its host and all
    subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, start = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, segments, n, bad, good) with their ``template``.

    A level is a round; rounds end where no node holds two urls, so the longest
    path that two urls share sets their number.
    """
    now = write_table(paths.withColumn("template", F.lit("")).withColumn("plain", F.lit(0)).withColumn("open", F.lit(True)), "paths")
    depth = 0
    while not (deep := now.where(F.col("open") & (F.size("segments") > depth))).isEmpty():
        depth += 1
        deep = deep.withColumn("segment", F.col("segments")[depth - 1])
        children = deep.groupBy("host", "template", "segment").agg(F.sum("n").alias("here"), F.sum(F.col("bad") + F.col("good")).alias("labelled"))
        children = write_table(children, "children")
        parents = children.groupBy("host", "template").agg(F.sum("here").alias("all"), F.count("*").alias("kinds"))
        nodes = children.join(parents, ["host", "template"])
        steady = (F.col("here") >= FEW_URLS) & (F.col("all") >= FEW_URLS * F.col("kinds"))
        plain = (nodes.where((F.col("here") >= PLAIN_URLS) | (F.col("labelled") >= PLAIN_LABELS) | steady)
                 .select("host", "template", "segment", F.lit(True).alias("is_plain")))
        # What is below a node with one url is variable to its end.
        single = parents.where(F.col("all") < 2).select("host", "template", F.lit(True).alias("single"))
        at = F.col("open") & (F.size("segments") >= depth)
        moved = (now.withColumn("segment", F.get("segments", F.lit(depth - 1))).join(plain, ["host", "template", "segment"], "left")
                 .join(single, ["host", "template"], "left").withColumn("part", F.when(F.col("is_plain"), F.col("segment")).otherwise("*")))
        rest = F.when(F.col("single") & F.col("is_plain").isNull(), F.repeat(F.lit("/*"), F.size("segments") - depth + 1)).otherwise(F.concat(F.lit("/"), "part"))
        now = write_table(moved.select(
            "host", "segments", "n", "bad", "good",
            F.when(at, F.concat("template", rest)).otherwise(F.col("template")).alias("template"),
            F.when(at & F.col("is_plain"), depth).otherwise(F.col("plain")).alias("plain"),
            (F.col("open") & ~F.coalesce(at & F.col("single"), F.lit(False))).alias("open")), "paths")
    return now.drop("open")


def judged(found: DataFrame, strength: float, limit: float, z: float) -> DataFrame:
    """Of paths with templates: host, template, branch (the least template merged with it), purity, rejected."""
    tops = found.groupBy("host", "template", "plain").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    whole = found.agg(F.sum("bad"), F.sum("good")).first()
    bad, good = whole[0] or 0, whole[1] or 0
    prior = bad / (bad + good) if bad + good else 0.0
    labelled = F.col("bad") + F.col("good")
    # Siblings: alike but for the last plain segment.
    parts = F.split("template", "/")
    family = F.when(F.col("plain") > 0, F.array_join(F.transform(parts, lambda x, i: F.when(i == F.col("plain"), "{}").otherwise(x)), "/")).otherwise(F.col("template"))
    rate = (F.col("bad") + strength * prior) / (labelled + strength)
    tops = tops.withColumn("family", family).withColumn("known", labelled > 0).withColumn("rate", rate)
    # Siblings of equal counts are alike, so a family is ordered by its distinct counts.
    alike = ["host", "family", "known", "bad", "good"]
    kinds = tops.groupBy(*alike).agg(F.min("template").alias("least"), F.count("*").alias("many"), F.first("rate").alias("rate"))
    kinds = kinds.withColumn("one", F.struct("rate", "least"))
    order = Window.partitionBy("host", "family", "known").orderBy("one")
    n, p = labelled + strength, F.col("rate")
    error = F.sqrt(p * (1 - p) / n + F.lag(p).over(order) * (1 - F.lag(p).over(order)) / F.lag(n).over(order))
    apart = F.when(F.lag("rate").over(order).isNull() | (p - F.lag(p).over(order) > z * error), 1).otherwise(0)
    kinds = kinds.withColumn("apart", apart).withColumn("place", F.sum("apart").over(order))
    branch = Window.partitionBy("host", "family", "known", "place")
    sums = F.sum(F.col("bad") * F.col("many")).over(branch), F.sum(labelled * F.col("many")).over(branch)
    purity = (sums[0] + strength * prior) / (sums[1] + strength)
    kinds = kinds.select(*alike, F.min("least").over(branch).alias("branch"), purity.alias("purity"), ((sums[1] > 0) & (purity >= limit)).alias("rejected"))
    # Unlabelled siblings are never merged.
    return tops.join(kinds, alike).select("host", "template", F.when(F.col("known"), F.col("branch")).otherwise(F.col("template")).alias("branch"), "purity", "rejected")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, strength: float = 4.0,
                limit: float = 0.8, z: float = 1.96, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    ``labels`` (page_id, bad) are the labelled urls; without them, those that a
    rule decides are, by its verdict.  A null url, or one without ``://``, has an
    empty host and path and no rule.  Where nothing is labelled all templates
    are allowed.  Repeated rows come back as often as given.
    """
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("segments", _segments(F.col("path")))
    if labels is None:
        bad = F.col("ruled") == "block"
    else:
        known = labels.groupBy(F.col("page_id").alias("_of")).agg(F.max("bad").alias("_bad"))
        rows = rows.join(known, F.col("page_id") == F.col("_of"), "left").drop("_of")
        bad = F.col("_bad") >= 1
    paths = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good"))
    paths = write_table(paths, "distinct-paths")
    found = templates(paths)
    verdicts = judged(found, strength, limit, z)
    of = found.select("host", "segments", "template").join(verdicts, ["host", "template"]).select("host", "segments", "template", "purity", "rejected")
    return rows.join(of, ["host", "segments"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
