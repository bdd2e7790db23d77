"""Ingest, review, audit and retention operators.

* ingest:    format gate (A2), HTML to text (A3), char count (A5), SHA-256 (A6)
* review:    latest decision (V1), bulk accept/remove (V2), active filter
             (B12), progress and summary counts (G8, G12)
* audit:     content-free JSON-lines events (A11)
* retention: TTL expiry (T1), access touch (T8), LRU byte budget (T2/W3)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims, vocab
from ..functions.binding import let

# ------------------------------------------------------------------ ingest


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))


def format_gate(files: DataFrame, name_col: str = "filename") -> DataFrame:
    """A2: supported extension -> accepted, else rejected with the reason."""
    ext = extension(F.col(name_col))
    supported = vocab.PLAIN_TEXT_EXTENSIONS + vocab.CONVERTER_EXTENSIONS
    listing = ", ".join(sorted(supported))
    return files.withColumn("ext", ext).withColumn("supported", ext.isin(supported)).withColumn(
        "reason", F.when(~F.col("supported"),
                         F.concat(F.lit("cannot read files of type "), ext, F.lit(f"; readable types are {listing}"))))


# (tag pattern, replacement) applied in order; all Java/RE2-compatible.
HTML_RULES = [
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
] + [(f"(?i)<h{n}\\b[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)] + [
    (r"(?i)</h[1-6]>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:p|div|ul|ol|tr|article|section|nav|title)>", "\n"),
    (r"<[^>]+>", ""),
]
SPACE_RULES = [(r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]
# The named character references that are read, by their code points.
NAMED_REFERENCES = {
    "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 32, "euro": 8364, "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220,
    "rdquo": 8221, "hellip": 8230, "laquo": 171, "raquo": 187, "agrave": 224, "aacute": 225, "acirc": 226, "auml": 228, "ccedil": 231, "egrave": 232,
    "eacute": 233, "ecirc": 234, "euml": 235, "igrave": 236, "iacute": 237, "ntilde": 241, "ograve": 242, "oacute": 243, "ocirc": 244, "ouml": 246,
    "ugrave": 249, "uacute": 250, "ucirc": 251, "uuml": 252, "szlig": 223, "Agrave": 192, "Auml": 196, "Egrave": 200, "Eacute": 201, "Ouml": 214, "Uuml": 220,
    "amp": 38,
}
REFERENCE_RE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,6});"


def character_references(text: Column) -> Column:
    """Numeric and named character references as their characters, each read once
    (``&amp;lt;`` gives ``&lt;``); what names no character stays as it is."""
    names = dims.map_lit([(name, chr(code)) for name, code in NAMED_REFERENCES.items()])

    def one(ref):
        body = F.substring(ref, F.lit(2), F.length(ref) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int")).when(
            body.startswith("#"), F.substring(body, F.lit(2), F.length(body)).cast("int"))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        # a character from its code point, by way of UTF-32
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.coalesce(F.when(valid, F.when(code == 160, F.lit(" ")).otherwise(char)), F.element_at(names, body), ref)

    gaps, refs = F.split(text, REFERENCE_RE, -1), F.transform(F.regexp_extract_all(text, F.lit(REFERENCE_RE), 0), one)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), refs.alias("r")), lambda x: F.array(x["g"], F.coalesce(x["r"], F.lit(""))))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    """A3: HTML page -> normalised Markdown-like text with regex rules
    (scripts, styles and comments dropped; headings, list items, breaks)."""
    def ruled(v, rules):
        for pat, rep in rules:
            v = F.regexp_replace(v, pat, rep.replace("\\", "\\\\").replace("$", "\\$"))
        return v

    # The references are read from a value that is made once.
    read = let(ruled(html, HTML_RULES), character_references)
    return F.regexp_replace(ruled(read, SPACE_RULES), r"^\s+|\s+$", "")


def fingerprint(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Char count (code points), UTF-8 byte size and SHA-256 hex."""
    b = F.encode(F.col(text_col), "UTF-8")
    return df.select("doc_id", F.length(text_col).cast("bigint").alias("char_count"),
                     F.octet_length(b).cast("bigint").alias("size_bytes"),
                     F.sha2(b, 256).alias("sha256"))


# ------------------------------------------------------------------ review


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """V1: the latest decision per (doc, seq) (ties: the larger status name
    is never relied upon -- decided_at then event order)."""
    return decisions.groupBy("doc_id", "seq").agg(
        F.max_by("status", F.struct("decided_at", "event_id")).alias("status"))


def review_state(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with their current review status (``proposed`` by default)."""
    lat = latest_decisions(decisions)
    return entities.join(lat, ["doc_id", "seq"], "left").withColumn(
        "status", F.coalesce("status", F.lit(vocab.DEFAULT_REVIEW_STATUS)))


def accept_all(state: DataFrame) -> DataFrame:
    """V2: everything not removed becomes accepted."""
    return state.withColumn("status", F.when(F.col("status") != "removed", F.lit("accepted"))
                            .otherwise(F.col("status")))


def remove_all(state: DataFrame) -> DataFrame:
    return state.withColumn("status", F.lit("removed"))


def review_progress(state: DataFrame) -> DataFrame:
    """Per document, counts by status, validated share and whether
    the anonymise step may run (nothing left in ``proposed``)."""
    g = state.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        F.count_if(F.col("status") == "proposed").alias("proposed"))
    return g.select("doc_id", "total", "accepted", "removed", "proposed",
                    (F.col("total") - F.col("removed")).alias("active"),
                    F.round(F.when(F.col("total") > 0, (F.col("accepted") + F.col("removed")) * 100.0 / F.col("total"))
                            .otherwise(F.lit(0.0)), 2).alias("validated_pct"),
                    (F.col("proposed") == 0).alias("gate_open"))


def active_entities(state: DataFrame) -> DataFrame:
    """Only accepted rows are substituted."""
    return state.where(F.col("status") == "accepted")


# ------------------------------------------------------------------ audit

AUDIT_FIELDS = ("timestamp", "event", "document_id")


def audit_event(ts: Column, event: str, doc_id: Column, **attrs: Column) -> Column:
    """One JSON line; only ids, counts, hashes and names -- never
    content, values or mappings (the caller passes whitelisted columns)."""
    return F.to_json(F.struct(ts.alias("timestamp"), F.lit(event).alias("event"),
                              doc_id.cast("string").alias("document_id"),
                              *[c.alias(k) for k, c in attrs.items()]))


# ------------------------------------------------------------------ retention


def access_touch(access_log: DataFrame, key: str = "doc_id", ts: str = "ts") -> DataFrame:
    """created_at = first access, last_accessed = latest access."""
    return access_log.groupBy(key).agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_accessed"))


def ttl_live(entries: DataFrame, now: Column, ttl_seconds: int = vocab.CACHE_TTL_SECONDS) -> DataFrame:
    """Drop entries older than the TTL (now - created_at > ttl)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return entries.where(age <= F.lit(ttl_seconds * 1_000_000).cast("bigint"))


def lru_keep(entries: DataFrame, budget_bytes: int = vocab.CACHE_MAX_BYTES,
             bucket_seconds: int = 3600) -> DataFrame:
    """Evicting least-recently-used entries until the total fits keeps
    exactly the newest entries whose newest-first running size is within the
    budget.  The running sum is distributed: per time bucket totals (one row
    per bucket) give each bucket's offset, then a window inside each bucket
    -- no single-partition global window.  Ties in last_accessed: the later
    insert is newer (the earlier one goes first)."""
    b = F.floor(F.unix_seconds(F.col("last_accessed").cast("timestamp")) / bucket_seconds)
    e = entries.withColumn("bucket", b)
    totals = e.groupBy("bucket").agg(F.sum("size_bytes").alias("bsize"))
    # offsets over the (small, bounded) bucket table: bytes in newer buckets
    off = totals.withColumn("newer", F.coalesce(F.sum("bsize").over(
        Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = (Window.partitionBy("bucket")
         .orderBy(F.col("last_accessed").desc(), F.col("created_at").desc(), F.col("doc_id").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    run = e.join(F.broadcast(off.select("bucket", "newer")), "bucket") \
           .withColumn("running", F.col("newer") + F.sum("size_bytes").over(w))
    return run.where(F.col("running") <= budget_bytes).drop("bucket", "newer")
