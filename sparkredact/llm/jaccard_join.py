"""Exact Jaccard join of shingle sets: size-aware, light sets and heavy sets apart.

Documents with equal sets form a class, known by its first row.  Two classes of
sizes n and m link when they share at least ``need(n, m)`` shingles.

* Light classes (size up to a boundary) enumerate, for every partner size, all
  subsets of exactly ``need`` shingles; classes that meet in one list link.
* Heavy classes scan inverted lists, of the shingles that must hold a common one
  (the rarest first, so passages that many documents share stay out of them).
  Long lists are dealt into pairs of blocks, which return only what sketches leave.

The boundary is where enumerating costs more than scanning, both counted over
the whole table.  Each class is first compared with a few members of its lists,
drawn by hash.  What these link is one component; members of different
components in a list are then all compared, so no link between components is
lost, while a large group of near copies costs a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkredact.llm.common import write_table
from sparkredact.llm.components import components
from sparkredact.llm.shingles import shingle_set

# Light sets are at most this large: a subset list stays short. Larger ones go to the lists.
LARGEST_LIGHT = 12
# Frequent shingles known to the ordering. It decides speed alone, never which pairs link.
FREQUENT = 1 << 17
# Comparisons of a class before its lists are searched in full for other components.
PARTNERS = 8
# Longer lists are compared by blocks of at most some ``BLOCK`` members, shorter ones by a join.
SHORT, BLOCK = 32, 512
# Rows of 50 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def need(n, m):
    """Least intersection of sets of n and m with 100 * shared >= 75 * union."""
    return (3 * (n + m) + 6) // 7


def probe_length(n):
    """Rarest shingles of a set of which one is in any partner that is not larger."""
    return n - (3 * n + 3) // 4 + 1


def index_length(n):
    """The same against partners that are not smaller."""
    return n - (6 * n + 6) // 7 + 1


def subsets(n: int, boundary: int) -> Iterator[tuple[int, int, int]]:
    """(smaller size, larger size, shingles to share) for each light partner size of n."""
    for m in range((3 * n + 3) // 4, min(4 * n // 3, boundary) + 1):
        yield min(n, m), max(n, m), need(n, m)


def sketch(own: np.ndarray) -> bytes:
    """A bit for each range of hashes that holds one of the set; eight times as many ranges as hashes, 16384 at most."""
    log = min(max((8 * len(own) - 1).bit_length(), 6), 14)
    bits = np.zeros(1 << log, np.uint8)
    bits[own >> np.uint64(64 - log)] = 1
    return np.packbits(bits).tobytes()


def most_shared(n: int, one: bytes, m: int, two: bytes) -> int:
    """Upper bound of the intersection: each range that one set alone touches holds an element of its own."""
    x, y = np.unpackbits(np.frombuffer(one, np.uint8)), np.unpackbits(np.frombuffer(two, np.uint8))
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).any(axis=1)
    return (n + m - int((x != y).sum())) // 2


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles met in many documents, ascending by hash, with the count seen (2 x k)."""
    block = 2_000_000  # hashes counted at a time

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 2].view(np.int64)), pa.array(c[c > 2])], names=["h", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py()))
                size += len(held[-1])
                if size >= block:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = (docs.select(F.col("text").cast("binary")).mapInArrow(count, "h long, c long")
             .groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow())
    h, c = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    by = np.argsort(h)
    return np.stack([h[by], c[by].astype(np.uint64)])


def _digests(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Per row: rid, doc_id, text_hash, n, fp (digest of the set), lead (shingles that may be indexed), sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        for batch in batches:
            sizes, fps, leads, sketches = [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py())
                n = len(own)
                sizes.append(n)
                sketches.append(sketch(own))
                fps.append(xxhash.xxh3_128_digest(own.tobytes()) if n else None)
                if len(common):  # one order for all sets: light ones meet heavy ones in the lists
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.lexsort((own, np.where(common[at] == own, times[at], 0)))]
                leads.append(own[:n if n <= LARGEST_LIGHT else probe_length(n)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(leads, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "n", "fp", "lead", "sketch"])

    rows = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
            .mapInArrow(digest, "doc_id long, text_hash long, n long, fp binary, lead binary, sketch binary"))
    return write_table(rows.withColumn("rid", F.monotonically_increasing_id()), "digests")


def _boundary(able: DataFrame) -> int:
    """Largest light size: enumerating a set's subsets costs no more than scanning its lists."""
    small = able.where(F.col("n") <= LARGEST_LIGHT).dropDuplicates(["fp"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, lead in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(lead, np.int64)[:probe_length(n)])], names=["h"])

    rows, keys = (small.select("n", "lead").mapInArrow(lists, "h long")
                  .agg(F.count("*"), F.approx_count_distinct("h")).first())
    length = rows / max(keys, 1)
    light = 0
    for n in range(1, LARGEST_LIGHT + 1):
        from math import comb

        if sum(comb(n, c) for _, _, c in subsets(n, LARGEST_LIGHT)) > probe_length(n) * (1 + length):
            break
        light = n
    return light


def _entries(classes: DataFrame, boundary: int) -> DataFrame:
    """List entries (key, cls, n, pos): of subsets with pos -1, of shingles with their rank in the set."""
    least_heavy = (3 * (boundary + 1) + 3) // 4

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, sizes, ranks = [], [], [], []

            def add(found: np.ndarray, rank: np.ndarray, cls: int, n: int) -> None:
                keys.append(found)
                ranks.append(rank)
                owners.append(np.full(len(found), cls))
                sizes.append(np.full(len(found), n, np.int32))

            for cls, n, lead in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(lead, np.uint64)
                if n <= boundary:
                    found = [xxhash.xxh3_64_intdigest(bytes([small, large]) + b"".join(part))
                             for small, large, c in subsets(n, boundary)
                             for part in combinations([x.tobytes() for x in own], c)]
                    add(np.array(found, np.uint64), np.full(len(found), -1, np.int32), cls, n)
                if n >= least_heavy:
                    found = own[:probe_length(n)]
                    add(found, np.arange(len(found), dtype=np.int32), cls, n)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners), pa.int64()),
                     pa.array(np.concatenate(sizes)), pa.array(np.concatenate(ranks))], names=["key", "cls", "n", "pos"])

    return classes.select("cls", "n", "lead").mapInArrow(entries, "key long, cls long, n int, pos int")


def _sets(docs: DataFrame, digests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole sets of the wanted classes (cls), computed anew from their texts.

    Few classes are in a pair that the filters left.  Up to ``BROADCAST_ROWS`` of
    them go to the texts; more are joined by a shuffle.
    """
    reps = write_table(digests.join(wanted, F.col("rid") == F.col("cls"), "left_semi").select("rid", F.col("doc_id").alias("of_doc"), "fp"), "wanted")
    few = reps.count() <= BROADCAST_ROWS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, found = [], []
            for rid, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = shingle_set(text.as_py()).tobytes()
                if xxhash.xxh3_128_digest(own) == fp:  # a repeated doc_id may have other texts
                    rids.append(rid)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(found, pa.binary())], names=["rid", "own"])

    rows = docs.join(F.broadcast(reps) if few else reps, F.col("doc_id") == F.col("of_doc"))
    return write_table(rows.select("rid", "fp", F.col("text").cast("binary")).mapInArrow(sets, "rid long, own binary"), "sets")


def _links(pairs: DataFrame, docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold; sketches spare most others the comparison."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                kept.append(int((y[at] == x).sum()) >= need(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, one, two = (batch.column(i).to_pylist() for i in range(2, 6))
            kept = [most_shared(*x) >= need(x[0], x[2]) for x in zip(n, one, m, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one = digests.select(F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = digests.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sketched = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    pairs = write_table(sketched.mapInArrow(may, "a long, b long"), "pairs")
    sets = _sets(docs, digests, pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct())
    one = sets.select(F.col("rid").alias("a"), F.col("own").alias("own_a"))
    two = sets.select(F.col("rid").alias("b"), F.col("own").alias("own_b"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b").mapInArrow(check, "a long, b long")
    return write_table(found, "links")


def near_in_blocks(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks of a list that sizes, ranks, components and sketches let link.

    A block holds arrays ``cls``, ``n``, ``pos`` and ``component``, and ``sketch``, a list."""
    bits = [[np.unpackbits(np.frombuffer(s, np.uint8)) for s in x["sketch"]] for x in (left, right)]
    widths = [np.array([len(b) for b in some]) for some in bits]
    found = []
    # Sizes that may link differ by a third at most, and so by one power of two.
    for v, w in ((v, w) for v in np.unique(widths[0]) for w in np.unique(widths[1]) if max(v, w) <= 2 * min(v, w)):
        i, j = np.flatnonzero(widths[0] == v), np.flatnonzero(widths[1] == w)
        least = min(v, w)
        x, y = (np.stack([some[k] for k in at]).reshape(len(at), least, -1).any(axis=2).astype(np.float32) for some, at in zip(bits, (i, j)))
        n, m = left["n"][i][:, None], right["n"][j]
        p, q = left["pos"][i][:, None], right["pos"][j]
        c, d = left["cls"][i][:, None], right["cls"][j]
        apart = (x.sum(axis=1)[:, None] + y.sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)  # ranges that one set alone touches
        first = (n < m) | (n == m) & (c < d)
        may = ((left["component"][i][:, None] != right["component"][j]) & (c != d) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
               & (np.minimum(n - p, m - q) >= need(n, m)) & np.where(first, p < index_length(n), q < index_length(m))
               & ((n + m - apart) // 2 >= need(n, m)))
        a, b = np.nonzero(may)
        found.append((i[a], j[b]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _long_list_pairs(entries: DataFrame, digests: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in ``entries`` (key, cls, n, pos, component, length) that may link.

    Each list is dealt into blocks by hash, each two blocks of it are one group."""
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    dealt = entries.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.join(digests.select(F.col("rid").alias("cls"), "sketch"), "cls")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "pos", "component", "sketch")

    def compare(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in ("cls", "n", "pos", "component", "own")}
        col["n"], col["pos"] = col["n"].astype(np.int64), col["pos"].astype(np.int64)
        sketches = group.column("sketch").to_pylist()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()

        def block(k: int) -> dict:
            at = np.flatnonzero(col["own"] == k)
            return {c: v[at] for c, v in col.items()} | {"sketch": [sketches[x] for x in at]}

        left, right = block(i), block(j)
        x, y = near_in_blocks(left, right)
        a, b = left["cls"][x], right["cls"][y]
        a, b = np.minimum(a, b), np.maximum(a, b)
        ab = np.unique(np.stack([a, b]), axis=1)
        return pa.table({"a": pa.array(ab[0], pa.int64()), "b": pa.array(ab[1], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _may_link(x: str, y: str):
    """Sizes of two entries of a list, and what follows their shingle, allow a link.

    Exact for the first shingle the two sets share, and every linked pair has one.
    """
    n, m, i, j = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (F.least(n - i, m - j) >= F.floor((3 * (n + m) + 6) / 7))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash.

    A null, empty or wordless text has no shingle and links with nothing; a row
    without a doc_id neither, and its component_id is null.  Repeated rows come
    back as often as given.  Only the two named columns are read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    digests = _digests(docs, _frequent(docs))
    able = digests.where("n > 0 and doc_id is not null")
    classes = able.groupBy("fp").agg(F.min("rid").alias("cls"), F.first("n").alias("n"), F.first("lead").alias("lead"))

    by_key = Window.partitionBy("key")
    entries = _entries(classes, _boundary(able)).withColumn("length", F.count("*").over(by_key)).where("length > 1").drop("length")
    entries = write_table(entries, "entries")

    # Lists of subsets link all their members to their smallest set.
    member = F.struct("n", "cls", "pos")
    light = entries.where("pos < 0")
    stars = (light.join(light.groupBy("key").agg(F.min(member).alias("other")), "key").where(F.col("other.cls") != F.col("cls")).select("cls", "other"))
    # In the others each member meets the one before it in an order by chance, of its own in every list;
    # a class keeps ``PARTNERS`` of these at most, which join most of a large group of near copies.
    chance = by_key.orderBy(F.xxhash64("cls", "key"), "cls")
    met = (entries.where("pos >= 0").withColumn("other", F.lag(member).over(chance))
           .where((F.col("other.cls") != F.col("cls")) & _may_link("other.", ""))
           .groupBy("cls", F.pmod("key", F.lit(PARTNERS)).alias("slot")).agg(F.min_by("other", F.xxhash64("cls", "other.cls")).alias("other")).select("cls", "other"))
    stars = stars.unionAll(met).select(F.least("cls", "other.cls").alias("a"), F.greatest("cls", "other.cls").alias("b")).distinct()
    first = components(_links(stars, docs, digests))

    # Lists that still hold more than one component: all their pairs of different ones.
    placed = (entries.where("pos >= 0").join(first, F.col("cls") == F.col("node"), "left")
              .withColumn("component", F.coalesce("component", "cls")).drop("node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length")).where("lo < hi").select("key", "length")
    placed = write_table(placed.join(mixed, "key"), "mixed-lists")
    short = placed.where(F.col("length") <= SHORT)
    x = short.select("key", *(F.col(c).alias(f"x_{c}") for c in ("cls", "n", "pos", "component")))
    y = short.select("key", *(F.col(c).alias(f"y_{c}") for c in ("cls", "n", "pos", "component")))
    pairs = (x.join(y, "key").where("x_component <> y_component and (x_n < y_n or x_n = y_n and x_cls < y_cls)")
             .where(F.col("x_pos") < F.col("x_n") - F.floor((6 * F.col("x_n") + 6) / 7) + 1).where(_may_link("x_", "y_"))
             .select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")))
    pairs = pairs.unionAll(_long_list_pairs(placed.where(F.col("length") > SHORT), digests)).distinct()
    rest = _links(pairs, docs, digests)
    # The first components, as edges to their least member, and the links between them.
    whole = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(rest))

    owners = able.groupBy("fp").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("least_doc"))
    rooted = owners.join(whole, F.col("cls") == F.col("node"), "left").select("fp", "least_doc", F.coalesce("component", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return (digests.withColumn("fp", F.when(F.col("doc_id").isNotNull(), F.col("fp"))).join(named, "fp", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the least of their component.

    Rows that link with nothing stay, and of a repeated row one.  Only the keys
    of what goes are joined, broadcast up to ``BROADCAST_ROWS`` of them.
    """
    found = write_table(join(docs, id_col, text_col), "components")
    keys = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    gone = write_table(found.where("component_id <> doc_id").select(*keys).distinct(), "gone")
    again = write_table(found.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).count().where("count > 1").drop("count"), "repeated")

    def matching(rows: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
        keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed
        return rows.join(keyed, (rows[id_col] == F.col("_id")) & (F.xxhash64(rows[text_col]) == F.col("_hash")), how)

    kept = matching(docs, gone, "left_anti")
    if again.limit(1).count():
        kept = matching(kept, again, "left_anti").unionAll(matching(kept, again, "left_semi").dropDuplicates([id_col, text_col]))
    return kept
