"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets is at least
``percent`` / 100. The result is exact; only hashes of 64 bits stand for shingles.

1. Documents of equal sets become one class, so copies are never compared.
2. Any global order of shingles gives a prefix filter: similar sets share at least l of the
   first (size - least overlap + l) shingles, for every l. By hash order and with l a
   fixed share of the size, a class that shares fewer than l of its prefix shingles with any
   other class has no link and is out. This needs one count of prefix shingles.
3. The shingles of the classes left are ordered by document frequency, rarest first. Each
   posting list of the shortest prefixes is compared with its most central class alone (the
   one whose shingles are shared most), as many rows as postings. What is then connected is
   never compared again: components do not need those pairs.
4. For pairs across components, each class picks its own l by the estimated cost of its
   candidates: with many of them it takes a longer prefix and asks for that many more shared
   shingles. A pair must share min(l, l') of them, within positions that its two sizes still
   allow, and is then verified.

Sets are of lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; shorter texts than ``width`` words
are one shingle; null and empty texts have none, link with nothing, and are their own
component. Rows of one doc_id count as one document that has the links of each; a null
doc_id links with nothing and stays null. Only doc_id and text are read, so extra columns
of any name do no harm. An empty table gives an empty result.
"""

from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import Stored, documents, hashed, lowered_words, mixed, release, tidy
from salesflow.llm.components import components
from salesflow.operators.reduction import filter_bits, key_bitmaps, with_match

#: What verifying a candidate costs, in rows of postings.
VERIFY_COST = 8
LEVELS = (1, 2, 3, 4, 6, 8, 12)
#: Characters of texts whose sets are made together.
JOINED = 500_000


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def emitted_level(n: int, percent: int) -> int:
    """Matches asked for by the first filter: as many as keep its prefix below a third."""
    return max(1, min(n - least_overlap(n, percent), n // 10))


def required_level(n: int, percent: int) -> int:
    """What every partner of a set of n has emitted at least."""
    return emitted_level(least_overlap(n, percent), percent)


def sets_of_many(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of many texts as ``shingles`` gives them, in one array, and where each ends. The
    words lie in one array: numpy's calls cost more than short texts, hashing a word less than looking it up."""
    parts = [lowered_words(text) for text in texts]
    words = np.fromiter(map(len, parts), np.int64, len(parts))
    one = np.concatenate([np.zeros(0, np.uint64), *map(hashed, parts)])
    spans = np.minimum(words, width)
    sizes, begins = np.where(words > 0, words - spans + 1, 0), np.cumsum(words) - words
    ends = np.cumsum(sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(begins - ends + sizes, sizes)
    span = np.repeat(spans, sizes)
    total, shortest = span.astype(np.uint64), span.min(initial=width)
    for i in range(width):
        inside = slice(None) if i < shortest else np.flatnonzero(i < span)
        total[inside] = mixed(total[inside] * np.uint64(0x9E3779B97F4A7C15) + one[at[inside] + i])
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        total[a:b].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[(ends - sizes)[sizes > 0]] = True
    return total[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]


def _chunks(texts: pa.Array, width: int):
    """(place of the first, packed sets) of as many texts at a time as ``JOINED`` characters hold."""
    at = 0
    while at < len(texts):
        first, some, size = at, [], 0
        while at < len(texts) and size < JOINED:
            some.append(texts[at].as_py() or "")
            size += len(some[-1])
            at += 1
        found, ends = sets_of_many(some, width)
        packed, places = found.tobytes(), [0, *(8 * ends).tolist()]
        yield first, [packed[a:b] for a, b in pairwise(places)]


@tidy
def _sets(width, percent, batches):
    """doc_id, size, digest of the set (null: empty), first shingles by hash."""
    release()
    for batch in batches:
        for first, found in _chunks(batch.column(1), width):
            rows = []
            for one in found:
                n = len(one) // 8
                keep = n - least_overlap(n, percent) + emitted_level(n, percent)
                rows.append((n, xxhash.xxh3_128_digest(one) if n else None, one[: 8 * keep]))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
            ids = batch.column(0).slice(first, len(found))
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "digest", "prefix"])


@tidy
def _unpacked(batches):
    """(rep, n, packed shingles) to a row per shingle."""
    for batch in batches:
        packed = [x.as_py() for x in batch.column(2)]
        sizes = np.array([len(x) // 8 for x in packed], np.int64)
        rep, n = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
        flat = np.frombuffer(b"".join(packed), np.int64)
        for at in range(0, len(flat), 100_000):
            some = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.array(flat[some])], names=["rep", "n", "token"])


@tidy
def _full_sets(width, batches):
    """Whole sets of the texts whose set is the expected one."""
    release()
    for batch in batches:
        for first, found in _chunks(batch.column(2), width):
            reps, digests = (batch.column(i).slice(first, len(found)).to_pylist() for i in (0, 1))
            rows = [(rep, len(one) // 8, digest, one) for rep, digest, one in zip(reps, digests, found) if xxhash.xxh3_128_digest(one) == digest]
            if rows:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "digest", "shingles"])


def chosen_level(percent: int):
    """The l of least estimated cost, as an aggregate over a class's postings with ``others``,
    the classes of other components in each list: rows to join, and candidates to verify,
    which get fewer with the square of the matches asked for. Only positions count that a
    partner of the same size would allow."""
    options, overlap = [], F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}")
    for level in LEVELS:
        rows = F.sum(F.when(F.col("position") <= F.col("n") - overlap + (level - 1), F.col("others")).otherwise(0))
        cost = rows * (1 + VERIFY_COST / level**2)
        options.append(F.when((F.lit(level) == 1) | (F.first("n") >= 2 * level), F.struct(cost.alias("cost"), F.lit(level).alias("level"))))
    return F.array_min(F.array_compact(F.array(*options)))["level"]


def least_sql(percent: int):
    """``least_overlap`` of the column n."""
    return F.expr(f"({percent} * n + 99) div 100")


@tidy
def _postings(percent, batches):
    """Postings of each class's longest prefix; positions count the unshared shingles first."""
    for batch in batches:
        rows = []
        for rep, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            df = found.values.field("df").to_numpy()
            token = found.values.field("token").to_numpy()
            order = np.lexsort((token, df))
            # df: documents that share a shingle; the mean is highest for the center of a group
            df, token = df[order], token[order]
            alone = n - len(df)
            take = max(0, min(len(df), n - least_overlap(n, percent) + LEVELS[-1] - alone))
            rows.append((np.full(take, rep), np.full(take, n), token[:take], alone + np.arange(take), np.full(take, -(alone + df.sum()) / n)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["rep", "n", "token", "position", "apart"])


@tidy
def _verified(percent, batches):
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        kept = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))


def near_sizes(percent: int, n: str, m: str):
    return (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))


def classes_and_links(docs: DataFrame, width: int, percent: int, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, n, rep), rep being the smallest doc_id of an equal set (null for
    empty sets and null ids), and (node, root) of the linked ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # each is dropped as soon as what is made of it is stored
    prefixes, ordered, across = (Stored(docs.sparkSession, f"jaccard-{name}") for name in ("prefixes", "ordered", "across"))
    sets = prefixes(rows.mapInArrow(partial(_sets, width, percent), "doc_id long, n long, digest binary, prefix binary"), "sets")
    known = sets.filter("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    members = sets.select("doc_id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left")
    members = stored(members.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "members")
    # 2: classes that share enough of their prefix by hash
    first = classes.select("rep", "n", "prefix").mapInArrow(_unpacked, "rep long, n long, token long")
    often = first.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
    shared = first.select("rep", "n", "token").join(often, "token").groupBy("rep", "n").agg(F.count("*").alias("shared"))
    # required_level(), as SQL
    least = f"(({percent} * n + 99) div 100)"
    required = F.greatest(F.lit(1), F.expr(f"least({least} - ({percent} * {least} + 99) div 100, {least} div 10)"))
    left = shared.filter(F.col("shared") >= required).select("rep").distinct()
    left = stored(classes.select("rep", "digest").join(left, "rep"), "left")
    prefixes.drop()
    # 3: their whole sets, and prefixes by document frequency
    # both sides grow with the input: never a broadcast, at any size; texts of other classes are kept from the shuffle
    bits = filter_bits(left.count())
    maybe = with_match(rows, key_bitmaps(left, "rep", bits), "doc_id", bits).filter("_may_match").drop("_may_match")
    texts = maybe.join(left.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id").select("doc_id", "digest", "text")
    whole = texts.mapInArrow(partial(_full_sets, width), "rep long, n long, digest binary, shingles binary")
    if not members.filter("rep is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        whole = whole.dropDuplicates(["rep", "digest"])
    whole = across(whole.drop("digest"), "whole")
    each = whole.mapInArrow(_unpacked, "rep long, n long, token long")
    df = each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = each.join(df, "token").groupBy("rep", "n").agg(F.collect_list(F.struct("df", "token")).alias("found"))
    ddl = "rep long, n long, token long, position long, apart double"
    postings = ordered(lists.mapInArrow(partial(_postings, percent), ddl), "postings")

    def verify(pairs):
        x = whole.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
        y = whole.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return full.mapInArrow(partial(_verified, percent), "a long, b long")

    # 3: every posting beside the most central class of its list; 4: pairs across components
    short = postings.filter(F.col("position") <= F.col("n") - least_sql(percent))
    center = short.groupBy("token").agg(F.min(F.struct("apart", F.col("rep").alias("b"), F.col("n").alias("m"))).alias("hub"))
    star = short.join(center, "token").select(F.col("rep").alias("a"), "n", "hub.b", "hub.m")
    star = star.filter((F.col("a") != F.col("b")) & near_sizes(percent, "n", "m")).select("a", "b").distinct()
    links = stored(verify(star), "links")
    found = components(links, stored)
    labelled = postings.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    each_root = labelled.groupBy("token", "root").agg(F.count("*").alias("own"))
    mixed_lists = each_root.groupBy("token").agg(F.sum("own").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    counted = each_root.join(mixed_lists, "token").select("token", "root", (F.col("all") - F.col("own")).alias("others"))
    labelled = across(labelled.join(counted, ["token", "root"]).select("token", "rep", "n", "position", "root", "others"), "labelled")
    ordered.drop()
    levels = labelled.groupBy("rep").agg(chosen_level(percent).alias("level"))
    labelled = labelled.join(levels, "rep").filter(F.col("position") <= F.col("n") - least_sql(percent) + F.col("level") - 1)
    a = labelled.select("token", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "position", "level", "root")))
    b = labelled.select("token", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "position", "level", "root")))
    level = F.least("level_a", "level_b")
    overlap = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    last = level - 1 - overlap
    fits = (F.col("position_a") <= F.col("n_a") + last) & (F.col("position_b") <= F.col("n_b") + last)
    apart = (F.col("rep_a") < F.col("rep_b")) & (F.col("root_a") != F.col("root_b")) & near_sizes(percent, "n_a", "n_b")
    pairs = a.join(b, (a["token"] == b["token"]) & apart & fits).groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    pairs = pairs.agg(F.count("*").alias("matches"), F.max(level).alias("level")).filter("matches >= level").select("a", "b")
    links = stored(links.unionByName(verify(pairs)), "links")
    across.drop()
    return members, components(links, stored)


def jaccard_components(docs: DataFrame, width: int, percent: int, stored: Stored) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    members, found = classes_and_links(docs, width, percent, stored)
    own = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at 90 % of three-word shingles."""
    return jaccard_components(documents(spark, sf_dir), 3, 90, Stored(spark, "jaccard"))


#: The same by an all-shingles join and a recursive walk over links, for small tables.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * both_have >= 90 * (p.n + q.n - both_have)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT edges.y, reached.root FROM reached JOIN edges ON edges.x = reached.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""


def one_of_each(docs: DataFrame, width: int, percent: int, stored: Stored) -> DataFrame:
    """The rows of ``docs``, all columns, without those of linked documents but the one of the
    smallest doc_id. Rows of one id stand or fall together, but only one of those that are
    equal in text stays; rows without an id or without shingles stay."""
    found = jaccard_components(docs, width, percent, stored)
    gone = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") < F.col("doc_id")).alias("linked"))
    gone = stored(gone.filter("linked").select(F.col("doc_id").alias("_gone")), "gone")
    twice = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice")), "twice")
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if twice.isEmpty():
        return kept
    single = kept.join(twice, kept["doc_id"] == twice["_twice"], "left_anti")
    return single.unionByName(kept.join(twice, kept["doc_id"] == twice["_twice"], "left_semi").dropDuplicates(["doc_id", "text"]))
