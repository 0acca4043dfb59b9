"""Where the sources of a language differ: every pair of sources by the total difference of
their smoothed term shares, and for each source the terms it uses more than its language.

A term is a run of ASCII letters and non-ASCII characters, A-Z in lower case. A language keeps
the terms of at least ``LEAST_DOCUMENTS`` of its documents, V of them. Where N kept terms
occur in a group, a term that occurs n times has the share 1 + floor(ONE * (n + 5) / (N + 5 V)), in
whole billionths; the share of n = 0 is the group's base.

The difference of two sources is a sum over all kept terms, of which most occur in few
sources. With d = |base_a - base_b| it is taken apart into whole numbers:

* V d, as if no term occurred;
* for each term of a: |share_a - base_b| - d, and for each of b: |base_a - share_b| - d, which
  follow from how often each share occurs in one source;
* for each term of both: what those two got wrong, |share_a - share_b| - |share_a - base_b| -
  |base_a - share_b| + d.

The last part comes from a frequent-pattern tree. A term's row is its list of (source, share)
in order of sources; equal rows are one row with a multiplicity, and rows that begin alike
share the path of that beginning. A node holds how many terms run through it, so a
correction is made once for each pair of a node and an ancestor, whatever number of terms
share them. Rows are sorted, so a task walks its part of the tree with one path in memory: a
node is complete when the next row leaves it.

Null text, lang and source count as ''. Documents without terms still make their group
appear; in a language that keeps no term every pair differs by 0 and no source has terms.
Repeated rows count as often as they occur. Only text, lang and source are read, so null
doc_ids and extra columns of any name do no harm; an empty table gives no rows.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.llm.common import Stored, documents, release

LEAST_DOCUMENTS = 30
ONE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
#: A task hands on its counts whenever it holds this many (group, term) entries.
ENTRIES = 500_000
#: Longer texts are counted in pieces.
PIECE = 1 << 22
#: The pairs of one language are made by this many tasks.
SALTS = 64
#: Every byte that is part of a term, A-Z in lower case; the others become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, of a very long one in several lists; cut between terms."""
    spaced, at = raw.translate(_LETTERS), 0
    while len(spaced) - at > PIECE:
        end = spaced.rfind(b" ", at, at + PIECE) + 1 or (spaced.find(b" ", at + PIECE) + 1 or len(spaced))
        yield spaced[at:end].split()
        at = end
    yield spaced[at:].split()


def _count(batches):
    """(lang, source, term, times, documents), several rows a key."""
    release()
    names = ["lang", "source", "term", "times", "documents"]
    held, size = defaultdict(lambda: (Counter(), Counter())), 0

    def flush():
        for (lang, source), (times, docs) in held.items():
            terms = pa.array(list(times), pa.binary()).cast(pa.string())
            n = len(terms)
            same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([v], pa.string())).dictionary_decode() for v in (lang, source)]
            numbers = [pa.array(np.fromiter(v, np.int64, n)) for v in (times.values(), map(docs.__getitem__, times))]
            yield pa.RecordBatch.from_arrays([*same, terms, *numbers], names=names)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*batch.columns):
            times, docs = held[lang.as_py(), source.as_py()]
            before, seen = len(times), set()
            for terms in pieces(text.as_buffer().to_pybytes() if text.is_valid else b""):
                times.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(times) - before
            if size >= ENTRIES:
                yield from flush()
                size = 0
    yield from flush()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, times for each kept term of a source; ``of_lang`` is its times in the
    language, and ``first`` is 1 in one row of each (lang, term), else 0."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = texts.mapInArrow(_count, "lang string, source string, term string, times long, documents long")
    # one exchange serves both the sums of a source and those of the language
    rows = rows.repartition("lang", "term").groupBy("lang", "term", "source")
    sums = rows.agg(F.sum("times").alias("times"), F.sum("documents").alias("documents"))
    term = W.partitionBy("lang", "term")
    sums = sums.withColumns({"documents": F.sum("documents").over(term), "of_lang": F.sum("times").over(term), "first": F.row_number().over(term.orderBy("source"))})
    sums = sums.filter(F.col("documents") >= least)
    return sums.select("lang", "source", "term", "times", "of_lang", (F.col("first") == 1).cast("int").alias("first"))


def share(times: Column, total: Column) -> Column:
    """The share of a term in whole billionths; 0 where nothing is kept. Exact up to 10^18 occurrences."""
    wide = [c.cast("decimal(18,0)") for c in (times + SMOOTH, total)]
    quotient = F.call_function("div", wide[0] * F.lit(ONE).cast("decimal(10,0)"), wide[1])
    return F.when(total > 0, 1 + quotient).otherwise(F.lit(0)).cast("long")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, terms (V), total and lang_total (N + 5 V), base, and the largest base of the language (``top``),
    for every occurring group."""
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"), F.sum("first").alias("terms"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"))
    every = found.join(sums.drop("terms"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    smooth = F.col("terms") * SMOOTH
    every = every.withColumns({"total": F.col("total") + smooth, "lang_total": F.col("lang_total") + smooth})
    every = every.withColumn("base", share(F.lit(0), F.col("total")))
    return every.withColumn("top", F.max("base").over(W.partitionBy("lang")))


def shares(kept: DataFrame, known: DataFrame) -> DataFrame:
    """The kept terms of each source with its share (``p``), base, top, and the language's share (``q``)."""
    valued = kept.join(known, ["lang", "source"])
    return valued.select("lang", "source", "term", "base", "top", share(F.col("times"), F.col("total")).alias("p"), share(F.col("of_lang"), F.col("lang_total")).alias("q"))


def over_used(valued: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """Part ``term``. Spark keeps the first ``most`` of each task before it brings a source together."""
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = valued.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def term_rows(valued: DataFrame) -> DataFrame:
    """Rows of terms in two or more sources: lang, row, times."""
    entry = F.struct("source", "p", "base")
    rows = valued.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("row"))
    return rows.filter(F.size("row") > 1).groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times"))


class Tree:
    """The frequent-pattern tree of sorted rows, of which only the current path is held."""

    def __init__(self):
        self.found = defaultdict(int)
        self.start(None)

    def start(self, lang):
        self.lang, self.path, self.times = lang, [], []
        self.share, self.base = np.zeros(8, np.int64), np.zeros(8, np.int64)

    def insert(self, lang, row: list[tuple], times: int):
        """``row``: (source, share, base) in the order of sources; rows come in sorted order."""
        if lang != self.lang:
            self.leave(0)
            self.start(lang)
        same = 0
        while same < min(len(row), len(self.path)) and row[same] == self.path[same]:
            same += 1
        self.leave(same)
        if len(row) > len(self.share):
            self.share, self.base = (np.resize(a, 2 * len(row)) for a in (self.share, self.base))
        for k in range(same, len(row)):
            self.path.append(row[k])
            self.times.append(0)
            self.share[k], self.base[k] = row[k][1:]
        self.times[-1] += times

    def leave(self, depth: int):
        """Complete the nodes below ``depth``: each corrects its pairs with its ancestors, then its
        terms count for its parent."""
        while len(self.path) > depth:
            (source, p, base), times = self.path.pop(), self.times.pop()
            k = len(self.path)
            if not k:
                continue
            self.times[-1] += times
            ps, bases = self.share[:k], self.base[:k]
            off = np.abs(ps - p) - np.abs(ps - base) - np.abs(bases - p) + np.abs(bases - base)
            for (other, _, _), value in zip(self.path, off.tolist()):
                self.found[self.lang, other, source] += times * value

    def sums(self):
        """(lang, source, item, value), an earlier source first; empties the sums."""
        got = [(*key, value) for key, value in self.found.items()]
        self.found.clear()
        return got


def _walk(batches):
    tree, names = Tree(), ["lang", "source", "item", "value"]

    def batch_of(got):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 3 else pa.string()) for i, c in enumerate(zip(*got))], names=names)

    for batch in batches:
        rows, ends = batch.column("row"), batch.column("row").offsets.to_numpy()
        flat = rows.values
        source, p, base = (flat.field(k).to_pylist() for k in range(3))
        for i, (lang, times) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist())):
            at, end = ends[i], ends[i + 1]
            tree.insert(lang, list(zip(source[at:end], p[at:end], base[at:end])), times)
            if len(tree.found) >= ENTRIES:
                yield batch_of(tree.sums())
    tree.leave(0)
    if tree.found:
        yield batch_of(tree.sums())


def corrections(rows: DataFrame) -> DataFrame:
    """What the tree finds: lang, source, item, value, several rows a pair. Ranges of sorted rows
    keep shared paths together and split what begins alike when it is too much."""
    return rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row").mapInArrow(_walk, "lang string, source string, item string, value long")


def listed(valued: DataFrame) -> DataFrame:
    """lang, source, above, shares: how often each share of a term occurs in a source. Shares above
    every base of the language differ from each by what is above, so only the few others are listed."""
    low = F.least("p", "top")
    counted = valued.groupBy("lang", "source", low.alias("low")).agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("p") - low).alias("above"))
    return counted.groupBy("lang", "source").agg(F.sum("above").alias("above"), F.collect_list(F.struct("low", "times")).alias("shares"))


def one_sided(valued: DataFrame, known: DataFrame) -> DataFrame:
    """The first two parts: lang, source, item, value, two rows a pair. Every pair of the sources of
    a language is a row of the result, so this join makes no more; salts split a large language."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    own = known.select("lang", "source", "terms", "base", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    own = own.join(listed(valued), ["lang", "source"], "left")
    others = known.select("lang", F.col("source").alias("item"), F.col("base").alias("other"), salts.alias("salt"))
    apart = F.abs(F.col("base") - F.col("other"))
    off = F.aggregate("shares", F.lit(0).cast("long"), lambda total, s: total + s["times"] * (F.abs(s["low"] - F.col("other")) - apart))
    pairs = own.join(others, ["lang", "salt"]).filter("source <> item")
    return pairs.select("lang", "source", "item", F.coalesce(F.col("above") + off, F.lit(0)).alias("value"), (F.col("terms") * apart).alias("as_none"))


def both_ways(first: Column, second: Column) -> Column:
    """A value of a pair as two rows, the first to the pair as it is, the second to the pair turned around."""
    turned = [F.struct(F.col(a).alias("source"), F.col(b).alias("item"), v.alias("value")) for a, b, v in (("source", "item", first), ("item", "source", second))]
    return F.inline(F.array(*turned))


def differences(valued: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """Part ``pair``."""
    value = F.col("value")
    parts = one_sided(valued, known).select("lang", both_ways(F.col("as_none") + value, value)).unionByName(found.select("lang", both_ways(value, value)))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))


def audit(docs: DataFrame, store: Stored, least: int = LEAST_DOCUMENTS, most: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = store(kept_terms(docs, least), "terms")
    known = store(groups(docs, kept), "groups")
    valued = shares(kept, known)
    found = corrections(term_rows(valued))
    return differences(valued, known, found).unionByName(over_used(valued, most))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources by difference, and each source's most over-used terms."""
    return audit(documents(spark, sf_dir), Stored(spark, "divergence"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS nl FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(nl) AS nl FROM k GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // CAST(coalesce(t.total, 0) + 5 * v.v AS HUGEINT) AS p,
        1 + 1000000000 * CAST(k.nl + 5 AS HUGEINT) // CAST(v.nl + 5 * v.v AS HUGEINT) AS q
    FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""
