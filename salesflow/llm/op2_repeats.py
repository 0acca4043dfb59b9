"""Removal of repeated byte strings, by run-compressed Burrows-Wheeler indexes.

Each byte covered by a string of ``least`` bytes that also starts elsewhere goes.

1. Every window of ``least`` bytes has a key that its bytes alone decide: the smallest hash
   of the k-grams in it. Equal windows have equal keys, and neighbouring windows of one key
   form a segment, one about every 150 bytes. Only (key, digest) of segments are shuffled.
2. A segment whose bytes occur twice is repeated throughout. These are collapsed by count,
   so copies, of documents or passages, reach no index more than once.
3. Of the rest, only segments whose key has other segments (or which hold their own key
   twice) can have a repeat. Their bytes are fetched once; shards of whole keys each build a
   run index (``run_index``), and its matching statistics give the long matches.
4. A key with too many different segments for a shard is hot. Its segments are cut by a
   finer key (the smallest hashes of both halves of a window), at last by the window itself,
   where equal keys are equal bytes and nothing is left to index. Nothing is dropped.

A long stretch of one period (a line repeated, padding) repeats throughout by itself. It is
found before anything is shuffled: its span is known, and of its windows only those of
the first two periods and of its end go on, which are all the different ones it has.

The same steps find repeats by words instead of bytes (``unit`` WORDS): the elements are then
64-bit hashes of the words, ``least`` counts words, and white space is not compared.

Null texts count as empty. Rows are told apart by id and a hash of the text: two rows of equal id and
text are two documents and repeat each other. Only doc_id and text are read (``remove``
keeps all columns), and helper columns take names that are free, so extra columns of any
name do no harm. An empty table gives an empty result.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import Stored, documents, free, hashed, mixed, release, release_once, ship, tidy
from salesflow.llm.run_index import RunIndex, _words
from salesflow.operators.reduction import filter_bits, key_bitmaps, with_match

LEAST = 400
#: Passages of over 50 words are repeats too, of however few bytes.
PASSAGE_WORDS = 51
#: Bytes an element has: of texts as bytes, and as words.
BYTES, WORDS = 1, 8
#: Elements of a k-gram: shared lines shorter than this never decide a key.
GRAM = {BYTES: 96, WORDS: 12}
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Elements of segments in one index: its arrays fit a core's cache.
SHARD = 200_000
#: A key with more different segments, or more bytes of them, is hot.
HOT_SEGMENTS = 3000
HOT_BYTES = 4_000_000
#: Segments of so many times the least length are searched for periods.
LONG = 4
#: Texts are cut together until they have so many elements: numpy's calls cost more than short texts.
JOINED = 150_000

SEGMENTS = [
    ("doc_id", pa.int64(), "long"),
    ("version", pa.int64(), "long"),
    ("start", pa.int64(), "long"),
    ("size", pa.int64(), "long"),
    ("key", pa.int64(), "long"),
    ("digest", pa.binary(), "binary"),
    ("own", pa.bool_(), "boolean"),
]
DDL = ", ".join(f"{name} {sql}" for name, _, sql in SEGMENTS)


def elements(raw: bytes, unit: int) -> bytes:
    """A text as a string of elements: itself, or the hashes of its words, below 2^63."""
    if unit == BYTES:
        return raw
    # hashing a word anew takes less than looking it up
    return (hashed(raw.split()) >> np.uint64(1)).tobytes()


def gram_hashes(raw: bytes, unit: int) -> np.ndarray:
    """A hash of the ``GRAM`` elements from every position."""
    if unit == WORDS:
        h = np.frombuffer(raw, np.uint64)
        for step in (1, 2):
            h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        return mixed(h[:-8] * np.uint64(0xD6E8FEB86659FD93) + h[4:-4] * np.uint64(0xA0761D6478BD642F) + h[8:])
    h = _words(np.frombuffer(raw, np.uint8))
    for step in (8, 16):
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
    # h now covers 32 bytes; its last entries reach past the end
    h = mixed(h[:-64] * np.uint64(0xD6E8FEB86659FD93) + h[32:-32] * np.uint64(0xA0761D6478BD642F) + h[64:])
    return h[: max(0, len(raw) - GRAM[unit] + 1)]


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of each run of equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def segments_of(raw: bytes, level: int, least: int, unit: int = BYTES) -> list[tuple[int, int, int, bytes, bool]]:
    """(start, size, key, digest, own) of the segments of a string of elements at a level of keys."""
    n = len(raw) // unit - least + 1
    if n < 1:
        return []
    if level == 2:
        windows = [raw[unit * i : unit * (i + least)] for i in range(n)]
        digests = [xxhash.xxh3_128_digest(w) for w in windows]
        return [(i, least, int.from_bytes(d[:8], "big", signed=True), d, False) for i, d in enumerate(digests)]
    h = gram_hashes(raw, unit)
    width = least - GRAM[unit] + 1
    keys = sliding_least(h, width)[:n]
    if level == 1:
        half = least // 2 - GRAM[unit] + 1
        near = sliding_least(h, half)
        keys = mixed(near[:n] * np.uint64(0x9E3779B97F4A7C15) + mixed(near[least // 2 :][:n]) + keys)
    firsts, ends = runs(keys)
    found = []

    def segment(a, b, key):
        part = raw[unit * a : unit * (b + least - 1)]
        # at the first level, a second place of the key is needed for a repeat within
        own = b - a > 1 and (level == 1 or int(np.count_nonzero(h[a : b + width - 1] == np.uint64(key))) > 1)
        found.append((a, len(part) // unit, key - (1 << 64) if key >= 1 << 63 else key, xxhash.xxh3_128_digest(part), own))

    for a, b, key in zip(firsts.tolist(), ends.tolist(), keys[firsts].tolist()):
        at = a
        if level == 0 and b - a > LONG * least:
            marks = a + np.flatnonzero(h[a : b + width - 1] == np.uint64(key))
            for first, end, period in periodic(raw, unit, a, b + least - 1, marks, least):
                # windows from here on, but for those that reach the end, are like earlier ones
                segment(at, first + 2 * period, key)
                found.append((first, end - first, None, None, False))
                at = end - least + 1
        if at < b:
            segment(at, b, key)
    return found


def periodic(raw: bytes, unit: int, a: int, stop: int, marks: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, end, period) of long stretches of elements a..stop that repeat themselves; the
    places of one k-gram tell the periods worth trying. Stretches do not overlap."""
    text = np.frombuffer(raw, np.uint8 if unit == BYTES else np.uint64)
    gaps, found, free = np.diff(marks), [], a
    if not len(gaps):
        return []
    for first, end in zip(*runs(gaps)):
        period, start = int(gaps[first]), max(free, int(marks[first]))
        last = int(marks[end])
        if last - start < LONG * least or last - start < 4 * period:
            continue
        # the stretch may begin before the first and end after the last of the places
        back = text[free : start][::-1] == text[free + period : start + period][::-1]
        start -= len(back) if back.all() else int(back.argmin())
        ahead = text[start : stop - period] == text[start + period : stop]
        close = stop if ahead.all() else start + period + int(ahead.argmin())
        if close - start >= LONG * least and close - start >= 4 * period:
            found.append((start, close, period))
            free = close
    return found


def segments_of_many(raws: list[bytes], least: int, unit: int = BYTES) -> tuple:
    """(text, start, size, key, digest, own) of the segments of many strings of elements at the first
    level, a column each; ``text`` is a place in ``raws``. The strings lie in one array, and
    windows that would cross from one to the next are left out."""
    sizes = np.array([len(raw) // unit for raw in raws], np.int64)
    windows = np.maximum(sizes - least + 1, 0)
    if not windows.any():
        return (*(np.zeros(0, np.int64) for _ in range(4)), [], np.zeros(0, bool))
    offsets, joined = np.cumsum(sizes) - sizes, b"".join(raws)
    h, width = gram_hashes(joined, unit), least - GRAM[unit] + 1
    keys = sliding_least(h, width)
    # a segment begins where the key changes, at a text's first window, and after its last
    change = np.zeros(len(keys) + 1, bool)
    change[1:-1] = keys[1:] != keys[:-1]
    some = np.flatnonzero(windows)
    change[offsets[some]] = change[(offsets + windows)[some]] = True
    marks = np.flatnonzero(change)
    # of texts that begin at one place, all but the last are empty
    text = np.searchsorted(offsets, marks[:-1], "right") - 1
    inside = marks[:-1] < (offsets + windows)[text]
    text, a, b = text[inside], marks[:-1][inside], marks[1:][inside]
    key = keys[a]
    own = (b - a > 1) & (_times(h, keys, width, key, a, b + width - 1) > 1)
    places = zip((unit * a).tolist(), (unit * (b + least - 1)).tolist())
    digests = [xxhash.xxh3_128_digest(joined[i:j]) for i, j in places]
    return text, a - offsets[text], b + least - 1 - a, key.view(np.int64), digests, own


def _times(h, least_of, width, key, a, stop):
    """How often each key occurs in its stretch a..stop of ``h``; ``least_of``, of its windows."""
    # places that are the least of a window: those whose windows' greatest key is their own
    edge = np.full(width - 1, np.uint64(2**64 - 1))
    greatest = ~sliding_least(np.concatenate([edge, ~least_of, edge]), width)
    at = np.flatnonzero(greatest == h)
    value, number = np.unique(h[at], return_inverse=True)
    at, number = (x[np.argsort(number, kind="stable")] for x in (at, number))
    placed = number * len(h) + at  # by value, then by place
    base = np.searchsorted(value, key) * len(h)
    return np.searchsorted(placed, base + stop) - np.searchsorted(placed, base + a)


@tidy
def _segments(least, unit, batches):
    release()
    for batch in batches:
        texts, at = batch.column(2), 0
        while at < len(texts):
            first, raws, size = at, [], 0
            while at < len(texts) and size < JOINED:
                raws.append(elements((texts[at].as_py() or "").encode("utf-8", "surrogatepass"), unit))
                size += len(raws[-1]) // unit
                at += 1
            text, start, length, key, digest, own = segments_of_many(raws, least, unit)
            # texts that may hold long periods are cut one by one
            long = np.unique(text[length - least + 1 > LONG * least])
            keep = ~np.isin(text, long)
            digest = pa.array(digest, pa.binary()).filter(pa.array(keep))
            rows = pa.array(first + text[keep])
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), start[keep], length[keep], key[keep], digest, own[keep]]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind, _) in zip(columns, SEGMENTS)],
                names=[n for n, _, _ in SEGMENTS],
            )
            if len(long):
                ids, versions = batch.column(0), batch.column(1)
                yield _batch([(ids[first + i].as_py(), versions[first + i].as_py(), *found) for i in long.tolist() for found in segments_of(raws[i], 0, least, unit)])


def _batch(rows):
    columns = list(zip(*rows)) or [()] * len(SEGMENTS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(columns, SEGMENTS)], names=[n for n, _, _ in SEGMENTS])


@tidy
def _fetched(unit, batches):
    """The bytes of each document's wanted places."""
    for batch in batches:
        rows = []
        for doc_id, version, places, text in zip(*(batch.column(i) for i in range(4))):
            parts = elements((text.as_py() or "").encode("utf-8", "surrogatepass"), unit)
            for p in places.as_py():
                part = parts[unit * p["start"] : unit * (p["start"] + p["size"])]
                rows.append((doc_id.as_py(), version.as_py(), p["start"], p["key"], p["hot"], part))
            if len(rows) > 5_000:
                yield _bytes_batch(rows)
                rows = []
        if rows:
            yield _bytes_batch(rows)


def _bytes_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "version", "start", "key", "hot", "bytes"])


@tidy
def _finer(least, unit, level, batches):
    """Segments of hot segments by the next level's key, joined with the key they had."""
    for batch in batches:
        rows = []
        for doc_id, version, start, key, raw in zip(*(c.to_pylist() for c in batch.columns)):
            for a, size, finer, digest, own in segments_of(raw, level, least, unit):
                rows.append((doc_id, version, start + a, size, finer, digest, own))
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _indexed(least, unit, table):
    """Long matches in one shard (an Arrow table): elements (start, end) of documents."""
    release_once()
    strings = table.column("bytes").to_pylist()
    ids, versions, starts = (table.column(c).to_pylist() for c in ("doc_id", "version", "start"))
    rows = []
    for doc_id, version, start, found in zip(ids, versions, starts, RunIndex(strings, unit).repeated(least)):
        if len(found):
            cut = np.flatnonzero(np.diff(found) > 1) + 1
            first, last = found[np.concatenate([[0], cut])], found[np.concatenate([cut - 1, [len(found) - 1]])]
            rows += [(doc_id, version, start + a, start + b + least) for a, b in zip(first.tolist(), last.tolist())]
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "version", "start", "stop"])


#: A document: its id, whether that is null, and a hash of its text.
DOCUMENT = ["id", "no_id", "version"]


def identified(doc_id, text) -> list:
    """The columns of DOCUMENT; none is null, so that equal ones meet in a plain join."""
    doc_id = doc_id.cast("long")
    return [F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))]


def repeated_spans(docs: DataFrame, stored: Stored, least: int = LEAST, unit: int = BYTES) -> DataFrame:
    """(doc_id, version, start, stop, unit): elements to remove, spans of a document may overlap.
    Kept in ``stored``; the tables on the way there are dropped."""
    ship(docs.sparkSession)
    kept, stored = stored, Stored(docs.sparkSession, "repeats-steps")
    keys = identified(docs["doc_id"], docs["text"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(c.alias(n) for c, n in zip(keys, DOCUMENT)))
    segments = stored(rows.select("doc_id", "version", "text").mapInArrow(partial(_segments, least, unit), DDL), "segments")
    periods = segments.filter("key is null").select("doc_id", "version", "start", (F.col("start") + F.col("size")).alias("stop"))
    segments, spans, level = segments.filter("key is not null"), [periods], 0
    while True:
        # of equal segments any one will do; firsts of numbers are all of one row, and are hashed
        one = [F.first(c).alias(c) for c in ("doc_id", "version", "start", "size", "own")]
        distinct = stored(segments.groupBy("key", "digest").agg(F.count("*").alias("times"), *one), "distinct")
        again = distinct.filter("times > 1").select("key", "digest")
        # most segments occur once: those are kept from the join's shuffle
        bits = filter_bits(again.count())
        maybe = with_match(segments, key_bitmaps(again, "digest", bits), "digest", bits).filter("_may_match").drop("_may_match")
        spans.append(maybe.join(again, ["key", "digest"]).select("doc_id", "version", "start", (F.col("start") + F.col("size")).alias("stop")))
        kinds = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest"), F.max("own").alias("own"), F.sum("size").alias("total"))
        too_much = (F.col("kinds") > HOT_SEGMENTS) | (F.col("kinds") > 1) & (F.col("total") * unit > HOT_BYTES)
        open_keys = kinds.filter("fewest = 1 and (kinds > 1 or own)").select("key", too_much.alias("hot"))
        wanted = distinct.drop("own", "times", "digest").join(open_keys, "key")
        if level == 0:
            places = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "size", "key", "hot")).alias("places"))
            places = places.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "version", "places")
            # of rows of equal id and text one is enough; the join has brought them together
            found = places.join(rows, DOCUMENT).dropDuplicates(DOCUMENT).select("doc_id", "version", "places", "text")
            held = found.mapInArrow(partial(_fetched, unit), "doc_id long, version long, start long, key long, hot boolean, bytes binary")
        else:
            # the bytes are in the hot segments of the level before; a place lies in one of them
            inside = (F.col("w.start") >= F.col("h.start")) & (F.col("w.start") + F.col("w.size") <= F.col("h.start") + F.length("h.bytes") / unit)
            same = F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.version") == F.col("h.version"))
            cut = F.substring(F.col("h.bytes"), (unit * (F.col("w.start") - F.col("h.start")) + 1).cast("int"), (unit * F.col("w.size")).cast("int"))
            held = wanted.alias("w").join(hot.alias("h"), same & inside)
            held = held.select("w.doc_id", "w.version", "w.start", "w.key", "w.hot", cut.alias("bytes")).dropDuplicates(["doc_id", "version", "start", "key"])
        held = stored(held, "held")
        ordinary = held.filter("not hot")
        total = ordinary.agg(F.sum(F.length("bytes"))).first()[0] or 0
        if total:
            shards = 1 + total // (unit * SHARD)
            sharded = ordinary.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
            spans.append(sharded.groupBy("shard").applyInArrow(lambda shard: _indexed(least, unit, shard), "doc_id long, version long, start long, stop long"))
        hot = held.filter("hot")
        if hot.isEmpty():
            break
        level += 1
        cut = hot.select("doc_id", "version", "start", "key", "bytes").mapInArrow(partial(_finer, least, unit, level), DDL)
        segments = stored(cut.dropDuplicates(["doc_id", "version", "start", "size"]), "finer")
    union = spans[0]
    for more in spans[1:]:
        union = union.unionByName(more)
    found = kept(union.withColumn("unit", F.lit(unit)), "spans")
    stored.drop()
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _byte_spans(raw: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """(start, stop) in bytes; of words from the start of the first to the end of the last."""
    found = [(s["start"], s["stop"]) for s in spans if s["unit"] == BYTES]
    if len(found) < len(spans):
        at = [m.span() for m in _WORD.finditer(raw)]
        found += [(at[s["start"]][0], at[s["stop"] - 1][1]) for s in spans if s["unit"] == WORDS]
    return found


def cut(text: str, spans: list[dict]) -> tuple[bytes, bytes, int]:
    """A text in UTF-8, what is left of it, and the number of removed runs."""
    raw = text.encode("utf-8", "surrogatepass")
    found, parts, end = merged(_byte_spans(raw, spans)), [], 0
    for a, b in found:
        parts.append(raw[end:a])
        end = b
    return raw, b"".join([*parts, raw[end:]]), len(found)


@tidy
def _counted(batches):
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
    for batch in batches:
        rows = []
        for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            of = {unit: [s for s in found or () if s["unit"] == unit] for unit in (BYTES, WORDS)}
            raw, kept, n = cut(text.as_py() or "", of[BYTES])
            words = sum(b - a for a, b in merged([(s["start"], s["stop"]) for s in of[WORDS]]))
            rows.append((doc_id, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), words))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_spans(docs: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs``, and as ``name`` the spans of each row (null: none)."""
    keys = []
    for key in DOCUMENT:
        keys.append(free([*docs.columns, name, *keys], f"_{key}"))
    no_id = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("version")]
    # rows of equal id and text share their spans: each of them has all
    each = spans.groupBy(*(c.alias(k) for c, k in zip(no_id, keys))).agg(F.collect_set(F.struct("start", "stop", "unit")).alias(name))
    marked = docs.withColumns(dict(zip(keys, identified(docs["doc_id"], docs["text"]))))
    return marked.join(each, keys, "left").drop(*keys)


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by the spans of bytes, and n_passage_words by
    those of words, of every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"
    return with_spans(rows, spans, "spans").select("doc_id", "text", "spans").mapInArrow(_counted, ddl)


def remove(docs: DataFrame, stored: Stored, least: int = LEAST, least_words: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated bytes removed from the text (parts of cut
    characters dropped) and n_chars counted anew where it changed; rows of which nothing is left go. With
    ``least_words``, what repeats so many words goes as well, of however few bytes, and so do
    rows of which only white space is left."""
    spans = repeated_spans(docs, stored, least)
    if least_words:
        spans = spans.unionByName(repeated_spans(docs, stored, least_words, WORDS))

    @F.arrow_udf("string")
    @tidy
    def left(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        release()
        for texts, found in batches:
            kept = [cut(t.as_py(), own.as_py())[1].decode("utf-8", "ignore") if t.is_valid else None for t, own in zip(texts, found)]
            yield pa.array(kept, pa.string())

    name = free(docs.columns, "_spans")
    kept = free([*docs.columns, name], "_kept")
    rows = with_spans(docs.withColumn("text", docs["text"].cast("string")), spans, name)
    # of a text that loses nothing, nothing is sent to Python
    lost = rows[name].isNotNull()
    rows = rows.withColumn(kept, left(F.when(lost, F.coalesce("text", F.lit(""))), rows[name]))
    blank = F.regexp_replace(F.col(kept), r"^[\x20\x09-\x0D]+$", "") if least_words else F.col(kept)
    out = rows.filter(F.col(name).isNull() | (F.length(blank) > 0))
    out = out.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(F.col(kept))).drop(name, kept)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes found elsewhere, and how many of
    its words lie in passages of ``PASSAGE_WORDS`` words found elsewhere."""
    docs, stored = documents(spark, sf_dir), Stored(spark, "repeats")
    spans = repeated_spans(docs, stored).unionByName(repeated_spans(docs, stored, PASSAGE_WORDS, WORDS))
    return removed(docs, spans)
