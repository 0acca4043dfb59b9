"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram of at
most ``CAPACITY`` entries, at any input size. The driver packs that histogram: first sets
that provably dominate every alternative are fixed for good (an item that nothing fits
beside; a pair that fills its sequence; a pair where no more could fit beside the larger
one, or nothing better than the pair's), which shrinks the instance; the rest is packed
best-fit decreasing, whole runs of equal bins at a time. The plan is a list of bin patterns
with multiplicities; pieces find their place by their rank among those of equal length.

Null texts count as empty: one piece of the end mark alone. Repeated rows are packed each;
which of several equal pieces gets which place is arbitrary. Only doc_id and text are read,
so extra columns of any name do no harm. An empty table gives an empty result.
"""

import os
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.llm.common import CACHED_CHARS, CHUNK_CHARS, Stored, documents, held
from salesflow.llm.op1_bpe import WordBpe

CAPACITY = 4096
END = 1
#: Words in a generation of the cache: this operator holds little else.
MOST_WORDS = 400_000
#: Pieces in a block within which those of one length are numbered.
BLOCK_PIECES = 20_000


class FastWords(WordBpe):
    """Encodes as ``WordBpe``; words not in the cache go to the tokenizers library in one
    call for many texts."""

    def __init__(self, path: str):
        import tokenizers

        super().__init__(path)
        self.packed.most = MOST_WORDS
        self.library = tokenizers.Tokenizer.from_file(path)
        self.last_ids = np.zeros(max(self.strings) + 1, bool)
        self.last_ids[[i for i, s in self.strings.items() if s.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        """Adds the words to the cache."""
        known, older = self.packed, self.packed.older
        missing = [w for w in words if w not in known and w not in older and len(w) <= CACHED_CHARS]
        if not missing:
            return
        ids = np.array(self.library.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last_ids[ids]) + 1
        if len(ends) != len(missing):
            return  # they are merged one by one
        raw, at = ids.tobytes(), 0
        for word, end in zip(missing, (4 * ends).tolist()):
            known.put(word, raw[at:end])
            at = end


def load(path: str) -> FastWords:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held((FastWords, path), lambda: FastWords(path))


PIECES = [
    ("doc_id", pa.int64(), "long"),
    ("piece", pa.int32(), "int"),
    ("start", pa.int64(), "long"),
    ("length", pa.int64(), "long"),
    ("ids_crc32", pa.int64(), "long"),
]


def _cut(path, capacity, batches):
    bpe, end = load(path), np.array([END], "<u4").tobytes()
    for batch in batches:
        ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
        while at < len(ids):
            some, size = [], 0
            while at < len(ids) and size < CHUNK_CHARS // 2:
                text = texts[at].as_py() or ""
                some.append((ids[at], text, None if "<|" in text else bpe.words(text)))
                size += len(text)
                at += 1
            bpe.learn(set().union(*(words for _, _, words in some if words)))
            rows, get = [], bpe.packed.__getitem__
            for doc_id, text, words in some:
                raw = (bpe.encode(text) if words is None else b"".join(map(get, words))) + end
                for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[start : start + 4 * capacity]
                    rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, kind) for c, (_, kind, _) in zip(zip(*rows), PIECES)]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _, _ in PIECES])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The token pieces of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_cut, path, capacity), ", ".join(f"{name} {sql}" for name, _, sql in PIECES))


# --- the plan, on the histogram of lengths ---


def _two_best(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two items that fit into ``room``; ``sizes`` ascend."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room:
            j -= 1
        else:
            if i < j or counts[sizes[i]] > 1:
                best = max(best, total)
            i += 1
    return best


def reduce(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Takes dominating sets out of ``counts``: (times, sizes) of each. At most two steps a size,
    whatever the counts."""
    fixed = []
    for large in sorted(counts, reverse=True):
        while counts.get(large, 0):
            room = capacity - large
            counts[large] -= 1
            others = sorted(s for s, n in counts.items() if n and s <= room)
            counts[large] += 1
            if not others:
                fixed.append((counts.pop(large), [large]))
                break
            partner = others[-1]
            smallest = [s for s in others[:3] for _ in range(min(3, counts[s] - (s == large)))][:3]
            dominates = large + partner == capacity or sum(smallest[:2]) > room or len(smallest) < 2
            if not dominates and (len(smallest) < 3 or sum(smallest) > room):
                left = {s: counts[s] - (s == large) for s in others}
                dominates = partner >= _two_best([s for s in others if left[s]], left, room)
            if not dominates:
                break
            # with fewer items left nothing better fits either, so the pair dominates until one of both
            # sizes is used up: all such pairs are fixed at once, and each step ends a size
            times = counts[large] // 2 if partner == large else min(counts[large], counts[partner])
            for size in (large, partner):
                counts[size] -= times
            fixed.append((times, [large, partner]))
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing: (times, [(size, how many)]) per pattern of bins."""
    by_room: dict[int, list] = {}
    full, mask = [], 0

    def put(room, times, pattern):
        nonlocal mask
        if room:
            by_room.setdefault(room, []).append((times, pattern))
            mask |= 1 << room
        else:
            full.append((times, pattern))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            fitting = mask >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                times, pattern = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
            else:
                room, times, pattern = capacity, left, []
            each = min(room // size, left)
            bins = min(times, left // each)
            if bins < times and pattern:
                put(room, times - bins, pattern)
            put(room - each * size, bins, [*pattern, (size, each)])
            left -= bins * each
    return full + [one for group in by_room.values() for one in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, items a sequence, offset) by length and rank."""
    counts = dict(counts)
    patterns = [(times, [(size, sizes.count(size)) for size in dict.fromkeys(sizes)]) for times, sizes in reduce(counts, capacity)]
    patterns += best_fit(counts, capacity)
    slots, ranks, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for size, each in pattern:
            first = ranks.get(size, 0)
            slots.append((size, first, sequence, each, offset))
            ranks[size] = first + times * each
            offset += size * each
        sequence += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def _placed(sent, batches):
    slots = sent.value
    firsts = {int(size): slots[slots[:, 0] == size] for size in np.unique(slots[:, 0])}
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for size in np.unique(length):
            of = np.flatnonzero(length == size)
            mine = firsts[int(size)]
            slot = mine[np.searchsorted(mine[:, 1], rank[of], "right") - 1]
            nth = rank[of] - slot[:, 1]
            sequence[of] = slot[:, 2] + nth // slot[:, 3]
            offset[of] = slot[:, 4] + nth % slot[:, 3] * size
        columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces. Ranks within a length are taken in
    blocks, so that no task gathers a frequent length whole."""
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    blocks = 1 + sum(counts.values()) // BLOCK_PIECES
    rows = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    before = rows.groupBy("length", "block").count()
    running = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "block", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1).join(before, ["length", "block"])
    names = [name for name, _, _ in PIECES]
    ranked = numbered.select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    sent = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    return ranked.mapInArrow(partial(_placed, sent), ", ".join([*(f"{name} {sql}" for name, _, sql in PIECES), "sequence_id long", "offset long"]))


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(Stored(spark, "packing")(cut, "pieces"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    return packed_documents(spark, documents(spark, sf_dir))
