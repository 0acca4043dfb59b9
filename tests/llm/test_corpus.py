"""Operators over the whole corpus and the pipeline, against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from odd_documents import frame, odd  # noqa: F401

import corpus_pipeline
from salesflow.llm import common, op1_bpe, op2_repeats, op3_secrets, op8_jaccard, op9_quality, op10_packing, run_index
from salesflow.llm.common import Stored, documents
from salesflow.llm.components import components
from salesflow.llm.run_index import RunIndex
from salesflow.session import folder

SMALL = "/root/testdata/sf0.001"


def raw_words(text):
    return (text or "").encode().lower().split()


# --- brute force ---


def removed(texts, least):
    """For each text: bytes, removed bytes, runs, digest and text of what is left."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + least] for raw in raws for i in range(len(raw) - least + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - least + 1):
            if seen[raw[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def passage_windows(texts, least):
    """For each text its words, and whether a run of ``least`` of them from each also starts elsewhere."""
    words = [list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    windows = [[tuple(m[0] for m in found[i : i + least]) for i in range(len(found) - least + 1)] for found in words]
    seen = Counter(w for one in windows for w in one)
    return [(found, [seen[w] > 1 for w in one]) for found, one in zip(words, windows)]


def passage_words(texts, least):
    """For each text the number of words in such runs."""
    out = []
    for found, again in passage_windows(texts, least):
        gone = np.zeros(len(found), bool)
        for i in np.flatnonzero(again):
            gone[i : i + least] = True
        out.append(int(gone.sum()))
    return out


def without_repeats(texts, least, least_words):
    """What is left of each text without either kind of repeat; None where that is blank."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + least] for raw in raws for i in range(len(raw) - least + 1))
    out = []
    for raw, (found, again) in zip(raws, passage_windows(texts, least_words)):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - least + 1):
            if seen[raw[i : i + least]] > 1:
                gone[i : i + least] = True
        for i in np.flatnonzero(again):
            gone[found[i].start() : found[i + least_words - 1].end()] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        out.append(None if gone.any() and not kept.strip(" \t\n\v\f\r") else kept)
    return out


def linked(pairs, width, percent):
    """doc_id -> (set size, smallest doc_id reachable), ids taken as one document."""
    sets = []
    for i, text in pairs:
        words = raw_words(text)
        n = min(width, len(words))
        sets.append((i, frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if n else frozenset()))
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(x), None if i is None else find(i)) for i, x in sets]


# --- repeats ---


def test_run_index_finds_all_matches():
    draw = random.Random(2)
    for _ in range(200):
        letters = draw.choice([b"ab", b"abcdefgh", b"\0a"])
        strings = [bytes(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(draw.choice([1, 2, 5]))]
        least = draw.choice([2, 4, 6])
        seen = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        expected = [[i for i in range(len(s) - least + 1) if seen[s[i : i + least]] > 1] for s in strings]
        assert [x.tolist() for x in RunIndex(strings).repeated(least)] == expected


@pytest.mark.parametrize("bits", [run_index.PLACE_BITS, 4])
def test_suffixes_are_sorted_in_both_forms(monkeypatch, bits):
    """A sort key holds two ranks and the place, or (texts beyond that) two ranks."""
    monkeypatch.setattr(run_index, "PLACE_BITS", bits)
    draw = random.Random(9)
    for kind in (np.uint8, np.uint64):
        for n in (1, 2, 7, 40, 300):
            for letters in ([0, 1], [5], [0, 7, 200, 255]):
                # a separator ends every text
                text = np.array([*(draw.choice(letters) for _ in range(n - 1)), np.iinfo(kind).max], kind)
                order, rank = run_index.suffix_array(text)
                assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
                assert rank[order].tolist() == list(range(n))


def test_memory_is_handed_back_once_a_task(monkeypatch):
    """Not at every shard of it: that took as long as a small shard's index."""
    calls, table = [], pa.table({name: pa.array([1], pa.int64()) for name in ("doc_id", "version", "start")} | {"bytes": [b"a" * 900]})
    monkeypatch.setattr(common, "_released", [None])
    monkeypatch.setattr(common, "_hand_back", lambda: calls.append(1))
    monkeypatch.setattr(common.TaskContext, "get", lambda: SimpleNamespace(taskAttemptId=lambda: 7))
    found = [op2_repeats._indexed(400, op2_repeats.BYTES, table) for _ in range(3)]
    assert len(calls) == 1 and all(f.equals(found[0]) for f in found) and len(found[0]) > 0


@pytest.mark.parametrize("hot", [3000, 1])
def test_repeats_equal_brute_force(spark, frame, odd, monkeypatch, hot):
    monkeypatch.setattr(op2_repeats, "HOT_SEGMENTS", hot)
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdefghij ") for _ in range(430))
    around = ["".join(draw.choice("klmnopqrst ") for _ in range(900)) for _ in range(8)]
    more = [(200 + k, a[:400] + passage[: 400 + 10 * (k % 4)] + a[400:]) for k, a in enumerate(around)]
    pairs = [*odd, *more, (300, "xy" * 900), (301, around[0][100:700])]
    docs = frame(pairs)
    stored, texts = Stored(spark, "test"), [t for _, t in pairs]
    spans = op2_repeats.repeated_spans(docs, stored).unionByName(op2_repeats.repeated_spans(docs, stored, 51, op2_repeats.WORDS))
    found = op2_repeats.removed(docs, spans)
    expected = [(i, *row[:4], words) for (i, _), row, words in zip(pairs, removed(texts, 400), passage_words(texts, 51))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert any(row[5] for row in expected) and any(row[2] and not row[5] for row in expected)
    left = op2_repeats.remove(docs, Stored(spark, "test"))
    assert left.columns == docs.columns
    texts = sorted((repr((r["doc_id"], r["text"])) for r in left.collect()))
    kept = [(i, t if not row[1] else row[4]) for (i, t), row in zip(pairs, removed([t for _, t in pairs], 400)) if not row[1] or row[4]]
    assert texts == sorted(map(repr, kept))


def test_helper_names_are_free(spark, odd):
    """Columns named like those that stages add for themselves are kept as they are."""
    from salesflow.llm.common import ship

    ship(spark)
    extra = ["_terms", "_spans", "_SPANS_", "_kept", "_id", "_no_id", "_version", "_text", "_lang", "_of", "_found", "version", "start", "spans"]
    rows = [(i, t, "en", *[f"{c}{i}" for c in extra]) for i, t in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra))
    known = {repr(i): [f"{c}{i}" for c in extra] for i, _ in odd}
    for made in (op9_quality.keep(docs, op9_quality.learn(docs)), op2_repeats.remove(docs, Stored(spark, "test"), least_words=51)):
        got = made.collect()
        assert made.columns == docs.columns and 0 < len(got) < len(odd)
        assert all(list(r)[3:] == known[repr(r["doc_id"])] for r in got)


def test_rows_without_an_id_share_no_spans(spark, frame):
    """Each text has its own; of equal rows one is fetched and all are cut."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(420))
    pairs = [(None, "".join(draw.choice("klmnop ") for _ in range(300)) + passage) for _ in range(60)] + [(None, passage + "end")] * 20
    docs = frame(pairs)
    spans = op2_repeats.repeated_spans(docs, Stored(spark, "test"))
    assert spans.count() <= 6 * len(pairs)
    marked = op2_repeats.with_spans(docs, spans, "found").select("found").collect()
    assert len(marked) == 80 and sum(len(r[0] or ()) for r in marked) <= 6 * len(pairs)
    got = op2_repeats.removed(docs, spans).collect()
    expected = removed([t for _, t in pairs], 400)
    assert sorted(tuple(r)[1:5] for r in got) == sorted(row[:4] for row in expected)


@pytest.mark.parametrize("unit", [op2_repeats.BYTES, op2_repeats.WORDS])
def test_periods_of_long_texts(spark, frame, unit):
    """Repeated letters, lines and paragraphs in long texts, alone and beside windows of theirs elsewhere."""
    draw = random.Random(21)
    prose = lambda n: "".join(draw.choice("abcdefghijk lm") for _ in range(n))
    paragraph = " ".join("".join(draw.choice("abcdefg") for _ in range(4)) for _ in range(30))
    texts = ["xy " * 1500, prose(500) + "xy " * 1400 + prose(500), "q" * 6000 + prose(100), prose(90) + (paragraph + "\n") * 40 + prose(700)]
    texts += [prose(300) + "xy " * 140 + prose(50), (paragraph + "\n") * 4, "q" * 399 + "r", "q" * 401, prose(3000), "y x" * 1700 + "z " + "xy " * 900]
    docs, least = frame(list(enumerate(texts))), 400 if unit == op2_repeats.BYTES else 51
    spans = op2_repeats.repeated_spans(docs, Stored(spark, "test"), least, unit)
    got = {r["doc_id"]: tuple(r) for r in op2_repeats.removed(docs, spans).collect()}
    if unit == op2_repeats.BYTES:
        assert {i: row[1:5] for i, row in got.items()} == dict(enumerate(row[:4] for row in removed(texts, 400)))
    else:
        assert [got[i][5] for i in range(len(texts))] == passage_words(texts, 51)


@pytest.mark.parametrize("unit", [op2_repeats.BYTES, op2_repeats.WORDS])
def test_short_texts_are_cut_together(odd, monkeypatch, unit):
    """One call of numpy for many of them, with the segments that each has by itself."""
    draw, least = random.Random(8), 400 if unit == op2_repeats.BYTES else 51
    texts = [t for _, t in odd] + [" ".join(str(draw.randrange(n)) for _ in range(n)) for n in (3, 50, 51, 52, 90, 300, 900) for _ in range(30)]
    texts += [texts[-1][:900] + " mid " + texts[-1][:900], "ab " * 2500, None, "", "q" * 400, "q" * 399]
    expected, calls = [], []
    for i, text in enumerate(texts):
        raw = op2_repeats.elements((text or "").encode("utf-8", "surrogatepass"), unit)
        expected += [(i, -i, *found) for found in op2_repeats.segments_of(raw, 0, least, unit)]
    hashed = op2_repeats.gram_hashes
    monkeypatch.setattr(op2_repeats, "gram_hashes", lambda *given: calls.append(1) or hashed(*given))
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([-i for i in range(len(texts))], pa.int64()), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "text"])
    found = [tuple(row.values()) for made in op2_repeats._segments(least, unit, [batch]) for row in made.to_pylist()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert len(calls) < 50 < len(texts)


def test_a_text_of_megabytes_of_one_period():
    raw = b"xy" * 4_000_000 + b"the end"
    started = time.monotonic()
    found = op2_repeats.segments_of(raw, 0, 400)
    assert time.monotonic() - started < 20
    assert sum(size for _, size, key, _, _ in found if key is not None) < 5000
    assert (0, 8_000_000, None, None, False) in found


def removed_words(texts, least):
    """What is left of each text without runs of ``least`` words that also start elsewhere."""
    words = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    windows = [[tuple(m[0] for m in found[i : i + least]) for i in range(len(found) - least + 1)] for found in words]
    seen = Counter(w for one in windows for w in one)
    out = []
    for text, found, one in zip(texts, words, windows):
        gone = np.zeros(len(text or ""), bool)
        for i, w in enumerate(one):
            if seen[w] > 1:
                gone[found[i].start() : found[i + least - 1].end()] = True
        out.append("".join(c for c, g in zip(text or "", gone) if not g))
    return out


@pytest.mark.parametrize("hot", [3000, 1])
def test_pipeline_removes_passages_by_words(spark, frame, monkeypatch, hot):
    monkeypatch.setattr(op2_repeats, "HOT_SEGMENTS", hot)
    draw = random.Random(14)

    def prose(n):
        return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(1, 9))) for _ in range(n))

    around = [prose(180) for _ in range(12)]
    passage = prose(55)
    while len(passage) > 330:  # over 50 words, under 400 bytes
        passage = prose(55)
    texts = [f"{a[:300]} {passage} {a[300:]}" for a in around[:4]]
    texts += [around[4] + " " + passage.replace(" ", "\n", 9), around[5] + " " + " ".join(passage.split()[:50]) + " end", passage.upper(), None, ""]
    texts += [around[6] + " " + " ".join("xy" * 70), " ".join(around[7].split()[:60]), around[7], around[8]]
    left = corpus_pipeline.suffix_array_dedup(spark, frame(list(enumerate(texts))), "")
    expected = removed_words(texts, 51)
    # 140 letters "x y x y" and the copied sixty words are under 400 bytes as well
    kept = {i: t if t is None else e for i, (t, e) in enumerate(zip(texts, expected)) if not t or e.strip() or e == t}
    assert 0 in kept and passage[20:300] not in kept[0]
    assert {r["doc_id"]: r["text"] for r in left.collect()} == kept


# --- near duplicates ---


def test_components_of_chains_and_stars(spark):
    draw = random.Random(6)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 500)]
    draw.shuffle(links)
    found = dict(components(spark.createDataFrame(links, "a long, b long"), Stored(spark, "test")).collect())
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, frame, odd, width, percent):
    draw = random.Random(width)
    family = []
    base = [f"f{draw.randrange(10**6)}" for _ in range(160)]
    for k in range(60):  # copies with none to six edits: chains of links
        words = list(base)
        for _ in range(k % 7):
            words[draw.randrange(160)] = f"e{draw.randrange(40)}"
        family.append((1000 + k, " ".join(words)))
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for pairs in ([*odd, *family], given):
        found = op8_jaccard.jaccard_components(frame(pairs), width, percent, Stored(spark, "test"))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(linked(pairs, width, percent), key=repr)


def test_jaccard_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = op8_jaccard.op8_jaccard_join(spark, SMALL)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(op8_jaccard.SQL).fetchall())


@pytest.mark.parametrize("width", [1, 3, 5])
def test_sets_of_many_texts_are_those_of_each(odd, width):
    texts = [t or "" for _, t in odd] + ["a", "a b", "A b\tC d e f", "x " * 40, ""]
    for some in (texts, texts[::-1], [""], []):
        found, ends = op8_jaccard.sets_of_many(some, width)
        each = [common.shingles(common.lowered_words(t), common.WordCache(xxhash.xxh3_64_intdigest), width) for t in some]
        assert [a.tolist() for a in np.split(found, ends)[:-1]] == [e.tolist() for e in each]


def test_idle_workers_hand_memory_back(monkeypatch):
    calls, batch = [], pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c"])], names=["doc_id", "text"])
    monkeypatch.setattr(common, "_hand_back", lambda: calls.append(1))
    made = op8_jaccard._sets(3, 90, [batch])
    assert next(made).num_rows == 1
    before = len(calls)
    assert list(made) == [] and len(calls) == before + 1


def test_jaccard_join_keeps_little_on_disk(spark, frame, monkeypatch):
    """Texts of classes without a candidate stay out of the shuffle, and tables go once they were used."""
    stored, store = {}, Stored.__call__
    monkeypatch.setattr(Stored, "__call__", lambda self, made, name: stored.setdefault(name, (self, made)) and store(self, made, name))
    words = [f"w{i}" for i in range(300)]
    pairs = [(i, " ".join(words[:280] + [f"own{i}"])) for i in range(5)] + [(10 + i, " ".join(f"{i}x{k}" for k in range(200))) for i in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in op8_jaccard.jaccard_components(frame(pairs), 3, 90, Stored(spark, "test")).collect()}
    assert found == {i: 0 if i < 5 else i for i, _ in pairs}
    assert "bitmap_construct_agg" in stored["whole"][1]._jdf.queryExecution().executedPlan().toString()
    for name in ("sets", "whole", "postings", "labelled"):
        place, system = folder(spark, stored[name][0].root)
        assert not system.exists(place), name


def test_levels_stay_within_what_partners_emit():
    for percent in (80, 90):
        for n in range(1, 400):
            for m in range(op8_jaccard.least_overlap(n, percent), n + 1):
                assert op8_jaccard.required_level(n, percent) <= op8_jaccard.emitted_level(m, percent)


# --- packing ---


def check_packed(rows, pairs, capacity):
    bpe = op1_bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, text in pairs:
        raw = bpe.encode(text or "") + np.array([1], "<u4").tobytes()
        for k in range(0, len(raw) // 4, capacity):
            part = raw[4 * k : 4 * (k + capacity)]
            expected.append((i, k // capacity, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_places_every_piece(spark, frame, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = Stored(spark, "test")(op10_packing.pieces(frame(odd), path, 300), "pieces")
    check_packed(op10_packing.pack(cut, 300).collect(), odd, 300)
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = op10_packing.packed_documents(spark, given).collect()
    used = check_packed(rows, [(r["doc_id"], r["text"]) for r in given.collect()], 4096)
    assert used <= 1 + -(-sum(r["length"] for r in rows) // 4096)


def test_reduction_keeps_an_optimum():
    """Against the least number of bins by search over small instances."""

    def least(sizes, capacity):
        best = [len(sizes)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                    place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
            place(k + 1, [*bins, sizes[k]])

        place(0, [])
        return best[0]

    draw = random.Random(8)
    for _ in range(150):
        sizes = sorted((draw.randrange(1, 21) for _ in range(draw.randrange(1, 9))), reverse=True)
        counts = dict(Counter(sizes))
        fixed = op10_packing.reduce(counts, 20)
        rest = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
        assert sum(times for times, _ in fixed) + least(rest, 20) == least(sizes, 20)
        assert sorted(rest + [s for times, of in fixed for s in of * times]) == sorted(sizes)
        slots = op10_packing.plan(Counter(sizes), 20)
        assert len(slots) and slots[:, 0].min() == min(sizes)


def test_reduction_takes_equal_pairs_at_once():
    """The same sets as one by one, and a plan of a hundred million pieces without short ones in seconds."""
    draw = random.Random(12)
    for _ in range(60):
        sizes = [draw.randrange(5, 21) for _ in range(draw.randrange(1, 30))]
        at_once, one_by_one = Counter(sizes), Counter(sizes)
        sets = Counter()
        for times, of in op10_packing.reduce(at_once, 20):
            sets[tuple(of)] += times
        single = Counter()
        while True:  # the first set alone, again and again
            found = op10_packing.reduce(Counter(one_by_one), 20)
            if not found:
                break
            single[tuple(found[0][1])] += 1
            one_by_one.subtract(found[0][1])
            one_by_one += Counter()
        assert sets == single and +at_once == +one_by_one
    started = time.monotonic()
    counts = {size: 50_000 + 37 * (size % 11) for size in range(900, 2900)}
    fixed = op10_packing.reduce(dict(counts), 4096)
    slots = op10_packing.plan(counts, 4096)
    assert time.monotonic() - started < 20 and len(fixed) <= 2 * len(counts) and len(slots) < 10 * len(counts)


# --- empty tables, entry points, pipeline ---


def test_empty_tables(spark, frame):
    none = frame([]).limit(0)
    stored = Stored(spark, "test")
    assert op2_repeats.removed(none, op2_repeats.repeated_spans(none, stored)).count() == 0
    assert op8_jaccard.jaccard_components(none, 3, 90, stored).count() == 0
    assert op8_jaccard.one_of_each(none, 5, 80, stored).count() == 0
    assert op10_packing.packed_documents(spark, none).count() == 0


def test_every_operator_has_a_query():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert "pipeline" in names
    for k in range(1, 11):
        assert sum(name.startswith(f"op{k}_") for name in names) == 1


def test_pipeline_equals_brute_force(spark):
    docs = documents(spark, SMALL)
    known = op9_quality.learn(docs)
    good = {r["doc_id"] for r in op9_quality.judge(docs, known).filter("kept").collect()}
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    roots = {i: root for i, _, root in linked(pairs, 5, 80)}
    pairs = [(i, t) for i, t in pairs if roots[i] == i]
    left = without_repeats([t for _, t in pairs], 400, 51)
    pairs = [(i, t) for (i, _), t in zip(pairs, left) if t is not None]
    novelty, final = op3_secrets.Novelty(), []
    for i, text in pairs:
        base = op3_secrets.base_spans(text)
        covered = bytearray(len(text))
        for start, _, end in base + op3_secrets.novel_spans(text, base, novelty):
            covered[start:end] = b"\1" * (end - start)
        parts = ["[secret]" if c and not p else "" if c else ch for ch, c, p in zip(text, covered, b"\0" + bytes(covered))]
        final.append((i, "".join(parts)))
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), final, 4096)


def test_stages_take_odd_documents(spark, frame, odd):
    """Each stage on its own, by the texts it leaves."""
    docs = frame(odd)
    made = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SMALL)
        assert left.columns == docs.columns
        made[name] = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    known = op9_quality.learn(docs)
    verdicts = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in op9_quality.judge(docs, known).collect() if r["doc_id"] is not None)
    good = Counter((i, n) for i, n, kept in verdicts if kept)
    assert Counter((i, len((t or "").split())) for i, t in made["quality rules"] if i is not None) == good
    assert set(made["quality rules"]) <= set(odd) and None not in {t for _, t in made["quality rules"]}
    # one of three copies and near copies, one of two equal rows, all without words or id
    roots = {i: root for i, _, root in linked([p for p in odd if p[0] is not None], 5, 80)}
    for i, text in odd:
        assert ((i, text) in made["n-gram Jaccard join"]) == (i is None or not raw_words(text) or roots[i] == i)
    left = without_repeats([t for _, t in odd], 400, 51)
    expected = [(i, t if t is None or not left[k] and not t else left[k]) for k, (i, t) in enumerate(odd) if left[k] is not None]
    assert made["suffix-array dedup"] == sorted(expected, key=repr)
    novelty = op3_secrets.Novelty()
    for i, text in odd:
        base = op3_secrets.base_spans(text or "")
        assert ((i, text) in made["secret scans"]) == (not base and not op3_secrets.novel_spans(text or "", base, novelty))
    assert len(made["secret scans"]) == len(odd) and sum("[secret]" in (t or "") for _, t in made["secret scans"]) == 3
    name, stage = corpus_pipeline.STAGES[-1]
    check_packed(stage(spark, docs, SMALL).collect(), odd, 4096)
