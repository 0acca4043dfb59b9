"""The quality classifier, the source audit and whitening, against plain computations."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd_documents import frame, odd  # noqa: F401

from salesflow.llm import op11_quality, op12_divergence, op13_whitening
from salesflow.llm.common import HASHED_WORDS, Stored, WordCache

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


# --- quality classifier ---


def test_leader_follows_its_definition():
    """The weights are the minimum of the regularized sum of linearized losses, found here by search."""
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.2
    rng = np.random.default_rng(3)
    leader, used, gradients = op11_quality.Leader(1, alpha, beta, l1, l2), [], []
    for _ in range(40):
        w = leader.weights(np.array([0]))
        used.append(w[0])
        gradients.append(rng.normal() + 0.2)
        leader.learn(np.array([0]), np.array([gradients[-1]]), w)
    roots = np.sqrt(np.cumsum(np.square(gradients)))
    shifts = np.diff(np.concatenate([[0], roots])) / alpha
    grid = np.linspace(-3, 3, 600_001)
    loss = sum(gradients) * grid + l1 * np.abs(grid) + (l2 + beta / alpha) / 2 * grid**2
    loss += sum(s / 2 * (grid - u) ** 2 for s, u in zip(shifts, used))
    assert leader.weights()[0] == pytest.approx(grid[loss.argmin()], abs=1e-5)


def test_useless_features_never_enter():
    leader = op11_quality.Leader(2, l1=1.0)
    leader.learn(np.array([0, 1]), np.array([0.9, -1.5]), leader.weights())
    assert leader.weights()[0] == 0 and leader.weights()[1] > 0


def plain_features(text):
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    counted = Counter(("one", t) for t in tokens)
    counted.update(("same",) if a == b else ("two", a, b) for a, b in zip(tokens, tokens[1:]))
    return counted


def test_features_are_counted_ngrams(monkeypatch):
    monkeypatch.setattr(op11_quality, "BITS", 62)
    hashes = WordCache(op11_quality.token_hash, HASHED_WORDS)
    for text in ["", "one", "a a a b a a", "The&&& cat, the&&& cat!! é é ñ", "x y " * 50]:
        found, values = op11_quality.features(text, hashes)
        amounts = sorted(math.log1p(n) for n in plain_features(text).values())
        length = math.sqrt(sum(a * a for a in amounts))
        assert sorted(values) == pytest.approx([a / length for a in amounts])
        assert (np.diff(found) > 0).all()
    monkeypatch.setattr(op11_quality, "CHUNK_CHARS", 10)
    again = op11_quality.features("x y " * 50, hashes)
    assert again[0].tolist() == found.tolist() and again[1].tolist() == values.tolist()


def quality_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, found string")


def test_quality_learns_and_reads_no_held_out_label(spark, frame, odd):
    draw = random.Random(5)
    words = [a + b for a in "kltmn" for b in ("ar", "eno", "is", "ou")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    pairs, labels = [], []
    for i in range(400):
        text = " ".join(draw.choice(words) for _ in range(40))
        if i % 4 == 0:
            text = " ".join(w + "%%%" for w in text.split()) if i % 8 else " ".join([draw.choice(words) + str(i)] * 40)
        pairs.append((i, text))
        labels.append((i, int(i % 4 != 0), 0, "x"))
    docs = frame(pairs + [(1000 + (i or 0), t) for i, t in odd])
    rows = op11_quality.score(docs, op11_quality.train(docs, quality_of(spark, labels))).collect()
    assert len(rows) == 400 + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    scores = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] < 400}
    for i in filter(held, range(400)):
        assert (scores[i] >= op11_quality.THRESHOLD) == (i % 4 != 0)
    # other labels of the held-out fold, null and strange ones change nothing; repeated rows with the same label neither
    other = [(i, 1 - q if held(i) else q, t, x) for i, q, t, x in labels] + [(None, 1, 0, "x"), (7, None, 0, "x"), (8, 5, 0, "x"), (9, 1, 0, "x")]
    again = op11_quality.score(docs, op11_quality.train(docs, quality_of(spark, other))).collect()
    same = {r["doc_id"]: r["score"] for r in again if r["doc_id"] < 400}
    # one more row with label 1 moves the prior by a little, not the model
    shift = {round(math.log(same[i] / (1 - same[i])) - math.log(scores[i] / (1 - scores[i])), 6) for i in scores if 1e-9 < scores[i] < 1 - 1e-9}
    assert len(shift) == 1


def test_quality_sample_is_bounded(spark, frame):
    """Repeated ids and long texts add no more than the documented numbers of rows and features."""
    pairs = [(i % 6, f"text number {i} " + "word " * (i % 9)) for i in range(200)]
    labels = quality_of(spark, [(i, i % 2, 0, "x") for i in range(6)])
    docs, store = frame(pairs), Stored(spark, "test-quality")
    found, y, counts = op11_quality.sample(docs, labels, 10, 10**6, store)
    assert len(found) == len(y) == 20 and sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(6))
    found, y, _ = op11_quality.sample(docs, labels, 10, 60, store)
    assert sum(len(f) for f, _ in found) <= 60 and set(y) == {0, 1}
    found, y, _ = op11_quality.sample(docs, labels, 10, 1, store)
    assert len(found) == 2


def test_quality_without_labels(spark, frame):
    docs = frame([(1, "a"), (2, None), (None, "b")])
    for rows, expected in (([], 1), ([(i, 0, 0, "x") for i in range(9)], 0), ([(i, 1, 0, "x") for i in range(9)], 1)):
        got = op11_quality.score(docs, op11_quality.train(docs, quality_of(spark, rows))).collect()
        assert [round(r["score"]) for r in got] == [expected] * 3
    empty = frame([])
    assert op11_quality.score(empty, op11_quality.train(empty, quality_of(spark, [(i, i % 2, 0, "x") for i in range(9)]))).count() == 0


def test_quality_query(spark):
    rows = op11_quality.op11_quality_classifier(spark, MEDIUM).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(rows) == 1000 and len({r["doc_id"] for r in rows}) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    good = [r["score"] for r in held if truth[r["doc_id"]] == 1]
    low = [r["score"] for r in held if truth[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in low]) > 0.97 and min(good) >= 0.3
    assert sum(b < 0.3 for b in low) >= 0.6 * len(low)


# --- source audit ---


def plain_audit(rows, least, most):
    """From (lang, source, text) rows, by the definition."""
    rows = [tuple(v or "" for v in r) for r in rows]
    out = set()
    lower = {c: c + 32 for c in range(65, 91)}
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))) for lang, source, text in rows]
    for lang in {r[0] for r in rows}:
        docs = Counter(t for la, _, ts in found if la == lang for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        sources = sorted({s for la, s, _ in rows if la == lang}, key=str.encode)
        counts = {s: Counter(t for la, so, ts in found if (la, so) == (lang, s) for t in ts if docs[t] >= least) for s in sources}
        of_lang = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in sources:
            pair = [(sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o) for o in sources if o != s]
            over = [(share(counts[s], t) - share(of_lang, t), t) for t in kept if counts[s][t] and share(counts[s], t) > share(of_lang, t)]
            for part, items, limit in (("pair", pair, None), ("term", over, most)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)}
    return sorted(out)


def sourced(spark, rows):
    ddl = "doc_id long, text string, lang string, source string, term string, times string, base string, item string, rank string"
    from salesflow.llm.common import ship

    ship(spark)
    return spark.createDataFrame([(None, text, lang, source, "x", "x", "x", "x", "x") for lang, source, text in rows], ddl)


@pytest.fixture
def sources():
    draw = random.Random(8)
    words = ["Alpha", "béta", "gamma", "Ñandú", "中文", "ÉTÉ", "zeta", "a", "b", "c", "eta🙂", "x\x7fy"]
    rows = []
    for k in range(300):
        n = draw.choice([0, 1, 5, 60])
        source = draw.choice(["s1", "s1", "s1", "s1", "s2", "s3", None, "é", "S1"])
        own = words + [f"only{source}"] * 3 + [f"w{k % 40}"]
        rows.append((draw.choice(["en", "en", "de", None]), source, ", ".join(draw.choice(own) for _ in range(n)) if n else draw.choice([None, "", "12 _%"])))
    # a language that keeps nothing, groups without terms, repeated rows, one source that writes most
    rows += [("xx", "a", "few words"), ("xx", "b", None), ("xx", "c", ""), ("yy", "z", "alone")] + [("en", "empty", None)] * 3
    return rows + [("en", "hot", "alpha beta gamma hot " * 200)] * 40


@pytest.mark.parametrize("least", [1, 5, 30])
def test_audit_equals_its_definition(spark, sources, least, monkeypatch):
    if least == 5:
        # counts handed on early, sums handed on early, long texts in pieces
        monkeypatch.setattr(op12_divergence, "ENTRIES", 7)
        monkeypatch.setattr(op12_divergence, "PIECE", 50)
    docs = sourced(spark, sources).repartition(5)
    got = op12_divergence.audit(docs, Stored(spark, "test-audit"), least, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(sources, least, 4)


def test_audit_of_nothing(spark):
    assert op12_divergence.audit(sourced(spark, []), Stored(spark, "test-audit")).count() == 0


def test_audit_query_equals_sql(spark):
    got = op12_divergence.op12_source_divergence(spark, MEDIUM)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{MEDIUM}/documents.parquet'")
        want = db.sql(op12_divergence.SQL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_tree_corrects_each_pair_of_nodes_once():
    """Shared beginnings are one path; sums equal those over all rows one by one."""
    draw = random.Random(4)
    base = {f"s{k}": 100 * k + 7 for k in range(6)}
    rows = Counter()
    for _ in range(400):
        some = [(s, base[s] + draw.choice([5, 900]), base[s]) for s in base if draw.random() < 0.5]
        if some:
            rows["en" if draw.random() < 0.7 else "de", tuple(some)] += 1
    want = Counter()
    for (lang, row), times in rows.items():
        for i, (a, pa_, ba) in enumerate(row):
            for b, pb, bb in row[i + 1 :]:
                want[lang, a, b] += times * (abs(pa_ - pb) - abs(pa_ - bb) - abs(ba - pb) + abs(ba - bb))
    tree = op12_divergence.Tree()
    visits, leave = [], op12_divergence.Tree.leave

    def counted(self, depth):
        visits.extend(range(depth, len(self.path)))
        leave(self, depth)

    op12_divergence.Tree.leave = counted
    try:
        for (lang, row), times in sorted(rows.items()):
            tree.insert(lang, list(row), times)
        tree.leave(0)
    finally:
        op12_divergence.Tree.leave = leave
    nodes = {(lang, row[: k + 1]) for lang, row in rows for k in range(len(row))}
    assert len(visits) == len(nodes) < sum(len(row) for _, row in rows)
    assert {(la, a, b): v for la, a, b, v in tree.sums()} == dict(want)


def test_long_texts_are_cut_between_terms(monkeypatch):
    raw = ("Abc déf! " * 300 + "x" * 500).encode()
    whole = [t for part in op12_divergence.pieces(raw) for t in part]
    monkeypatch.setattr(op12_divergence, "PIECE", 64)
    parts = list(op12_divergence.pieces(raw))
    assert len(parts) > 10 and [t for part in parts for t in part] == whole


# --- whitening ---


def symmetric(kind, n, rng):
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = {
        "random": rng.random(n) * 9,
        "repeated": np.repeat([3.0, 1.0], n)[n - n // 2 : 2 * n - n // 2],
        "one direction": np.r_[5.0, np.zeros(n - 1)],
        "graded": 10.0 ** -np.linspace(0, 14, n),
        "clusters": np.r_[rng.random(n // 2) * 1e-13 + 1, rng.random(n - n // 2)],
        "nothing": np.zeros(n),
        "both signs": rng.normal(size=n),
    }[kind]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ["random", "repeated", "one direction", "graded", "clusters", "nothing", "both signs"])
def test_components_by_divide_and_conquer(kind):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 64, 130):
        a = symmetric(kind, n, rng)
        values, vectors = op13_whitening.components(a)
        size = max(np.abs(a).max() * n, 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * size
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and (np.diff(values) <= 1e-14 * size).all()


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    a = symmetric("both signs", 40, rng)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(op13_whitening.polar(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


def test_packed_vectors_are_equal_where_vectors_are():
    for x in ([], [0], [1, -1], [0, 5, 0, 0], [127, -128], [128], [70000, 1], [2**40], [-(2**63), 2**63 - 1]):
        x = np.array(x, np.int64)
        raw = op13_whitening.packed(x)
        assert op13_whitening.packed(np.concatenate([x, np.zeros(3, np.int64)])) == raw
        assert op13_whitening.unpacked([raw], 9)[0].tolist() == x.tolist() + [0] * (9 - len(x))
        assert op13_whitening.unpacked([raw, b"\0\1"], 9)[0].tolist() == x.tolist() + [0] * (9 - len(x))
    assert op13_whitening.whole(np.array([0.99, -0.01, -0.0, 3e38, -3e38, 2.0**54])).tolist() == [253, -3, 0, 2**63 - 1, -(2**63), 2**62]


def plain_whitening(rows, most=4):
    """From (vec_id, list) rows. Also the space of each component, as signs and equal values leave it open."""
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in rows)
    rows = [(i, tuple(v + [0] * (size - len(v)))) for i, v in rows]
    fit = sorted({v for _, v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    out = []
    for i, v in rows:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for k, j in enumerate(order, 1):
            out.append((i, k, n, deviation, abs((np.array(v) - mean) @ vectors[:, j]) / math.sqrt(values[j]), values[j] / values.sum()))
    return out


def embedded(spark, rows):
    from salesflow.llm.common import ship

    ship(spark)
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, label int, x string, component double")


def test_whitening_equals_its_definition(spark):
    rng = np.random.default_rng(6)
    scale = np.array([3.0, 2.0, 1.5, 1.0, 0.6, 0.3])
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(120)]
    rows += [(5, rows[5][1]), (200, rows[7][1]), (None, rows[9][1])] + [(300 + i, rows[11][1]) for i in range(60)]
    rows += [(400, [1.0, 2.0]), (401, [])]
    rows += [(500, None), (501, [1.0, None, 2.0]), (502, [math.inf] * 6), (503, [math.nan] * 6)]
    got = op13_whitening.whiten(embedded(spark, rows).repartition(7), Stored(spark, "test-whitening"), 4).collect()
    want = plain_whitening(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [tuple(r)[:4] for r in sorted(got, key=key)] == [r[:4] for r in sorted(want, key=key)]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert abs(g["whitened"]) == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g["explained"] == pytest.approx(w[5], rel=1e-9)
        assert g["deviation_text"] == str(g["deviation"])
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    # one sign for all rows: the whitened fit list has the identity as its covariance
    by_id = {}
    for r in got:
        if r["vec_id"] is not None and (r["vec_id"] < 120 or r["vec_id"] in (400, 401)):
            by_id.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    matrix = np.array([[w[k] for k in range(1, 5)] for w in by_id.values()])
    assert np.abs(np.cov(matrix.T, bias=True) - np.eye(4)).max() < 1e-9


def test_whitening_of_odd_tables(spark):
    store = Stored(spark, "test-whitening")
    white = lambda rows: op13_whitening.whiten(embedded(spark, rows), store)
    assert white([]).count() == white([(1, None), (2, [])]).count() == 0
    # one vector only: nothing varies
    got = white([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect()
    assert sorted(map(tuple, got)) == [(i, k, 1, 0, 0.0, 0.0, 0.0, "0") for i in (1, 2) for k in (1, 2)]
    # deviations beyond a long are null and written out
    far = 2.0**53
    got = white([(1, [far, 0.0]), (2, [-far, 0.0]), (3, [1.0, 1.0])]).collect()
    assert {r["vec_id"]: (r["deviation"], r["deviation_text"]) for r in got}[1] == (None, str((3 * 2**61 - 256) ** 2 + 256**2))
    assert all(r["component"] in (1, 2) and math.isfinite(r["whitened"]) for r in got)
    got = white([(1, [3e38]), (2, [-3e38]), (3, [0.0])]).collect()
    assert len(got) == 3 and all(math.isfinite(r["whitened"]) for r in got)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain_whitening([(r[0], r[1]) for r in rows])
    got = op13_whitening.op13_embedding_whitening(spark, SMALL).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(r[:4] for r in want)
    near = {r[:2]: r[4:] for r in want}
    for r in got:
        white, explained = near[r["vec_id"], r["component"]]
        assert abs(r["whitened"]) == pytest.approx(white, rel=1e-6, abs=1e-6) and r["explained"] == pytest.approx(explained, rel=1e-8)
        assert r["identity_error"] < 1e-9


def test_arrow_lists_of_slices():
    """Offsets of a batch need not begin at 0."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[1.0], None, [2.0, 0.0]])], names=["a", "b"]).slice(1)
    (got,) = op13_whitening._quantize([batch])
    assert got.column(0).to_pylist() == [3] and got.column(2).to_pylist() == [2]
