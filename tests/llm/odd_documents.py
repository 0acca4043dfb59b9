"""Fixtures of the tests here: imported by them, as a second conftest would hide the first."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n string, key string, spans string, place string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use too."""
    from salesflow.llm.common import ship

    ship(spark)

    def build(pairs, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t), "x", "x", "x", "x", "x") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ids, shared passages."""
    draw = random.Random(11)
    words = ["alpha", "Beta", "gamma,", "délta", "ēps", "zeta.", "eta", "theta", "iota", "kappa"]

    def prose(n):
        return " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(n))

    base, passage = prose(200), prose(70)
    near = base.split(" ")
    near[100] = "changed"
    contact = "mail a.b@example.com or +1 (234) 555-7777, host 10.0.0.1, card 4111 1111 1111 1111, token = \"abcdefgh12345678\""
    texts = [None, "", " \n\t", "one", "two words", base, base, " ".join(near), prose(150) + " " + passage, passage + " " + prose(90)]
    texts += [prose(5000), "ab" * 700, contact, prose(80) + "\n" + contact, "é" * 500, "a\nb\na\nb\n" + "x y z " * 60, prose(60), prose(61)]
    pairs = list(enumerate(texts)) + [(4, "two words"), (16, prose(30)), (None, base), (None, None)]
    draw.shuffle(pairs)
    return pairs
