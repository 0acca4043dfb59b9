"""BPE encoding and decoding.

A text is normalized and split into words as the vocabulary file says; each word is
merged by a priority queue of merge ranks over a doubly linked list of symbols. A merge
leaves the queue entries of its former neighbours where they are; an entry is skipped
when the pair it was made for is no longer there. Decoding concatenates vocabulary
strings, a space between them where the file names no decoder.

Frequent words are merged once per worker (a cache of bounded size). Null texts count as
empty and have no ids. Repeated rows give repeated results. Only doc_id and text are read,
so extra columns of any name do no harm.
"""

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import WordCache, documents, held, over_documents, over_texts

#: White space as the tokenizer's regular expressions have it.
SPACE = "\t-\r \x85\xa0  -     　"
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
_HIGH = re.compile("[\u0250-\U0010ffff]")


def _below(limit: int, kind: str) -> str:
    return "".join(chr(c) for c in range(128, limit) if unicodedata.category(chr(c))[0] == kind)


#: The same for texts of letters below U+0250, which the standard library matches faster.
_EUROPEAN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_below(0x250, 'L')}]+|[0-9{_below(0x250, 'N')}]|[^\t-\r \x85\xa0a-z0-9{_below(0x250, 'L')}{_below(0x250, 'N')}]+"
)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """A lower-casing word BPE with a word-end mark, from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab, letters = model["vocab"], _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.packed = WordCache(lambda word: np.array(self.merge(word), "<u4").tobytes())

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        merges, n = self.merges, len(ids)
        queue = [(*merges[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        queue = [(rank, i, made) for rank, made, i in queue]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            if j >= n or ids[i] < 0 or merges.get((ids[i], ids[j])) != (rank, made):
                continue  # stale: one of the two symbols has since been merged
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (next_pair := merges.get((made, ids[k]))) is not None:
                    heapq.heappush(queue, (next_pair[0], i, next_pair[1]))
            if (h := before[i]) >= 0 and (new_pair := merges.get((ids[h], made))) is not None:
                heapq.heappush(queue, (new_pair[0], h, new_pair[1]))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _LATIN.findall(text.lower())
        # lower case letter by letter: a capital sigma has no final form
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (_ANY if _HIGH.search(lowered) else _EUROPEAN).findall(lowered)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        packed = self.packed
        if "<|" not in text:
            return b"".join(map(packed.__getitem__, self.words(text)))
        out = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.extend(map(packed.__getitem__, self.words(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str) -> WordBpe:
    """One tokenizer per worker process and file."""
    return held((WordBpe, path), lambda: WordBpe(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers), n_tokens."""

    def make():
        bpe = load(path)

        def one(text):
            ids = bpe.encode(text)
            return ids, len(ids) // 4

        return one

    return over_documents(docs, make, [("ids", pa.binary(), "binary"), ("n_tokens", pa.int64(), "long")])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encode``, and the decoded text."""

    def make():
        bpe = load(path)
        return lambda ids: (bpe.decode(ids or b""),)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.string())])
    keyed = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return keyed.mapInArrow(over_texts(make, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded string")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = decode(encode(documents(spark, sf_dir), path), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
