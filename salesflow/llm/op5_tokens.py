"""Token counts by prefix dynamic programming.

The BPE encoding of a prefix is the encoding of a shorter prefix and one last token, and
that token is the only one ending there whose pair with the token before it re-encodes to
itself. So one pass finds, for every prefix, its last token and its exact token count,
and truncation or budget questions need no second encoding.

No piece of the vocabulary crosses from a Latin letter to another kind of character, or to a
space or line end (this is verified on loading), so a text is a sequence of independent
chunks; the table of a frequent chunk is computed once per worker (bounded cache).

Null texts count as empty: no tokens. Repeated rows give repeated results. Only doc_id and
text are read, so extra columns of any name do no harm.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from salesflow.llm.common import WordCache, documents, held, over_documents

LIMIT = 4096
MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(rf"\n|[ {MARK}]*[^ {MARK}\n{_LATIN}]*[{_LATIN}]*")
_LETTER = re.compile(f"[{_LATIN}]")


class PieceCounts:
    """Counts of a sentencepiece BPE model without text normalization, with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  É\t") != f"{MARK}ﬁ{MARK}{MARK}É\t":
            raise ValueError("expected a model without normalization, with a dummy prefix")
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.scores))
        for piece in self.scores:
            for a, b in zip(piece, piece[1:]):
                if "\n" in (a, b) or (b == MARK and a != MARK) or (_LETTER.match(a) and not _LETTER.match(b)):
                    raise ValueError(f"piece {piece!r} crosses a chunk boundary")
        self.lengths = {}
        for piece in self.scores:
            if len(piece) > 1:
                self.lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {c: sorted(found, reverse=True) for c, found in self.lengths.items()}
        self.fits = WordCache(self._is_pair, 400_000)
        self.whole = WordCache(lambda piece: len(self._merge(piece)) == 1)
        self.totals = WordCache(lambda chunk: self.prefixes(chunk)[-1])

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short string: the best-scored, then leftmost, pair first."""
        parts = list(text)
        while True:
            scored = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not scored:
                return parts
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _is_pair(self, pair: tuple[str, str]) -> bool:
        return self._merge(pair[0] + pair[1]) == list(pair)

    def prefixes(self, chunk: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters."""
        chunk = chunk.replace(" ", MARK)
        last, counts, scores, lengths = [""], [0], self.scores, self.lengths
        for end in range(1, len(chunk) + 1):
            for length in lengths.get(chunk[end - 2 : end], ()) if end > 1 else ():
                if length > end:
                    continue
                start = end - length
                piece = chunk[start:end]
                if piece in scores and (self.fits[last[start], piece] if start else self.whole[piece]):
                    last.append(piece)
                    counts.append(counts[start] + 1)
                    break
            else:
                c = chunk[end - 1]
                last.append(c)
                counts.append(counts[end - 1] + (1 if c in self.scores else len(c.encode())))
        return counts[1:]

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text)[:-1] if text else []

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.chunks(text)))

    def at_every_prefix(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... characters."""
        out, base = [0], 0
        for k, chunk in enumerate(self.chunks(text)):
            found = self.prefixes(chunk)
            out.extend(base + n for n in found[k == 0 :])
            base += found[-1]
        return np.array(out, "<u4")

    def longest_within(self, text: str, limit: int) -> tuple[int, int]:
        """The token count, and the length of the longest prefix of at most ``limit`` tokens."""
        chunks = self.chunks(text)
        totals = list(map(self.totals.__getitem__, chunks))
        total = sum(totals)
        if total <= limit:
            return total, len(text)
        ends = np.cumsum(totals)
        k = int(np.searchsorted(ends, limit, "right"))
        while k >= 0:
            before = int(ends[k - 1]) if k else 0
            start = sum(map(len, chunks[:k])) - 1
            within = [n for n, count in enumerate(self.prefixes(chunks[k]), 1) if before + count <= limit]
            if within:
                return total, start + within[-1]
            k -= 1
        return total, 0


def load(path: str) -> PieceCounts:
    """One model per worker process and file."""
    return held((PieceCounts, path), lambda: PieceCounts(path))


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, prefix_tokens: the exact count at every prefix, from the empty one on, as
    little-endian unsigned 32-bit integers."""

    def make():
        counts = load(path)
        return lambda text: (counts.at_every_prefix(text).tobytes(),)

    return over_documents(docs, make, [("prefix_tokens", pa.binary(), "binary")])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix
    of at most ``limit`` tokens)."""

    def make():
        counts = load(path)

        def one(text):
            total, fit = counts.longest_within(text, limit)
            return len(text.encode("utf-8", "surrogatepass")), total, total > limit, fit

        return one

    fields = [("n_bytes", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("over_limit", pa.bool_(), "boolean"), ("fit_chars", pa.int64(), "long")]
    return over_documents(docs, make, fields)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and where each would have to be cut."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
