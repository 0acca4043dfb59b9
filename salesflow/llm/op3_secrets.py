"""Secret scans by dictionary-primed zstandard novelty.

Base findings are three fixed patterns. Beside them, long unbroken strings are candidates;
each is compressed after the code around it, with a dictionary of common identifiers, and
its marginal bytes are measured. Text like what surrounds it, words and identifiers cost
little; random key material costs its full entropy. What that comes to in bits depends on
the alphabet, the length and the literals around, so the measure is random strings of the
same alphabet and length in the same place. A candidate is reported (kind ``novel``) when it
costs about what they cost and its letters do not read as words, or costs more than any
alphabet does; mixes kinds of characters; and stands in a sensitive context, its own or
that of a candidate it adjoins (lines of a key, parts of a token joined by dots). Base findings always stay; a candidate inside one is not reported again.

Spans are in code points, end exclusive. Null texts count as empty: no findings, and the
digest of the empty string. Repeated rows give repeated results. Only doc_id and text are
read, so extra columns of any name do no harm.
"""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import documents, over_documents

# --- fixed values of the contract: the base kinds, in order, and their patterns ---
KINDS = ["assign", "access", "hex", "novel"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# maximal runs: shorter ones need no match object
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

# --- parameters of the method ---
AROUND = 400
#: Characters before and after a candidate that may make it sensitive.
SENSITIVE_AROUND = 48
#: Marginal bits a character from which a candidate is incompressible whatever it reads like.
NOVEL_BITS = 6.5
#: Share of its alphabet's bits that a candidate may cost less than random strings cost there.
NOVEL_SLACK = 0.13
CONTROLS = 4
#: Mean bits that pairs of letters gain over random ones from which they read as words, and
#: the least share of such pairs.
WORD_BITS, WORD_PAIRS = 0.4, 0.35
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|credential|private.?key|bearer|authorization|signature|access.?key", re.I)
_HAS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/=]")]
_LETTERS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Between candidates that share their context; a part of a dotted token may be short.
_ADJOINS = re.compile(r"""[\s"'.,;+>#*|\\]{1,48}|\.[A-Za-z0-9_-]{1,19}\.""")
#: Short pieces of a reported secret: a part between dots, the last line of a key.
_SHORT_PIECE = re.compile(r"""\.([A-Za-z0-9_-]{1,19})(?=\.[A-Za-z0-9_-]{20})|(?:\\r|\\n|[\s"',;+>#*|\\])+([A-Za-z0-9+/_=]{1,19})(?=(?:\\r|\\n|[\s"',;+>#*|\\])*-----END)""")
#: Common identifiers and words of configuration files and code.
IDENTIFIERS = b"""
import export from return function class public private protected static const final void string integer boolean
config configuration settings environment production development staging default value values name username user
password passwd secret token api_key apikey access_key secret_key private_key client_id client_secret credentials
authorization bearer basic header headers content-type application/json request response session cookie signature
https://www.example.com/ http://localhost:8080/ database connection host port postgres mysql redis mongodb amazonaws
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 placeholder changeme your_token_here example
getElementById addEventListener toString valueOf length index buffer encode decode base64 sha256 version license
"""


class Novelty:
    """Marginal compressed bytes of a candidate after its surroundings."""

    def __init__(self):
        words = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_checksum=False)

    def bits(self, before: str, candidate: str, after: str) -> float:
        """Bits a character of the candidate costs, given the text around it."""
        around = (after + "\n" + before).encode("utf-8", "replace")
        alone = len(self.compressor.compress(around))
        extra = len(self.compressor.compress(around + candidate.encode())) - alone
        return 8 * extra / len(candidate)

    def novel(self, before: str, candidate: str, after: str) -> bool:
        """Whether the candidate costs what random strings of its alphabet cost in its place."""
        if self.bits(before, candidate, after) >= NOVEL_BITS:
            return True
        if reads_as_words(candidate):
            return False
        around = (after + "\n" + before).encode("utf-8", "replace")
        letters, draw = alphabet(candidate), random.Random(candidate)
        own = len(self.compressor.compress(around + candidate.encode()))
        others = ("".join(draw.choices(letters, k=len(candidate))) for _ in range(CONTROLS))
        least = min(len(self.compressor.compress(around + other.encode())) for other in others)
        return 8 * (least - own) <= NOVEL_SLACK * math.log2(len(letters)) * len(candidate)


def alphabet(candidate: str) -> str:
    """All characters of the kinds that the candidate has; those of hexadecimal digits or of
    base 32 if it has no others."""
    last = 26 if re.search("[G-Zg-z]", candidate) else 6
    digits = "0123456789" if re.search("[0189]", candidate) or re.search("[a-z]", candidate) and re.search("[A-Z]", candidate) else "234567"
    kinds = ("abcdefghijklmnopqrstuvwxyz"[:last], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:last], digits)
    return "".join(k for p, k in zip(_HAS, kinds) if p.search(candidate)) + "".join(sorted(set(candidate) & set("+/_=-")))


def _pair_bits() -> dict[str, float]:
    """Bits that a pair of letters gains over a random one, as often as identifiers have it."""
    words = [w.lower() for w in _LETTERS.findall(IDENTIFIERS.decode()) if len(w) < 26]
    pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    firsts = Counter(p[0] for p in pairs.elements())
    return {a + b: math.log2(26 * (pairs[a + b] + 0.3) / (firsts[a] + 0.3 * 26)) for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123))}


PAIR_BITS = _pair_bits()


def reads_as_words(candidate: str) -> bool:
    gains = [PAIR_BITS[w[i : i + 2].lower()] for w in _LETTERS.findall(candidate) for i in range(len(w) - 1)]
    return len(gains) >= WORD_PAIRS * len(candidate) and sum(gains) > WORD_BITS * len(gains)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def sensitive_candidates(text: str) -> list[re.Match]:
    """Candidates with a sensitive word near them or near one of those that they adjoin."""
    found, group, near = [], [], False
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        if group and not _ADJOINS.fullmatch(text, group[-1].end(), start):
            found += group if near else []
            group, near = [], False
        group.append(m)
        near = near or bool(_SENSITIVE.search(text, max(0, start - SENSITIVE_AROUND), start) or _SENSITIVE.search(text, end, end + SENSITIVE_AROUND))
    return found + (group if near else [])


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    found = []
    for m in sensitive_candidates(text):
        start, end = m.span()
        if any(s <= start and end <= e for s, _, e in base):
            continue
        if sum(bool(p.search(m[0])) for p in _HAS) < 2:
            continue
        if novelty.novel(text[max(0, start - AROUND) : start], m[0], text[end : end + AROUND]):
            found.append((start, 3, end))
            short = _SHORT_PIECE.match(text, end)
            if short:
                found.append((short.start(short.lastindex), 3, short.end(short.lastindex)))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base (their spans) and spans (all), both as text."""

    def make():
        novelty = Novelty()

        def one(text):
            base = base_spans(text)
            spans = sorted(base + novel_spans(text, base, novelty))
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            return *counts, joined(base), joined(spans)

        return one

    fields = [(name, pa.int64(), "long") for name in ("n_assign", "n_access", "n_hex")]
    return over_documents(docs, make, [*fields, ("base", pa.string(), "string"), ("spans", pa.string(), "string")])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same documents with each run of overlapping spans replaced by ``mark`` in the
    text, and n_chars counted anew where the text changed."""

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), batch.schema.get_field_index("text")
            for i, text in enumerate(texts):
                base = base_spans(text or "")
                spans, end = sorted(base + novel_spans(text or "", base, novelty)), 0
                if spans:
                    parts = []
                    for start, _, stop in spans:
                        if start >= end:
                            parts += [text[end:start], mark]
                        end = max(end, stop)
                    texts[i] = "".join([*parts, text[end:]])
            batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield batch

    changed = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document."""
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
