"""Personal data by candidate generators and gradient-boosted trees, in SQL expressions alone.

Base findings are four fixed patterns with their checks; they always stay. Generators of
high recall then propose spans of looser form, overlapping ones included. Boosted trees
score each from its format and the words before it, and what reaches a calibrated threshold is
reported: nothing else adds a span.

The trees are trained here, on at most ``SAMPLE_DOCUMENTS`` documents. Labels are weak: a
candidate is personal data if it is a base finding or meets a rule for looser forms
(``by_rule``: valid IBAN, valid IPv6, a number of 9 to 15 digits after a word of contact, an
obfuscated e-mail). Looser forms are rare and mostly meet no rule, so each base finding is also
rewritten, with what stands before it, into forms that people use (without the plus or
the country, dots for spaces, "(at)", blanks around the @) and into look-alikes that are none (a wrong
check digit, a date, a plain number, a sentence that goes on after the @); hashes of it give valid
and invalid IBANs and IPv6 addresses. Rules are thus labels, some of their checks are features, and forms that
no rule takes are found by what they look like.

The threshold is the smallest from ``LEAST_SCORE`` on with a precision of ``PRECISION`` on the
candidates of all documents that the trees were not fitted on, and on the rewritten findings of one in
``REWRITTEN`` of them, counted in Spark. The trees become one SQL expression: no Python touches
a row, and nothing is shuffled but the sample.

Spans are in code points, end exclusive. Null texts count as empty: no findings, and the
digest of the empty string. Repeated rows give repeated results. Only doc_id and text are
read, so extra columns of any name do no harm. Without a base finding in the sample there is
nothing to learn from, and there are base findings alone. Arrays of matches are built in blocks
of the square root of their number, so a text of very many matches costs little more
for each than one of few.
"""

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import documents

# --- fixed values of the contract: kinds in order; their patterns, written so that a failed
# start is not tried again inside the same run (\G: right after the last match) ---
KINDS = ["email", "ip", "card", "phone", "like"]
_FROM = r"(?:(?<![{0}])|\G)[{0}]++"
EMAIL = _FROM.format("A-Za-z0-9._%+-") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = _FROM.format("0-9") + r"\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# --- parameters of the method ---
GENERATORS = [
    r"[A-Za-z0-9._%+-]++\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]++)++",
    r"(?<![A-Za-z0-9])[+(]?[0-9][\x20().0-9-]{5,40}[0-9](?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?![A-Za-z0-9])",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    # an IBAN whose last group is short; a shortened IPv6; a spaced or obfuscated e-mail before a full stop
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    _FROM.format("A-Za-z0-9._%+-") + r"\s?(?:@|[(\[]at[)\]])\s?[A-Za-z0-9-]++(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9-]++)++",
]
#: Cheap patterns of texts that a generator has to search.
MAY = ["@|at[)\\]]", "[0-9][\\x20().0-9-]{5}", "[A-Z]{2}[0-9]{2}", ":[0-9A-Fa-f]{1,4}:", "[A-Z]{2}[0-9]{2}", "[0-9A-Fa-f]::[0-9A-Fa-f]", "\\s@|@\\s|(?:at|dot)[)\\]]"]
CONTEXT = 32
SAMPLE_DOCUMENTS = 4000
PRECISION, LEAST_SCORE = 0.98, 0.5
TREES, DEPTH = 20, 4
#: One in so many documents outside the sample also calibrates by its rewritten findings.
REWRITTEN = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(array: Column) -> Column:
    """An array in pieces of the square root of its length."""

    def cut(whole: Column) -> Column:
        each = F.ceil(F.sqrt(F.greatest(F.size(whole), F.lit(1)))).cast("int")
        number = F.ceil(F.greatest(F.size(whole), F.lit(1)) / each).cast("int")
        return F.transform(F.sequence(F.lit(0), number - 1), lambda k: F.slice(whole, k * each + 1, each))

    return let(array, cut)


def folded(array: Column, carry: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An array built element by element: ``step`` gives, from the carry and an element, the next
    carry and an array to append. Appending copies, so it is done within a block and by whole blocks."""

    def inner(done: Column, one: Column) -> Column:
        after, more = step(done["carry"], one)
        return F.struct(after.alias("carry"), F.concat(done["found"], more).alias("found"))

    def outer(done: Column, block: Column) -> Column:
        part = F.aggregate(block, F.struct(done["carry"].alias("carry"), empty.alias("found")), inner)
        return let(part, lambda p: F.struct(p["carry"].alias("carry"), F.concat(done["found"], F.array(p["found"])).alias("found")))

    start = F.struct(carry.alias("carry"), F.array_repeat(empty, F.lit(0)).alias("found"))
    return F.flatten(F.aggregate(blocks(array), start, outer, lambda done: done["found"]))


def located(text: Column, pattern: str, may: str) -> Column:
    """(start, value) of every match, leftmost first, in code points. The pieces between the
    matches give their places. Only texts that match the cheap pattern ``may`` are searched."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.expr("array_repeat(named_struct('start', 0, 'value', ''), 0)")
    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda one: one["hit"].isNotNull())

    # first where each block begins, then the places within it
    def begin(total: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda t, one: t + F.length(one["piece"]) + F.length(one["hit"]))
        return F.struct((total["at"] + size).alias("at"), F.concat(total["all"], F.array(total["at"])).alias("all"))

    def within(block: Column, first: Column) -> Column:
        def step(done: Column, one: Column) -> Column:
            start = done["at"] + F.length(one["piece"])
            found = F.array(F.struct(start.alias("start"), one["hit"].alias("value")))
            return F.struct((start + F.length(one["hit"])).alias("at"), F.concat(done["found"], found).alias("found"))

        return F.aggregate(block, F.struct(first.alias("at"), none.alias("found")), step, lambda done: done["found"])

    zero = F.struct(F.lit(0).alias("at"), F.expr("array_repeat(0, 0)").alias("all"))
    placed = let(blocks(pairs), lambda all_: F.flatten(F.zip_with(all_, F.aggregate(all_, zero, begin, lambda total: total["all"]), within)))
    return F.when(text.rlike(may), placed).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def weighed(place: Column) -> Column:
        digit = F.ascii(F.substring(digits, F.length(digits) + 1 - place, F.lit(1))) - 48
        doubled = digit * (2 - place % 2)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), weighed)
    return F.aggregate(places, F.lit(0), lambda total, one: total + one.cast("int")) % 10 == 0


def valid_ip(value: Column) -> Column:
    return value.rlike(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$")


def valid_card(value: Column) -> Column:
    digits = digits_of(value)
    return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def valid_phone(value: Column) -> Column:
    return F.length(digits_of(value)).between(9, 15)


BASE: list[tuple[str, str, Callable[[Column], Column]]] = [
    (EMAIL, "@", lambda value: F.lit(True)),
    (IP, r"[0-9]\.[0-9]", valid_ip),
    (CARD, "[0-9]", valid_card),
    (PHONE, r"\+[0-9]", valid_phone),
]


def spans_of(text: Column, kind: int) -> Column:
    """(start, kind, stop) of the base findings of one kind."""
    pattern, may, valid = BASE[kind]
    good = F.filter(located(text, pattern, may), lambda one: valid(one["value"]))
    return F.transform(good, lambda one: F.struct(one["start"].alias("start"), F.lit(kind).alias("kind"), (one["start"] + F.length(one["value"])).alias("stop")))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), an array of spans per base kind, and all sorted as ``base``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({f"s_{name}": spans_of(F.col("text"), k) for k, name in enumerate(KINDS[:4])})
    return rows.withColumn("base", F.array_sort(F.concat(*(f"s_{name}" for name in KINDS[:4]))))


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``candidates``: (start, stop, value, before) of what the generators propose."""
    text = F.col("text")
    found = [located(text, pattern, cheap) for pattern, cheap in zip(GENERATORS, MAY)]

    def proposed(one: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), one["start"] - CONTEXT + 1), F.least(one["start"], F.lit(CONTEXT)))
        return F.struct(one["start"].alias("start"), (one["start"] + F.length(one["value"])).alias("stop"), one["value"].alias("value"), F.lower(before).alias("before"))

    rows = rows.withColumn("proposed", F.array_distinct(F.concat(*found)))
    return rows.withColumn("candidates", F.transform("proposed", proposed)).drop("proposed")


def valid_iban(value: Column) -> Column:
    """The remainder by 97, first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    rest = F.aggregate(codes, F.lit(0), lambda r, c: F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97).cast("int"))
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


def valid_ipv6(value: Column) -> Column:
    """Eight groups, or three to seven and one gap, with a digit."""
    groups = F.regexp_count(value, F.lit("[0-9A-Fa-f]+"))
    short = value.rlike("^[0-9A-Fa-f:]+$") & value.contains("::") & groups.between(3, 7) & value.rlike("[0-9]")
    return value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | short


def by_rule(one: Column) -> Column:
    """Whether a candidate is personal data in a looser form, by rules of that form."""
    value, before = one["value"], one["before"]
    number = value.rlike(r"^[+(]?[0-9][\x20().0-9-]+$") & ~value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    phone = number & F.length(digits_of(value)).between(9, 15) & before.rlike(r"(?:phone|tel|call|fax|mobile|contact|whatsapp|sms)")
    hidden = value.rlike(r"[(\[](?:at|dot)[)\]]") & value.rlike(r"(?:\.|dot[)\]]\s?)[A-Za-z]{2,24}$") & ~value.rlike(r"\s[.@]|[.@]\s")
    return F.coalesce(valid_iban(value) | valid_ipv6(value) | phone | hidden, F.lit(False))


def features(one: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    value, before = one["value"], one["before"]
    digits = digits_of(value)
    n = F.length(digits)
    flags = [
        valid_ip(value),
        F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)),
        value.rlike(r"(?:@|at[)\]]).*(?:\.|dot[)\]])\s?[A-Za-z]{2,}$"),
        valid_iban(value),
        valid_ipv6(value),
        value.rlike(r"[.@][A-Za-z0-9-]+\.\s"),
        value.rlike(r"\s@|@\s"),
        value.rlike(r"\.\s"),
        value.rlike(r"[(\[](?:at|dot)[)\]]"),
        value.rlike(r"^[0-9]+$"),
        value.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?:$|[^0-9])"),
        value.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}$"),
        before.rlike("phone|tel|call|fax|mobile|contact"),
        before.rlike("mail|write|contact"),
        before.rlike("card|visa|account|iban|payment"),
        before.rlike(r"version|section|release|figure|page|\bno\b|nr"),
    ]
    counts = [
        F.length(value),
        n,
        F.regexp_count(value, F.lit("[0-9]+")),
        F.regexp_count(value, F.lit("[()]")),
        F.regexp_count(value, F.lit(r"\.")),
        F.regexp_count(value, F.lit("[ -]")),
        F.regexp_count(value, F.lit("[A-Za-z]")),
        F.length(F.regexp_extract(value, "[0-9]+$", 0)),
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in [*flags, *counts]]


def iban_of(digits: Column, off: int) -> Column:
    """A German IBAN of eighteen digits, with its check digits changed by ``off``."""
    number = F.concat(digits, F.lit("131400")).cast("decimal(38,0)")
    check = (98 - number % 97 + off) % 100
    plain = F.concat(F.lit("DE"), F.lpad(check.cast("int").cast("string"), 2, "0"), digits)
    return F.trim(F.regexp_replace(plain, "(.{4})", "$1 "))


def rewritings(kind: int, value: Column) -> list[tuple[Column, int]]:
    """Other forms of a base finding of one kind, and look-alikes: (value, label)."""
    digits = digits_of(value)
    if kind == 0:
        name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        dotted = F.regexp_replace(host, r"\.", " (dot) ")
        return [
            (F.concat(name, F.lit(" (at) "), dotted), 1),
            (F.concat(name, F.lit("[at]"), host), 1),
            (F.concat(name, F.lit(" @ "), host), 1),
            (F.concat(name, F.lit(" @ "), F.regexp_replace(host, r"\.", ". ")), 0),
            (F.concat(F.lit("@ "), F.regexp_replace(host, r"\.", ". The ")), 0),
        ]
    if kind == 1:
        hashed = F.md5(value)
        groups = F.regexp_replace(hashed, "(.{4})", "$1:")
        numbers = F.lpad(F.conv(F.substring(hashed, 1, 15), 16, 10), 18, "7")
        return [
            (F.rtrim(F.regexp_replace(groups, ":$", "")), 1),
            (iban_of(numbers, 0), 1),
            (iban_of(numbers, 1), 0),
            (F.regexp_replace(F.substring(numbers, 1, 8), "(..)(?=.)", "$1:"), 0),
        ]
    if kind == 2:
        last = F.substring(digits, -1, 1).cast("int")
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((last + 1) % 10).cast("string"))
        in_fours = [(F.regexp_replace(d, "(.{4})(?=.)", f"$1{sign}"), y) for d, y in ((digits, 1), (wrong, 0)) for sign in ". "]
        return [*in_fours, (digits, 1), (wrong, 0)]
    local = F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]*", "")
    return [
        (F.substring(value, F.lit(2), F.length(value)), 1),
        (F.when(F.length(digits_of(local)) >= 9, local), 1),
        (F.when(F.length(digits_of(local)) >= 9, F.translate(F.translate(local, "()", ""), " ", "-")), 1),
        (digits, 0),
        (F.concat(F.lit("20"), F.substring(digits, 2, 2), F.lit("-0"), F.substring(digits, 4, 1), F.lit("-1"), F.substring(digits, 5, 1)), 0),
        (F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3), F.lit("."), F.substring(digits, 6, 3)), 0),
    ]


def rewritten(text: Column) -> Column:
    """(value, before, label) of the rewritten base findings of a row from ``with_base``."""

    def of_kind(kind: int) -> Callable[[Column], Column]:
        def forms(span: Column) -> Column:
            value = F.substring(text, span["start"] + 1, span["stop"] - span["start"])
            before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] - CONTEXT + 1), F.least(span["start"], F.lit(CONTEXT))))
            return F.array(*(F.struct(v.alias("value"), before.alias("before"), F.lit(float(y)).alias("label")) for v, y in rewritings(kind, value)))

        return forms

    found = [F.flatten(F.transform(f"s_{name}", of_kind(kind))) for kind, name in enumerate(KINDS[:4])]
    return F.filter(F.concat(*found), lambda one: one["value"].isNotNull())


def _tree_sql(node, columns: list[Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    goes_left = columns[split.featureIndex()] <= float(split.threshold())
    return F.when(goes_left, _tree_sql(node.leftChild(), columns)).otherwise(_tree_sql(node.rightChild(), columns))


class Trees:
    """A boosted model as a SQL expression, with its threshold."""

    def __init__(self, model, threshold: float = 2.0):
        self.parts = list(zip(model._java_obj.trees(), model.treeWeights))
        self.threshold = threshold

    def score(self, columns: list[Column]) -> Column:
        margin = sum((_tree_sql(tree.rootNode(), columns) * float(weight) for tree, weight in self.parts), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def nearby(spans: Column) -> Column:
    """Spans in order of their starts, in blocks with their bounds: few of them come near a candidate."""

    def bounded(block: Column) -> Column:
        ends = F.transform(block, lambda s: s["stop"])
        return F.struct(block.alias("spans"), F.get(block, F.lit(0))["start"].alias("first"), F.array_max(ends).alias("last"))

    return F.transform(blocks(spans), bounded)


def among(near: Column, one: Column, test: Callable[[Column], Column]) -> Column:
    """Whether a span that meets a candidate passes a test."""

    def within(block: Column) -> Column:
        close = (block["first"] < one["stop"]) & (one["start"] < block["last"])
        return F.when(close, F.exists(block["spans"], test)).otherwise(F.lit(False))

    return F.exists(near, within)


def labelled(docs: DataFrame, rewrite: Column) -> DataFrame:
    """label and features of every candidate, and of rewritten findings of the rows where ``rewrite`` holds."""
    rows = with_candidates(with_base(docs.withColumns({"doc_id": docs["doc_id"].cast("long")})))

    def judged(one: Column, near: Column) -> Column:
        is_base = among(near, one, lambda span: (span["start"] == one["start"]) & (span["stop"] == one["stop"]))
        return F.struct(one["value"].alias("value"), one["before"].alias("before"), (is_base | by_rule(one)).cast("double").alias("label"))

    none = F.expr("array_repeat(named_struct('value', '', 'before', '', 'label', 0.0D), 0)")
    natural = let(nearby(F.col("base")), lambda near: F.transform("candidates", lambda one: judged(one, near)))
    both = F.concat(natural, F.when(rewrite, rewritten(F.col("text"))).otherwise(none))
    rows = rows.select(F.explode(both).alias("one"))
    return rows.select("one.label", *(x.alias(f"f{i}") for i, x in enumerate(features(F.col("one")))))


def train(docs: DataFrame, documents_at_most: int = SAMPLE_DOCUMENTS) -> Trees | None:
    """Trees from half of the first documents by a hash of doc_id, threshold from all others."""
    docs = docs.select("doc_id", "text")
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(documents_at_most).filter(F.xxhash64("id") % 2 == 0).persist()
    own = F.col("doc_id").cast("long") == F.col("id")
    rows = labelled(docs.join(F.broadcast(ids), own, "left_semi"), F.lit(True))
    names = rows.columns[1:]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).persist()
    try:
        if rows.agg(F.count_distinct("label")).first()[0] < 2:
            return None
        model = Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=1.0).fit(rows))
        others = labelled(docs.join(F.broadcast(ids), own, "left_anti"), F.pmod(F.xxhash64("doc_id"), F.lit(REWRITTEN)) == 1)
        scored = others.select("label", F.floor(model.score([F.col(n) for n in names]) * 100).alias("bin"))
        bins = scored.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy(F.desc("bin")).collect()
        n = good = 0
        for row in bins:
            n, good = n + row["n"], good + row["good"]
            if good >= PRECISION * n:
                model.threshold = max(LEAST_SCORE, row["bin"] / 100)
        return model
    finally:
        rows.unpersist()
        ids.unpersist()


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def find(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, counts of the base kinds, base (their spans) and spans (all), both as text."""
    rows = with_candidates(with_base(docs))
    none = F.expr("array_repeat(named_struct('start', 0, 'kind', 0, 'stop', 0), 0)")

    def reported(one: Column) -> Column:
        return F.lit(False) if model is None else model.score(features(one)) >= model.threshold

    def clear(one: Column, near: Column) -> Column:
        return ~among(near, one, lambda span: (span["start"] < one["stop"]) & (one["start"] < span["stop"]))

    rows = rows.withColumn("open", let(nearby(F.col("base")), lambda n: F.filter("candidates", lambda one: clear(one, n))))
    good = F.filter("open", reported)
    # of overlapping candidates the one that starts first stays, the longer one of two
    order = F.array_sort(F.transform(good, lambda one: F.struct(one["start"].alias("start"), (-one["stop"]).alias("stop"))))

    def step(end: Column, one: Column) -> tuple[Column, Column]:
        span = F.array(F.struct(one["start"].alias("start"), F.lit(4).alias("kind"), (-one["stop"]).alias("stop")))
        free = one["start"] >= end
        return F.when(free, -one["stop"]).otherwise(end), F.when(free, span).otherwise(none)

    added = folded(order, F.lit(0), none, step)
    counts = [F.size(f"s_{name}").cast("long").alias(f"n_{name}") for name in KINDS[:4]]
    rows = rows.withColumn("all", F.array_sort(F.concat("base", added)))
    return rows.select("doc_id", *counts, joined(F.col("base")).alias("base"), joined(F.col("all")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document."""
    docs = documents(spark, sf_dir)
    found = find(docs, train(docs))
    names = [f"n_{name}" for name in KINDS[:4]]
    return found.select("doc_id", *names, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
