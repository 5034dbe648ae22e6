"""Personal data in texts: candidate spans, gradient-boosted trees, calibrated thresholds.

Everything here is DataFrame functions and Spark ML. Generators propose spans: the four base patterns
(whose valid matches always count), tighter forms inside base matches that failed as a whole (two
card numbers in a row, a phone number followed by an address), and looser forms outside. Trees score
each candidate by its format and surroundings alone: the check of its kind (Luhn, octets, number of
digits) is no feature, so they cannot repeat it. An added span has to pass both, check and score.

The trees learn from all documents: from candidates that the rule of their kind judges
(base matches and the tighter forms inside them), from valid ones respelt in the looser forms where they
stand, and from decoys, which look the same in other places: numbers behind words that announce a
reference, and words of the text on both sides of a spelt at sign. A quarter of the documents is held
out; an isotonic fit on it sets, for each kind, the lowest score from which nine of ten of these are good. The
looser forms that a text itself holds teach nothing and set no threshold; they are only scored.

A document's candidates stay in its row, so scoring moves nothing. No pattern backtracks over more
than one run of its characters, so long texts cost linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.llm.sampling import ROW, distinct_rows, row_key, rows_of, sampled
from backhaul.llm.scratch import stored

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.9
_TREES, _DEPTH, _BINS = 12, 4, 20

# Base patterns, with possessive quantifiers where nothing can be gained by giving back.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Forms inside base matches that failed, and forms that the base patterns do not know.
_TIGHT_CARD = r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])"
_TIGHT_PHONE = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"
_PLAIN_PHONE = r"(?<![0-9+.-])(?<!\+[0-9]{1,3}\x20)\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])"
_SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
_CONTEXT = 24
_HINTS = r"(?i)mail|contact|phone|tel|call|mobile|card|visa|pay|account|address|server|host"
# Words before numbers that are no one's, for the decoys.
_REFERENCES = [
    "section", "article", "clause", "rule", "figure", "table", "chapter", "version", "part", "paragraph", "code",
    "order", "invoice", "serial", "isbn", "line", "page", "item", "abschnitt", "artikel", "kapitel", "seite",
    "chapitre", "facture", "capitulo", "pedido",
]
_REFERENCE = rf"(?i)\b(?:{'|'.join(_REFERENCES)})[\s.:#]*$"


def _scan(sizes: Column) -> Column:
    """Sums of the entries before each entry."""
    return F.aggregate(
        sizes,
        F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("sum")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum")
        ),
        lambda acc: acc["out"],
    )


def running(sizes: Column, block: int = 256) -> Column:
    """Like `_scan`, in blocks, so that long arrays are not copied once per entry."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(sizes) / block).cast("int") - 1)
    parts = F.transform(starts, lambda b: F.slice(sizes, b * block + 1, block))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
    shifted = F.zip_with(parts, _scan(totals), lambda p, base: F.transform(_scan(p), lambda x: x + base))
    return F.when(F.size(sizes) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<long>"))


def _spans(found: Column, gaps: Column, before: Column, start: Column | None = None) -> Column:
    """Structs of matches, the gaps around them and the lengths before each gap."""

    def one(m: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        begin = F.get(before, i) + F.length(gap)
        if start is not None:
            begin = begin + start
        return F.struct(
            begin.alias("start"),
            (begin + F.length(m)).alias("end"),
            m.alias("text"),
            F.right(gap, F.lit(_CONTEXT)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
        )

    return F.transform(found, one)


def _sizes(found: Column, gaps: Column) -> Column:
    return F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))


def _inside(failed: Column, pattern: str) -> Column:
    """Matches of a tighter pattern in failed matches, in places of the whole text."""

    def one(span: Column) -> Column:
        found = F.regexp_extract_all(span["text"], F.lit(pattern), F.lit(0))
        gaps = F.split(span["text"], pattern, -1)
        return _spans(found, gaps, running(_sizes(found, gaps)), span["start"])

    return F.flatten(F.transform(failed, one))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(text)), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    )
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(_OCTETS),
        "card": F.when(n.between(14, 19), _luhn(text)).otherwise(False),
        "phone": n.between(10, 15),
    }[kind]


def _checked(s: Column) -> Column:
    """Whether a candidate passes the check of its kind."""
    passed = F.lit(False)
    for i, kind in enumerate(KINDS):
        passed = F.when(s["kind"] == i, _valid(kind, s["text"])).otherwise(passed)
    return passed


def candidates(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """doc_id, text, `keep` as _row, and `spans`: kind, start, end, text, before, after,
    base (a valid match of a base pattern) and judged (the rule of its kind tells whether it is good)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [] if keep is None else [keep.alias("_row")]
    at = docs.select(F.col("doc_id").cast("long"), text.alias("text"), *kept)
    none = F.array().cast("array<string>")
    digit, sign = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    plus, open_ = F.col("text").contains("+"), F.col("text").rlike(r"\([0-9]{3}\)")
    generators = {
        "email": (_EMAIL, sign),
        "ip": (_IP, digit & F.col("text").contains(".")),
        "card": (_CARD, digit),
        "phone": (_PHONE, digit & plus),
        "plain_phone": (_PLAIN_PHONE, open_),
        "spelt_email": (_SPELT_EMAIL, F.col("text").rlike(r"[\[(]at[\])]")),
    }
    some = {f"m_{g}": F.when(likely, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for g, (p, likely) in generators.items()}
    at = at.withColumns(some)
    at = at.withColumns(
        {f"g_{g}": F.when(F.size(f"m_{g}") > 0, F.split("text", p, -1)).otherwise(none) for g, (p, _) in generators.items()}
    )
    at = at.withColumns({f"b_{g}": running(_sizes(F.col(f"m_{g}"), F.col(f"g_{g}"))) for g in generators})
    at = at.withColumns({g: _spans(F.col(f"m_{g}"), F.col(f"g_{g}"), F.col(f"b_{g}")) for g in generators})

    def marked(spans: Column, kind: str, base: Callable[[Column], Column], judged: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "text", "before", "after")], base(s).alias("base"),
                F.lit(judged).alias("judged"),
            ),
        )

    def bad(kind: str) -> Column:
        return F.filter(kind, lambda s: ~_valid(kind, s["text"]))

    no = lambda s: F.lit(False)
    proposed = [marked(F.col(k), k, lambda s, k=k: _valid(k, s["text"]), True) for k in KINDS]
    proposed += [
        marked(_inside(bad("card"), _TIGHT_CARD), "card", no, True),
        marked(_inside(bad("phone"), _TIGHT_PHONE), "phone", no, True),
        marked(F.col("plain_phone"), "phone", no, False),
        marked(F.col("spelt_email"), "email", no, False),
    ]
    # A single digit or a short number proposes nothing: no card has under eight digits.
    wanted = F.filter(F.concat(*proposed), lambda s: (s["kind"] != KINDS.index("card")) | (F.length(_digits(s["text"])) >= 8))
    return at.select("doc_id", "text", *(["_row"] if kept else []), wanted.alias("spans"))


def features(s: Column) -> list[Column]:
    """Format and surroundings of a candidate, as numbers; nothing that its kind's check looks at."""
    text, before = s["text"], s["before"]
    groups = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.length)
    local, domain = F.regexp_extract(text, "^[^@\\[( ]*", 0), F.regexp_extract(text, "[A-Za-z0-9.-]*$", 0)
    return [
        *[(s["kind"] == k).cast("double") for k in range(len(KINDS))],
        F.length(text).cast("double"),
        F.size(groups).cast("double"),
        F.coalesce(F.array_max(groups), F.lit(0)).cast("double"),
        F.coalesce(F.array_min(groups), F.lit(0)).cast("double"),
        F.size(F.array_distinct(F.split(text, ""))).cast("double"),
        text.startswith("+").cast("double"),
        text.contains("(").cast("double"),
        text.contains(" ").cast("double"),
        text.contains("-").cast("double"),
        F.length(local).cast("double"),
        local.rlike("[0-9._%+-]").cast("double"),
        F.size(F.split(domain, "[.]")).cast("double"),
        F.length(F.substring_index(domain, ".", -1)).cast("double"),
        domain.rlike("[0-9]").cast("double"),
        before.rlike("[A-Za-z0-9]$").cast("double"),
        before.rlike("[.+-]$").cast("double"),
        s["after"].rlike("[A-Za-z0-9.@-]").cast("double"),
        before.rlike(_HINTS).cast("double"),
        before.rlike(_REFERENCE).cast("double"),
    ]


def _examples(s: Column) -> Column:
    """What a candidate teaches: structs like candidates, each with its label `good`."""
    email, card, phone = (KINDS.index(k) for k in ("email", "card", "phone"))

    def example(kind: Column, text: Column, before: Column, good: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), before.alias("before"), s["after"].alias("after"), good.alias("good"))

    yes, no = F.lit(True), F.lit(False)
    none = F.array().cast("array<struct<kind:int,text:string,before:string,after:string,good:boolean>>")
    digits = F.right(_digits(s["text"]), F.lit(10))
    plain = F.concat(F.lit("("), F.left(digits, F.lit(3)), F.lit(") "), F.substr(digits, F.lit(4), F.lit(3)), F.lit("-"), F.right(digits, F.lit(4)))
    spelt = F.regexp_replace(s["text"], "@", " [at] ")
    # A reference word that the candidate's text picks, in place of what stands before it.
    pick = F.pmod(F.xxhash64(s["text"]), F.lit(len(_REFERENCES))).cast("int")
    elsewhere = F.concat(F.right(s["before"], F.lit(8)), F.lit(" "), F.get(F.array(*map(F.lit, _REFERENCES)), pick), F.lit(" "))
    words = F.regexp_extract_all(s["before"], F.lit("[A-Za-z]{2,}"), F.lit(0))
    said = F.concat(F.element_at(words, -1), F.lit(" [at] "), F.get(words, F.lit(0)), F.lit("."), F.get(words, F.lit(1)))
    kind = s["kind"]
    return F.concat(
        F.when(s["judged"], F.array(example(kind, s["text"], s["before"], _checked(s)))).otherwise(none),
        F.when(
            s["base"] & (kind == phone),
            F.array(example(kind, plain, s["before"], yes), example(kind, plain, elsewhere, no), example(kind, s["text"], elsewhere, no)),
        ).otherwise(none),
        F.when(s["base"] & (kind == card), F.array(example(kind, s["text"], elsewhere, no))).otherwise(none),
        F.when(s["base"] & (kind == email), F.array(example(kind, spelt, s["before"], yes))).otherwise(none),
        # An at sign between words that stand in the text: good spans' own places, not their number.
        F.when(s["base"] & (F.size(words) >= 3), F.array(example(F.lit(email), said, s["before"], no))).otherwise(none),
    )


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, their weights, and the
    score from which candidates of each kind count (none if the kind has no entry)."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, values: list[Column]) -> Column:
        """Probability that a candidate is good, before calibration."""

        def tree(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(values[at] <= threshold, tree(left)).otherwise(tree(right))

        total = F.lit(0.0)
        for w, t in zip(self.weights, self.trees):
            total = total + w * tree(t)
        return 1 / (1 + F.exp(-2 * total))


def _node(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _node(node.leftChild()), _node(node.rightChild())


def _thresholds(rows: list) -> dict[int, float]:
    """Per kind the lowest score from which an isotonic fit of the hit rate reaches PRECISION."""
    out = {}
    for kind in {r.kind for r in rows}:
        blocks: list[list[float]] = []  # score, good, all
        for r in sorted((r for r in rows if r.kind == kind), key=lambda r: r.low):
            blocks.append([r.low, r.good, r.n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                _, good, n = blocks.pop()
                blocks[-1][1] += good
                blocks[-1][2] += n
        fit = [score for score, good, n in blocks if good >= PRECISION * n]
        if fit:
            out[kind] = min(fit)
    return out


def train(docs: DataFrame, sample: int | None = None) -> Model:
    """Fit the trees on the candidates of all documents, or of at most `sample` of them, those with the
    lowest hash of doc_id and text; repeated rows count once; a quarter of them sets the thresholds.
    Without both good and bad examples the model is empty, and only base spans count."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    # No candidate that teaches anything is without one of these.
    texts = docs.where(F.col("text").rlike("[@0-9]"))
    if sample is None:
        texts = texts.select("doc_id", "text", row_key().alias(ROW))
    else:
        texts = rows_of(texts, sampled(distinct_rows(texts), sample), "doc_id", "text", ROW)
    # The outer form: Spark would filter by the inner one first and so find all spans twice.
    each = candidates(texts, F.col(ROW)).select("_row", F.posexplode_outer("spans").alias("at", "s")).where("s is not null")
    names = [f"f{i}" for i in range(len(features(F.col("s"))))]
    taught = each.select("_row", "at", F.posexplode(_examples(F.col("s"))).alias("of", "e"))
    judged = taught.select(
        "_row",
        "at",
        "of",
        F.col("e.kind").alias("kind"),
        F.col("e.good").cast("double").alias("label"),
        *[f.alias(n) for f, n in zip(features(F.col("e")), names)],
    ).distinct()
    rows = stored(judged.select((F.xxhash64("_row") % 4 == 0).alias("held"), "kind", "label", *names), "pii-examples")
    fit = rows.where("not held")
    if fit.select("label").distinct().count() < 2:
        return Model()
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(fit).select("label", "x")
    fitted = GBTClassifier(
        featuresCol="x", labelCol="label", maxIter=_TREES, maxDepth=_DEPTH, stepSize=0.3, seed=7
    ).fit(vectors)
    model = Model([_node(t._call_java("rootNode")) for t in fitted.trees], [float(w) for w in fitted.treeWeights])
    scored = rows.where("held").select("kind", "label", model.score([F.col(n) for n in names]).alias("score"))
    bins = scored.groupBy("kind", F.floor(F.col("score") * _BINS).alias("bin")).agg(
        F.min("score").alias("low"), F.sum("label").alias("good"), F.count("*").alias("n")
    )
    return Model(model.trees, model.weights, _thresholds(bins.collect()))


def _named(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
    )


def find(docs: DataFrame, model: Model, keep: Column | None = None) -> DataFrame:
    """doc_id, text, base (spans of the base rules) and spans (these and the ones the trees add).

    Null texts are empty and have no spans, nor have blank ones. Repeated rows and rows without an id
    each get a row, an empty table gives none; texts of any length are searched whole; other columns are
    not read. An added span passes the check of its kind, and never overlaps a base span of its kind.
    """
    found = candidates(docs, keep)
    width = len(features(F.col("s")))

    def good(t: Column) -> Column:
        s = t["s"]
        if not model.thresholds:
            return s["base"]
        limit = F.lit(2.0)
        for kind, threshold in sorted(model.thresholds.items()):
            limit = F.when(s["kind"] == kind, F.lit(threshold)).otherwise(limit)
        return s["base"] | (_checked(s) & (model.score([F.get(t["x"], F.lit(i)) for i in range(width)]) >= limit))

    # Features once per candidate, however many nodes of the trees ask for them.
    described = F.transform("spans", lambda s: F.struct(s.alias("s"), F.array(*features(s)).alias("x")))
    scored = found.withColumn("spans", F.transform(F.filter(described, good), lambda t: t["s"]))
    return scored.withColumn("base", F.filter("spans", lambda s: s["base"]))


def digest(found: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, all columns kept.

    Overlapping spans are replaced as one, named after the first. Null texts stay null.
    """
    found = find(docs, model, keep=F.struct(*[docs[c] for c in docs.columns]))
    ordered = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    )
    span = "array<struct<start:long,kind:int,end:long>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(
            last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end")
        )
        over = (F.size(acc) > 0) & F.coalesce(s["start"] < F.get(acc, F.size(acc) - 1)["end"], F.lit(False))
        return F.when(over, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(s))
        )

    merged = found.withColumn("merged", F.aggregate(ordered, F.array().cast(span), add))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def part(s: Column, i: Column) -> Column:
        at = F.when(i > 0, F.get("merged", i - 1)["end"]).otherwise(0)
        return F.concat(F.substr("text", at + 1, s["start"] - at), F.get(kinds, s["kind"]))

    rest = F.substr("text", F.get("merged", F.size("merged") - 1)["end"] + 1)
    whole = F.concat(F.array_join(F.transform("merged", part), ""), rest)
    text = F.when(F.size("merged") > 0, whole).otherwise(F.col("_row")["text"])
    return merged.select(*[(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
