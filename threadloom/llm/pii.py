"""Personal data: high-recall generators, boosted trees over format and context, calibrated cuts.

Base kinds (mail and network addresses, cards, international phones) are exact
patterns with checks and always count. Further generators propose loose spans
in what the base kinds leave over: any long run of digits and separators, the
parts of such a run that look like a number of their own, spelled-out mail
addresses, account numbers. Their spans overlap. Boosted trees, fitted here on
generated contexts, score each proposal by its format and its surroundings; a
cut per kind, calibrated on contexts kept out of the fit, selects.

The trees are compiled into one expression, so candidates are proposed, scored
and selected inside the document's row: nothing is exploded or shuffled.

Defined results: null text is the empty text for reports and stays null when
redacted; empty texts have no spans; repeated rows are treated alike; other
columns are left as they are.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.strings import let
from threadloom.llm import text as tx

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("number", "spelled", "account", "digits", "formatted")
KINDS = BASE_KINDS + MORE_KINDS
CONTEXT = 24

#: generated contexts the trees are fitted on, and the precision their cuts keep
TRAIN_ROWS = 3000
TREES = 12
DEPTH = 3
PRECISION = 0.98

#: fixed values: the base patterns. Possessive where nothing can be given back, so that long
#: runs need no recursion; a mail address starts where its run of characters does
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
CARD_LONG = r"[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: loose generators
RUN_LEAST = 7
#: a whole run, however long; 22 separators or more between two digits part runs
NUMBER = r"[(0-9](?:[\x20().-]{0,21}+[0-9])++"
#: numbers of their own inside runs, each overlapping the others: what blanks part, and three or
#: two groups of usual lengths, the short one not out of a longer chain
TOKEN = r"(?<![0-9).-])(?:\([0-9]{1,4}\)|[0-9])(?:[().-]{0,4}+[0-9])++"
THREE = r"(?<![0-9])[0-9]{3}[\x20.-](?:[0-9]{3}|[0-9]{4}(?=[\x20.-][0-9]{4}))[\x20.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9])[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}(?![0-9])"
TWO = r"(?<![0-9])(?<![0-9][.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])"
SPELLED = (
    r"(?i)[a-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{2,40}"
    r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,10}"
)
#: parts of longer runs, which overlap the spans of ``NUMBER``
DIGITS = r"(?<![0-9])[0-9]{13,19}(?![0-9])"
FORMATTED = r"(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
ACCOUNT = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}"

#: words before a number that speak for or against a person's number
CUES = r"(?i)(?:tel|phone|call|mobile|cell|fax|whatsapp|ssn|social security|iban|account|konto|mail|contact|reach)"
ANTI_CUES = r"(?i)(?:order|invoice|ref|version|isbn|page|model|build|price|total|sku|serial|part|line)"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def worth(d: Column, i: Column) -> Column:
        doubled = d * (1 + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    places = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    worths = F.transform(places, lambda c, i: worth(c.cast("int"), i))
    return F.aggregate(worths, F.lit(0), lambda a, x: (a + x).cast("int")) % 10 == 0


def _ip_parts(match: Column) -> Column:
    parts = F.split(match, r"\.", -1)
    short = F.transform(parts, lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(16, 19) & luhn(d))


def base_spans(text: Column) -> dict[str, Column]:
    """Exact spans per base kind; each is sought only where a cheap hint allows one."""
    return {
        "email": tx.spans_if(text, text.contains("@"), EMAIL),
        "ip": tx.spans_if(text, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, _ip_parts),
        "card": tx.spans_if(text, text.rlike(CARD_LONG), CARD_LONG, _card),
        "phone": tx.spans_if(
            text,
            text.rlike(r"\+[0-9]"),
            PHONE,
            lambda m: F.length(_digits(m)).between(8, 15),
        ),
    }


def candidates(text: Column) -> Column:
    """Loose proposals as named spans with their context; ``text`` without its base spans."""

    def of(kind: str, hint: str, pattern: str, keep=None) -> Column:
        spans = tx.spans_if(text, text.rlike(hint), pattern, keep, context=CONTEXT)
        return F.transform(
            spans,
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                s["match"].alias("match"),
                s["before"].alias("before"),
                s["after"].alias("after"),
            ),
        )

    def long(match: Column) -> Column:
        return F.length(match) >= RUN_LEAST

    run = r"[(0-9][0-9\x20().-]{5}"
    return F.concat(
        of("number", run, NUMBER, long),
        of("number", run, TOKEN, long),
        of("number", run, THREE),
        of("number", run, SOCIAL),
        of("number", run, TWO),
        of("spelled", r"(?i)(?:\(|\[|\x20)dot(?:\)|\]|\x20)", SPELLED),
        of("account", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", ACCOUNT),
        of("digits", r"[0-9]{13}", DIGITS),
        of("formatted", r"\([0-9]{2,4}\)", FORMATTED),
    )


FEATURES = (
    "kind", "length", "digits", "groups", "paren", "dot", "dash", "space", "first_group",
    "last_group", "luhn", "cue", "anti_cue", "money", "glued", "bracket_at",
)


def features(c: Column) -> Column:
    """Format and context of one candidate as numbers, in the order of ``FEATURES``."""
    match, before, after = c["match"], c["before"], c["after"]
    groups = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
    kind = F.array_position(F.array(*[F.lit(k) for k in MORE_KINDS]), c["kind"])

    def flag(x: Column) -> Column:
        return F.when(x, 1.0).otherwise(0.0)

    values = [
        kind,
        F.length(match),
        F.length(_digits(match)),
        F.size(groups),
        flag(match.contains("(")),
        flag(match.contains(".")),
        flag(match.contains("-")),
        flag(match.contains(" ")),
        F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        flag(luhn(_digits(match))),
        flag(before.rlike(CUES)),
        flag(before.rlike(ANTI_CUES)),
        flag(before.rlike(r"[$€£#=]\x20?$") | after.rlike(r"^\x20?[%$€£]")),
        flag(before.rlike(r"[\p{L}0-9_+]$") | after.rlike(r"^[\p{L}0-9_]")),
        flag(match.rlike(r"[(\[]")),
    ]
    return F.array(*[v.cast("double") for v in values])


@dataclass(frozen=True)
class Trees:
    """Fitted trees as nested tuples ``(feature, threshold, left, right)`` or a leaf's value."""

    roots: tuple
    weights: tuple[float, ...]
    cuts: tuple[tuple[str, float], ...]

    def probability(self, values: Column) -> Column:
        def grow(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(F.get(values, F.lit(feature)) <= threshold, grow(left)).otherwise(grow(right))

        margin = F.lit(0.0)
        for root, weight in zip(self.roots, self.weights):
            margin = margin + F.lit(weight) * grow(root)
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, c: Column) -> Column:
        """Whether a candidate's probability reaches the cut of its kind."""
        cut = F.lit(2.0)
        for kind, value in self.cuts:
            cut = F.when(c["kind"] == kind, value).otherwise(cut)
        return let(features(c), self.probability) >= cut


def _generated(rows: int, seed: int) -> list[dict]:
    """Contexts of known meaning: numbers that name a person, and numbers that do not."""
    rng = random.Random(seed)

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(right: bool) -> str:
        body = d(rng.choice([12, 14, 15, 15, 15]))
        worths = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(body))]
        check = -sum(w - 9 if w > 9 else w for w in worths) % 10
        return body + str(check if right else (check + rng.randint(1, 9)) % 10)

    def word() -> str:
        return "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))

    def plain() -> str:
        return f"{word()} {word()}{rng.choice([' ', ', ', ': ', '. '])}"

    cues = ["tel ", "phone: ", "call ", "mobile ", "fax: ", "reach me at ", "contact ", "cell "]
    anti = ["order ", "invoice no. ", "ref ", "version ", "isbn ", "page ", "model ", "build ", "total "]
    sep = ["-", ".", " "]
    out = []
    for _ in range(rows):
        s = rng.choice(sep)
        phone = rng.choice(
            [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(4)}"]
        )
        social = f"{d(3)}-{d(2)}-{d(4)}"
        other = rng.choice(
            [
                d(rng.randint(7, 22)), f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.20{d(2)}",
                f"20{d(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{d(1)}.{d(2)}.{d(3)}.{d(2)}",
                f"{d(4)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(5)} - {d(5)}", f"{d(2)} {d(2)} {d(2)} {d(2)}",
            ]
        )
        account = f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"
        code = f"{word()[:2].upper()}{d(2)}" + "".join(rng.choice("ABCDEF0123") for _ in range(16))
        spelled = f"{word()}.{word()}{rng.choice(['(at)', ' (at) ', '[at]'])}{word()}{rng.choice(['(dot)', ' (dot) ', '[dot]'])}com"
        phrase = f"{word()} at {word()} dot {word()[:4]}"
        after = rng.choice([" ", ". ", ", ", "\n"]) + word()
        kind, match, before, label = rng.choice(
            [
                ("number", phone, rng.choice(cues), 1),
                ("number", phone, plain(), 1),
                ("number", social, rng.choice(["ssn ", "social security ", plain()]), 1),
                ("number", phone, rng.choice(anti), 0),
                ("number", other, plain(), 0),
                ("number", other, rng.choice(anti), 0),
                ("number", phone, plain() + rng.choice(["$", "€", "#", "x"]), 0),
                ("account", account, rng.choice(["iban ", "account ", plain()]), 1),
                ("account", code, rng.choice([*anti, plain()]), 0),
                ("digits", card(True), plain(), 1),
                ("digits", card(False), plain(), 0),
                ("formatted", f"{rng.choice(['+1 ', '+49 ', ''])}({d(3)}) {d(3)}-{d(4)}", plain(), 1),
                ("formatted", f"({d(3)}) {d(3)} {d(4)}", rng.choice(anti), 0),
                ("spelled", spelled, plain(), 1),
                ("spelled", phrase, plain(), 0),
            ]
        )
        if kind == "number" and label and not ("(" in match or match.count("-") + match.count(".") + match.count(" ") >= 2):
            label = int(before in cues)
        out.append({"kind": kind, "match": match, "before": before[-CONTEXT:], "after": after[:CONTEXT], "label": label})
    return out


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    kind = "array<struct<kind:string,match:string,before:string,after:string,label:int>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("c"))
    return table.select(
        F.col("c.kind").alias("kind"),
        F.col("c.label").cast("double").alias("label"),
        features(F.col("c")).alias("values"),
    )


def _nodes(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (
        int(split.featureIndex()),
        float(split.threshold()),
        _nodes(node.leftChild()),
        _nodes(node.rightChild()),
    )


_FITTED: dict[tuple, Trees] = {}


def fit(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 7) -> Trees:
    """Boosted trees on ``rows`` generated contexts, cuts calibrated on a third as many more.

    The contexts do not depend on any table, so the fit is made once per process.
    """
    if (rows, seed) in _FITTED:
        return _FITTED[rows, seed]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    data = _frame(spark, _generated(rows, seed)).select("label", array_to_vector("values").alias("features"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed).fit(data.coalesce(1))
    roots = tuple(_nodes(tree._java_obj.rootNode()) for tree in model.trees)
    trees = Trees(roots, tuple(float(w) for w in model.treeWeights), ())
    held = _frame(spark, _generated(max(rows // 3, 1), seed + 1))
    scored = held.select("kind", "label", let(F.col("values"), trees.probability).alias("p")).collect()
    cuts = tuple((kind, _cut([(r.p, r.label) for r in scored if r.kind == kind])) for kind in MORE_KINDS)
    _FITTED[rows, seed] = Trees(roots, trees.weights, cuts)
    return _FITTED[rows, seed]


def _cut(scored: list[tuple[float, float]]) -> float:
    """The lowest probability from which on the precision is kept; none selects if there is none.

    Candidates of equal probability are selected together or not at all.
    """
    best, right, n = 2.0, 0, 0
    for p in sorted({p for p, _ in scored}, reverse=True):
        tied = [label for q, label in scored if q == p]
        right, n = right + sum(tied), n + len(tied)
        if right >= PRECISION * n:
            best = p
    return best


def found(text: Column, trees: Trees) -> Column:
    """``struct<base, more>``: named spans of the base kinds, and those the trees select."""

    def with_base(kinds: Column) -> Column:
        ordered = F.array_sort(
            F.transform(
                F.flatten(F.array(*[kinds[k] for k in BASE_KINDS])),
                lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")),
            )
        )

        def blank(s: Column) -> Column:
            return F.repeat(F.lit("\x00"), (s["stop"] - s["start"]).cast("int"))

        masked = let(tx.merged(ordered), lambda m: tx.replaced(text, m, blank))
        chosen = let(masked, lambda t: F.filter(candidates(t), trees.selects))
        rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.lit("number")) - 1
        named = F.transform(
            chosen,
            lambda c: F.struct(
                (rank + F.array_position(F.array(*[F.lit(k) for k in MORE_KINDS]), c["kind"]) - 1)
                .cast("int")
                .alias("rank"),
                c["start"].alias("start"),
                c["kind"].alias("kind"),
                c["stop"].alias("stop"),
            ),
        )
        base = F.concat(*[_by_kind(kinds[k], k, i) for i, k in enumerate(BASE_KINDS)])
        return F.struct(base.alias("base"), F.array_sort(F.array_distinct(named)).alias("more"))

    spans = base_spans(text)
    return let(F.struct(*[spans[k].alias(k) for k in BASE_KINDS]), with_base)


def _by_kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(rank).alias("rank"),
            s["start"].alias("start"),
            F.lit(kind).alias("kind"),
            s["stop"].alias("stop"),
        ),
    )


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, ``base`` and ``more`` spans, each by kind as listed, then start."""
    trees = fit(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), let(t, lambda x: found(x, trees)).alias("f"))
    return rows.select(F.col("k").alias(key), F.col("f.base").alias("base"), F.col("f.more").alias("more"))


def redact(
    docs: DataFrame,
    text: str = "text",
    by: Callable[[Column], Column] = lambda s: F.lit("[redacted]"),
) -> DataFrame:
    """The documents with all found spans replaced; overlapping spans are replaced as one."""
    trees = fit(docs.sparkSession)

    def cleaned(t: Column) -> Column:
        def cut(f: Column) -> Column:
            spans = F.transform(
                F.concat(f["base"], f["more"]),
                lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")),
            )
            return let(tx.merged(F.array_sort(spans)), lambda m: tx.replaced(t, m, by))

        return F.when(t.isNotNull(), let(found(t, trees), cut))

    return docs.withColumn(text, let(F.col(text), cleaned))
