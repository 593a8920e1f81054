"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is a blob, named by the SHA-256 of its text. The
ledger is a Parquet table of what has been scanned: one row per blob and scan,
with the rule versions that were applied and the places found. A run scans each
unseen pair of blob and rule version once, however many paths hold the blob,
appends it, and joins the findings back to all paths. The ledger keeps places,
never the secrets.

Defined results: null text is the empty text, a blob like any other; repeated
rows and null keys each get the findings of their blob; an empty table gives an
empty result and leaves the ledger as it was; other columns are not read. A run
that dies before its append leaves the ledger unchanged, so the next one scans
the same blobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.strings import let
from threadloom.llm import text as tx

LEDGER_SCHEMA = (
    "blob string, rules array<string>, "
    "found array<struct<rule:string,start:bigint,kind_rank:int,kind:string,stop:bigint>>"
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where to look at all, what to match, and the least length that counts.

    ``group`` is the part of the match whose length is tested (0: all of it).
    """

    kind: str
    hint: str
    pattern: str
    least: int
    group: int = 0

    @property
    def version(self) -> str:
        """Changes with anything that could change the rule's findings."""
        parts = "\x1f".join([self.kind, self.hint, self.pattern, str(self.least), str(self.group)])
        return f"{self.kind}-{hashlib.sha256(parts.encode()).hexdigest()[:12]}"

    def spans(self, text: Column) -> Column:
        def long_enough(match: Column) -> Column:
            value = F.regexp_extract(match, self.pattern, self.group) if self.group else match
            return F.length(value) >= self.least

        return tx.spans_if(text, text.rlike(self.hint), self.pattern, long_enough)


#: fixed values: the patterns of the base kinds; the hint only skips texts without a match
BASE_RULES = (
    Rule(
        "assign",
        r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 24),
)

#: fixed values: public formats of further secrets
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule(
        "jwt",
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ",
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        30,
    ),
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{1,}-----END [A-Z ]{0,20}PRIVATE KEY-----",
        1,
    ),
)

RULES = BASE_RULES + MORE_RULES


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger so far, or None before the first scan."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def find(text: Column, rules: tuple[Rule, ...], todo: Column | None = None) -> Column:
    """Findings of those ``rules`` in one text whose versions are in ``todo`` (None: all)."""

    def one(rank: int, rule: Rule) -> Column:
        spans = F.transform(
            rule.spans(text),
            lambda s: F.struct(
                F.lit(rule.version).alias("rule"),
                s["start"].alias("start"),
                F.lit(rank).alias("kind_rank"),
                F.lit(rule.kind).alias("kind"),
                s["stop"].alias("stop"),
            ),
        )
        if todo is None:
            return spans
        none = F.array().cast(
            "array<struct<rule:string,start:bigint,kind_rank:int,kind:string,stop:bigint>>"
        )
        return F.when(F.array_contains(todo, rule.version), spans).otherwise(none)

    return F.concat(*[one(rank, rule) for rank, rule in enumerate(rules)])


def unseen_blobs(
    versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``blob, text, todo``: distinct texts with the rule versions they were not scanned by."""
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # before the join, so that a text that many paths hold is sent once by each task
    blobs = blobs.withColumn("blob", blob_name(F.col("text"))).dropDuplicates(["blob"])
    seen = read_ledger(spark, ledger)
    if seen is None:
        return blobs.withColumn("todo", wanted)
    done = seen.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
    todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0)


def update_ledger(
    versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> None:
    """Scan all unseen pairs of blob and rule version and append them to the ledger."""
    scanned = unseen_blobs(versions, ledger, text, rules).select(
        "blob",
        F.col("todo").alias("rules"),
        let(F.col("text"), lambda t: find(t, rules, F.col("todo"))).alias("found"),
    )
    scanned.write.mode("append").parquet(ledger)


def scan(
    versions: DataFrame,
    ledger: str,
    key: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Findings of every path: ``key``, ``blob`` and ``spans`` by start, then kind as listed.

    The ledger is brought up to date first; the result reads it, not the texts.
    """
    update_ledger(versions, ledger, text, rules)
    current = [r.version for r in rules]
    known = read_ledger(versions.sparkSession, ledger)
    found = F.filter("found", lambda s: s["rule"].isin(current))
    # a blob has one row for each scan that met a new rule version
    known = known.where(F.size(found) > 0).groupBy("blob").agg(
        F.flatten(F.collect_set(found)).alias("found")
    )
    order = F.array_sort(
        F.transform(
            F.array_distinct("found"),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["kind_rank"].alias("rank"),
                s["kind"].alias("kind"),
                s["stop"].alias("stop"),
            ),
        )
    )
    paths = versions.select(F.col(key).alias("path"), blob_name(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")
    joined = paths.join(known.select("blob", order.alias("spans")), "blob", "left")
    return joined.select(
        F.col("path").alias(key), "blob", F.coalesce("spans", none).alias("spans")
    )


def redact(
    docs: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    by: Callable[[Column], Column] = lambda s: F.lit("[secret]"),
) -> DataFrame:
    """The documents with every secret replaced, all other columns as they are."""

    def cleaned(t: Column) -> Column:
        ordered = F.array_sort(F.transform(find(t, rules), lambda s: F.struct(s["start"], s["stop"])))
        return let(tx.merged(ordered), lambda m: tx.replaced(t, m, by))

    return docs.withColumn(text, let(F.col(text), cleaned))
