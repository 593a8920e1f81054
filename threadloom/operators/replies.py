"""Typed columns out of model replies.

A reply has metric lines ``(t, metric, value, confidence)``, a marker, and
headed bullet lists. Everything is read by array expressions within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.strings import let, strip

# The marker between the parts of a reply, and the words that
# head a list, in the order in which they are looked for.
MARKER = "<signal_context>"
SECTIONS = {
    "key_claims": ["key claims"],
    "supporting_text": ["supporting", "text"],
    "risk_assessment": ["risk", "assessment"],
    "viral_potential": ["viral", "potential"],
}

_METRIC = "struct<name:string,value:double>"
_LIST = "array<struct<section:string,item:string>>"


def split_sections(reply: Column) -> Column:
    """Struct of ``analysis``, ``context`` and the number of ``sections``.

    Without the marker the whole reply is the analysis.
    """

    def parts(x: Column) -> Column:
        return F.struct(
            strip(F.get(x, F.lit(0))).alias("analysis"),
            F.coalesce(strip(F.get(x, F.lit(1))), F.lit("")).alias("context"),
            F.size(x).alias("sections"),
        )

    return let(F.split(reply, MARKER), parts)


def _number(c: Column) -> Column:
    """A decimal number; a cast alone would also read Java's ``1.0d``."""
    written = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"
    return F.when(c.rlike(written), c.try_cast("double"))


def metric_rows(analysis: Column) -> Column:
    """Array of (t, name, value, confidence) in the order of their lines.

    A line counts if the text from its first ``(`` to its first ``)`` has four
    parts or more and the third is a number.
    """

    def row(line: Column) -> Column:
        inside = F.regexp_extract(line, r"^[^()]*\(([^)]*)\)", 1)
        return let(
            F.transform(F.split(inside, ","), strip),
            lambda p: F.when(
                F.size(p) >= 4,
                F.struct(
                    F.get(p, F.lit(0)).alias("t"),
                    F.get(p, F.lit(1)).alias("name"),
                    _number(F.get(p, F.lit(2))).alias("value"),
                    _number(F.get(p, F.lit(3))).alias("confidence"),
                ),
            ),
        )

    rows = F.transform(F.split(analysis, "\n"), row)
    return F.filter(rows, lambda r: r.isNotNull() & r["value"].isNotNull())


def last_metrics(rows: Column) -> Column:
    """Metric rows as a map; of rows with one name the last one counts."""

    def named(r: Column) -> Column:
        return F.struct(r["name"].alias("name"), r["value"].alias("value")).cast(_METRIC)

    def replace(found: Column, r: Column) -> Column:
        others = F.filter(found, lambda f: f["name"] != r["name"])
        return F.concat(others, F.array(named(r)))

    empty = F.array().cast(f"array<{_METRIC}>")
    return F.map_from_entries(F.aggregate(rows, empty, replace))


def _heading(line: Column) -> Column:
    low = F.lower(line)
    heading = F.lit(None).cast("string")
    for section, keywords in reversed(SECTIONS.items()):
        hit = F.lit(True)
        for keyword in keywords:
            hit = hit & low.contains(keyword)
        heading = F.when(hit, F.lit(section)).otherwise(heading)
    return heading


def context_items(context: Column) -> Column:
    """Array of (section, item): bullets under their headings, in order.

    A line with a heading's words is a heading, even if it is a bullet.
    """
    lines = F.transform(F.split(context, "\n"), strip)
    marked = F.transform(
        lines, lambda x: F.struct(x.alias("line"), _heading(x).alias("heading"))
    )
    empty = F.struct(
        F.lit(None).cast("string").alias("section"), F.array().cast(_LIST).alias("items")
    )

    def step(state: Column, x: Column) -> Column:
        item = strip(F.substring(x["line"], F.lit(2), F.length(x["line"])))
        bullet = x["line"].startswith("-") | x["line"].startswith("*")
        keep = x["heading"].isNull() & state["section"].isNotNull() & bullet & (item != "")
        entry = F.array(F.struct(state["section"].alias("section"), item.alias("item")))
        return F.struct(
            F.coalesce(x["heading"], state["section"]).alias("section"),
            F.when(keep, F.concat(state["items"], entry)).otherwise(state["items"]).alias("items"),
        )

    return F.aggregate(marked, empty, step, lambda state: state["items"])


def _section(items: Column, name: str) -> Column:
    own = F.filter(items, lambda x: x["section"] == name)
    return F.transform(own, lambda x: x["item"])


def parse_replies(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Add ``analysis``, ``context`` and ``metrics`` read from the reply."""
    parts = df.withColumn("_parts", split_sections(F.col(reply_col)))
    marked = F.col("_parts.sections") > 1
    rows = metric_rows(F.when(marked, F.col("_parts.analysis")).otherwise(F.lit("")))
    read = parts.withColumns(
        {
            "_named": let(rows, last_metrics),
            "_items": context_items(F.col("_parts.context")),
        }
    )
    length = F.when(marked, F.length("_parts.analysis")).otherwise(F.length(reply_col))
    sizes = F.create_map(
        F.lit("sections"), F.col("_parts.sections").cast("double"),
        F.lit("analysis_length"), length.cast("double"),
        F.lit("context_length"), F.length("_parts.context").cast("double"),
    )
    own = F.map_filter(sizes, lambda k, v: ~F.map_contains_key(F.col("_named"), k))
    return read.withColumns(
        {
            "analysis": F.struct(
                F.col("_parts.analysis").alias("thread_analysis"),
                F.col("_named").alias("metrics"),
            ),
            "context": F.struct(
                *[_section(F.col("_items"), name).alias(name) for name in SECTIONS]
            ),
            "metrics": F.map_concat(own, F.col("_named")),
        }
    ).drop("_parts", "_named", "_items")


def exploded_metrics(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """One row per metric line, with its time and confidence."""
    rest = [c for c in df.columns if c != reply_col]
    parts = split_sections(F.col(reply_col))
    rows = F.when(parts["sections"] > 1, metric_rows(parts["analysis"]))
    return df.select(*rest, F.posexplode(rows).alias("line", "_m")).select(*rest, "line", "_m.*")
