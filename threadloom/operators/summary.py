"""Folding chunk analyses into one summary per query.

The result is one text per query by definition, so its parts meet in one row.
Their number is bounded by retrieval: k threads' chunks per query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.strings import is_blank, let, strip
from threadloom.operators.models import Complete, complete_prompts, render
from threadloom.operators.ordering import numbered
from threadloom.operators.replies import split_sections
from threadloom.session import materialise
from threadloom.sizing import broadcast_measured

# Headings of the context block, the line that names an event,
# and the shape of the summary used when the model gives none.
HEADINGS = {
    "key_claims": "Key Claims:",
    "supporting_text": "\nSupporting Evidence:",
    "risk_assessment": "\nRisk Assessment:",
    "viral_potential": "\nViral Potential:",
}
CLAIM_LINE = "Key claims detected:"
FALLBACK = (
    "### 1. Temporal Overview\n"
    "Time Range: {start_date} to {end_date}\n"
    "Active Periods: Multiple threads analyzed across the time range\n"
    "Thread Distribution: See detailed metrics below\n"
    "\n"
    "### 2. Thread Analysis\n"
    "{results}"
)


def context_block(context: Column) -> Column:
    """Headed bullet lists of a context struct; empty lists are left out."""
    blocks = []
    for name, heading in HEADINGS.items():
        items = context[name]
        bullets = F.transform(items, lambda x: F.concat(F.lit("- "), x))
        lines = F.concat(F.array(F.lit(heading)), bullets)
        blocks.append(F.when(F.size(items) > 0, F.array_join(lines, "\n")))
    return F.concat_ws("\n", *blocks)


def joined_texts(text: Column, order: Sequence[str]) -> Column:
    """Aggregate: the non-blank texts of a group, in order, joined by blank lines."""
    kept = F.when(~is_blank(text), strip(text))
    entry = F.when(kept.isNotNull(), F.struct(*order, kept.alias("_text")))
    entries = F.array_sort(F.collect_list(entry))
    return F.array_join(F.transform(entries, lambda e: e["_text"]), "\n\n")


def combine(
    df: DataFrame, by: Sequence[str], order: Sequence[str], text_col: str, output: str
) -> DataFrame:
    """Non-blank texts of a group, in order, joined by blank lines."""
    return df.groupBy(*by).agg(joined_texts(F.col(text_col), order).alias(output))


def event_name(reply: Column, length: int | None = None) -> Column:
    """First sentence of the line that follows the claim heading, unquoted.

    Null where the reply has no marker, or no such heading after it. ``length``
    cuts the sentence.
    """
    context = split_sections(reply)["context"]

    def name(parts: Column) -> Column:
        line = strip(F.substring_index(F.get(parts, F.lit(1)), "\n", 1))
        sentence = strip(F.substring_index(line, ".", 1))
        if length is not None:
            sentence = F.substring(sentence, 1, length)
        return F.when(F.size(parts) > 1, F.translate(sentence, "\"'", ""))

    return let(F.split(context, CLAIM_LINE), name)


def number_events(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    reply_col: str = "reply",
    length: int | None = None,
) -> DataFrame:
    """Rows with an event, named and numbered ``event1`` onward in each group.

    A row's number is its place in the order of all groups less that of its
    group's first row, so a group of any size is numbered by many tasks.
    """
    named = df.withColumn("event_name", event_name(F.col(reply_col), length))
    placed = numbered(named.filter(F.col("event_name").isNotNull()), [*by, *order])
    firsts = placed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    same = [placed[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]
    place = F.col("_place") - F.col("_first") + 1
    joined = placed.join(broadcast_measured(firsts), same)
    return joined.select(*named.columns, F.concat(F.lit("event"), place).alias("event_id"))


def analysis_section(reply: Column) -> Column:
    """Both parts of a reply inside section tags; null without the marker."""

    def section(p: Column) -> Column:
        text = F.format_string(
            "<analysis_section>\n%s\n%s\n</analysis_section>", p["analysis"], p["context"]
        )
        return F.when(p["sections"] > 1, text)

    return let(split_sections(reply), section)


def event_map(reply: Column, order: Sequence[str]) -> Column:
    """Aggregate: the events of a group, named and numbered in order, as JSON."""
    name = event_name(reply)
    entry = F.when(name.isNotNull(), F.struct(*order, name.alias("_name")))
    numbered = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e, i: F.struct(F.concat(F.lit("event"), i + 1).alias("key"), e["_name"].alias("value")),
    )
    return F.to_json(F.map_from_entries(numbered))


def structured_results(
    df: DataFrame, by: Sequence[str], order: Sequence[str], reply_col: str = "reply"
) -> DataFrame:
    """Per group: the joined analysis sections and the event map as JSON."""
    reply = F.col(reply_col)
    return df.groupBy(*by).agg(
        joined_texts(analysis_section(reply), order).alias("structured_results"),
        event_map(reply, order).alias("event_map"),
    )


def fallback_summary(start: Column, end: Column, results: Column) -> Column:
    return render(FALLBACK, start_date=start, end_date=end, results=results)


def final_summary(
    df: DataFrame,
    providers: Sequence[tuple[str, Complete]],
    system_prompt: str,
    user_prompt: str,
    fallback_length: int | None = None,
    complete: Callable[..., DataFrame] = complete_prompts,
) -> DataFrame:
    """One model call per row of (query, start_date, end_date, combined_summary,
    combined_context, structured_results, event_map), giving ``summary``.

    A blank reply falls back to the structured results, a failed call to the
    combined analyses, cut to ``fallback_length`` if given; no analyses, no
    summary. Replies are stored, so that reading the result asks no model again.
    ``complete`` stands in for ``complete_prompts``, say with a ledger.
    """
    analyses = F.col("combined_summary")
    if fallback_length is not None:
        analyses = F.substring(analyses, 1, fallback_length)
    context = F.concat_ws(
        "\n\n",
        F.coalesce("combined_context", F.lit("")),
        F.concat(F.lit("<event_mapping>\n"), F.col("event_map"), F.lit("\n</event_mapping>")),
    )
    span = F.concat(
        F.lit("Time Range: "), F.col("start_date"), F.lit(" to "), F.col("end_date")
    )
    user = render(
        user_prompt,
        query=F.col("query"),
        temporal_context=span,
        context=context,
        results=F.col("structured_results"),
        start_date=F.col("start_date"),
        end_date=F.col("end_date"),
    )
    asked = df.withColumns({"_system": F.lit(system_prompt), "_user": user})
    worth = ~is_blank(F.col("combined_summary"))
    answered = materialise(complete(asked.filter(worth), "_system", "_user", providers))
    reply = F.when(
        F.col("error").isNotNull(),
        fallback_summary(
            F.col("start_date"),
            F.col("end_date"),
            analyses,
        ),
    ).when(
        is_blank(F.col("reply")),
        fallback_summary(F.col("start_date"), F.col("end_date"), F.col("structured_results")),
    ).otherwise(F.col("reply"))
    done = answered.withColumn("summary", reply).select(*df.columns, "summary")
    nothing = df.filter(~worth).withColumn("summary", F.lit(""))
    return done.unionByName(nothing)
