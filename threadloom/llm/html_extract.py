"""Main text of web pages: a recurrent labeller decides block by block.

A page is cut into leaf blocks. A bidirectional LSTM in numpy reads their tag
paths and words as hashed vectors, in both directions over the whole page, and
labels each block with that context. It is fitted on made pages whose blocks
are known, so no table has to be labelled, and the same on every run.

Defined results: null and empty pages, and pages without a main block, give the
empty text. Pages of any length are read whole; repeated rows are treated alike;
null keys are kept; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.html_blocks import blocks
from threadloom.llm.html_model import Network, Vectors, fit, label_pages

#: pages cut and labelled at a time
GROUP = 256


def extract_pages(pages: list[str | None], net: Network, vectors: Vectors) -> list[tuple[str, int, int]]:
    """``text, kept blocks, blocks`` of every page."""
    out = []
    for at in range(0, len(pages), GROUP):
        cut = [blocks(p) for p in pages[at : at + GROUP]]
        kept = label_pages(net, [vectors.page(c) for c in cut])
        for c, k in zip(cut, kept):
            own = [b.text for b, main in zip(c, k) if main]
            out.append(("\n".join(own), len(own), len(c)))
    return out


def main_text(html: Column, net: Network | None = None) -> Column:
    """``struct<text, kept_blocks, blocks>`` of a column of pages."""
    net = net or fit()

    @F.pandas_udf("struct<text:string,kept_blocks:int,blocks:int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for pages in batches:
            rows = extract_pages([p if isinstance(p, str) else None for p in pages], net, vectors)
            yield pd.DataFrame(rows, columns=["text", "kept_blocks", "blocks"])

    return of(html)


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns, ``text``, ``n_chars``, and how many ``blocks`` were kept."""
    own = pages.select(F.struct(*carry).alias("own"), main_text(F.col(html)).alias("m"))
    return own.select(
        "own.*",
        F.col("m.text").alias("text"),
        F.length("m.text").cast("bigint").alias("n_chars"),
        F.col("m.kept_blocks").alias("kept_blocks"),
        F.col("m.blocks").alias("blocks"),
    )
