"""Nested per-symbol documents for a front end, and table extraction from web pages."""

from __future__ import annotations

import functools
import sys
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import listing_symbol, symbol_key
from panelspark.operators.asof import latest_per_key


# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def latest_rows(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Last row per wanted symbol."""
    wanted = symbols.select("symbol").distinct()
    return latest_per_key(df.join(wanted, "symbol", "left_semi"))


def price_history(df: DataFrame, symbols: DataFrame, rows: int | None) -> DataFrame:
    """The last ``rows`` bars (None: all) of each wanted symbol as one ordered array; a symbol has one bar a day at most."""
    wanted = symbols.select("symbol").distinct()
    recent = df.join(wanted, "symbol", "left_semi")
    if rows is not None:
        order = Window.partitionBy("symbol").orderBy(F.desc("date"))
        recent = recent.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= rows).drop("__n")
    bars = F.sort_array(F.collect_list(F.struct("date", *[c for c in df.columns if c not in ("symbol", "date")])))
    return recent.groupBy("symbol").agg(bars.alias("prices"))


def merge_prices(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """All bars from two sources; the primary wins on equal dates."""
    names = [c for c in primary.columns if c not in ("symbol", "date")]
    side = lambda df, p: df.select("symbol", "date", F.struct(*names).alias(p))
    both = side(primary, "__a").join(side(fallback, "__b"), ["symbol", "date"], "full_outer")
    row = F.coalesce("__a", "__b")
    return both.select("symbol", "date", *[row[c].alias(c) for c in names])


def merge_records(primary: DataFrame, fallback: DataFrame, key: str = "symbol") -> DataFrame:
    """Key-wise override: the primary row replaces the fallback row as a whole."""
    extra = fallback.join(primary.select(key), key, "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)


def stock_documents(symbols: DataFrame, profiles: list[DataFrame], prices: DataFrame, history_rows: int | None, **sections: DataFrame) -> DataFrame:
    """One JSON document per symbol: profile (first source that has it), the last ``history_rows`` bars (None: all) and named sections.

    Of several section rows of a symbol the smallest is taken.
    """
    out = symbols.select(symbol_key("symbol").alias("symbol")).distinct()
    profile = functools.reduce(merge_records, profiles)
    parts = {"profile": profile, **sections}
    for name, table in parts.items():
        fields = [c for c in table.columns if c != "symbol"]
        one = table.groupBy("symbol").agg(F.min(F.struct(*fields)).alias(name))
        out = out.join(one, "symbol", "left")
    out = out.join(price_history(prices, symbols, history_rows), "symbol", "left")
    return out.select("symbol", F.to_json(F.struct(*parts, "prices")).alias("document"))


class _Tables(HTMLParser):
    """Collects the cell texts of every table row."""

    def __init__(self):
        super().__init__()
        self.tables, self.stack, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.stack.append(len(self.tables) - 1)
        elif tag == "tr" and self.stack:
            self.tables[self.stack[-1]].append([])
        elif tag in ("td", "th") and self.stack and self.tables[self.stack[-1]]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[self.stack[-1]][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.stack:
            self.stack.pop()


@F.udtf(returnType="table_ix int, row_ix int, cells array<string>")
class HtmlTableRows:
    """Rows of all tables of one page."""

    def eval(self, html: str):
        if not html or "<table" not in html.lower():
            return
        reader = _Tables()
        reader.feed(html)
        for t, rows in enumerate(reader.tables):
            for r, cells in enumerate(rows):
                yield t, r, cells


def html_table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table_ix, row_ix, cells) of every table row of a page table.

    Pages without a table are filtered before they reach Python.
    """
    spark = pages.sparkSession
    spark.udtf.register("html_table_rows", HtmlTableRows)
    pages.filter(F.lower("html").contains("<table")).createOrReplaceTempView("__pages_with_tables")
    return spark.sql(
        "SELECT p.page_id, t.table_ix, t.row_ix, t.cells FROM __pages_with_tables p, LATERAL html_table_rows(p.html) t")


CONSTITUENT_HEADER = {"symbol": "Symbol", "name": "Security", "sector": "GICS Sector", "industry": "GICS Sub-Industry"}


def constituents(rows: DataFrame, category: str = "sp500", note: str = "Generated from S&P 500 constituents source") -> DataFrame:
    """Universe rows from the first table of each page whose header has the four required columns."""
    header = rows.filter("row_ix = 0").select("page_id", "table_ix", F.col("cells").alias("__head"))
    at = {name: F.array_position("__head", text) for name, text in CONSTITUENT_HEADER.items()}
    header = header.withColumns({f"__{n}": p for n, p in at.items()})
    header = header.filter(" and ".join(f"`__{n}` > 0" for n in CONSTITUENT_HEADER))
    body = rows.filter("row_ix > 0").join(header, ["page_id", "table_ix"]).filter(F.size("cells") >= F.size("__head"))
    pick = {n: F.trim(F.element_at("cells", F.col(f"__{n}").cast("int"))) for n in CONSTITUENT_HEADER}
    body = body.withColumns({**pick, "symbol": listing_symbol(pick["symbol"])}).filter("symbol <> ''")
    # the first qualifying table with rows wins
    first = body.groupBy("page_id").agg(F.min("table_ix").alias("table_ix"))
    body = body.join(first, ["page_id", "table_ix"], "left_semi")
    return body.select("page_id", "row_ix", "symbol", "name", F.lit(category).alias("category"), "sector", "industry", F.lit(note).alias("notes"))
