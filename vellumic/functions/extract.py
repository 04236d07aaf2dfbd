"""Fields out of document text and tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_values(text: Column) -> Column:
    """``Key: value`` lines as a map with small-letter keys; the last of equal keys counts."""
    rows = F.transform(F.split(text, "\n"), lambda s: F.struct(F.lower(F.trim(F.regexp_extract(s, r"^\s*([A-Za-z][\w /.()-]*?)\s*:\s*(.+)$", 1))).alias("k"), F.trim(F.regexp_extract(s, r"^\s*([A-Za-z][\w /.()-]*?)\s*:\s*(.+)$", 2)).alias("v")))
    rows = F.filter(rows, lambda r: r.k != "")
    last = F.transform(F.array_distinct(F.transform(rows, lambda r: r.k)), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(rows, lambda r: r.k == k), -1)["v"].alias("v")))
    return F.map_from_entries(last)


def lab_value(text: Column) -> Column:
    """A range ``a - b``, a number, or text."""
    span, number = r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$", r"^\s*-?\d+(?:\.\d+)?\s*$"
    num = lambda c: c.try_cast("double")
    kind = F.when(text.rlike(span), "range").when(text.rlike(number), "number").otherwise("text")
    return F.struct(
        kind.alias("kind"), F.when(kind == "range", num(F.regexp_extract(text, span, 1))).when(kind == "number", num(F.trim(text))).alias("low"),
        F.when(kind == "range", num(F.regexp_extract(text, span, 2))).when(kind == "number", num(F.trim(text))).alias("high"), F.when(kind == "text", F.trim(text)).alias("text"),
    )


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


#: What the fields of an invoice and of an application look like, and what counts as a key.
INVOICE_NUMBER = r"(?i)invoice\s*(?:no|number)?\s*[:#]?\s*([A-Z0-9-]+)"
INVOICE_TOTAL = r"(?i)total\s*[:$]?\s*([\d,]+\.\d{2})"
FORM_DATE = r"\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2}"
APPLICANT = r"(?i)name\s*:\s*([A-Za-z\s]+)"
SIGNATURE = r"(?i)signature"
KEY = r"[A-Z][a-z]+:"


def invoice_fields(text: Column) -> Column:
    return F.struct(_first(text, INVOICE_NUMBER).alias("number"), _first(text, INVOICE_TOTAL).alias("total"), _first(text, FORM_DATE, 0).alias("date"))


def application_fields(text: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(text, APPLICANT, 1), r"^\s+|\s+$", "")
    return F.struct(F.nullif(name, F.lit("")).alias("name"), text.rlike(SIGNATURE).alias("has_signature"), _first(text, FORM_DATE, 0).alias("date"))


def text_facts(text: Column, preview: int = 100) -> Column:
    """What is told of a text of no known kind: its keys, its length, and how it begins."""
    return F.struct(F.regexp_count(text, F.lit(KEY)).alias("keys_found"), F.length(text).alias("document_length"), F.concat(F.substring(text, 1, preview), F.lit("...")).alias("preview"))


#: A salutation before a name, and an age with its unit and the sex.
SALUTATION = r"(?i)^(Mr|Mrs|Ms|Miss|Dr)\.?\s+(.+)$"
AGE_SEX = r"(?i)^(\d+)\s*([YMD])\s*/\s*([MF])$"


def age_sex(text: Column) -> Column:
    """``34 Y / F`` and the like; all null for anything else."""
    part = lambda n: _first(text, AGE_SEX, n)
    return F.struct(part(1).try_cast("int").alias("age"), F.upper(part(2)).alias("unit"), F.upper(part(3)).alias("sex"))


def person(text: Column) -> Column:
    """Salutation and name; a text without a salutation is a name as a whole."""
    title = _first(text, SALUTATION, 1)
    return F.struct(F.concat(title, F.lit(".")).alias("salutation"), F.when(title.isNotNull(), _first(text, SALUTATION, 2)).otherwise(text).alias("name"))


class _Table(HTMLParser):
    """Rows of the first table: cells with text and spans; scripts and styles are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None
        self.skip = self.tables = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        self.tables += tag == "table"
        self.skip += tag in ("script", "style")
        if self.tables != 1:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            span = lambda k: min(100, max(1, int(given.get(k) or 1))) if (given.get(k) or "1").strip().isdigit() else 1
            self.cell = {"text": "", "header": tag == "th", "rowspan": span("rowspan"), "colspan": span("colspan")}
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag == "table":
            self.tables += 1 if self.tables == 1 else 0
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.skip:
            self.cell["text"] += data


def table_rows(html: str | None) -> list[list[dict]] | None:
    if html is None:
        return None
    parser = _Table()
    parser.feed(html)
    parser.close()
    for row in parser.rows:
        for cell in row:
            cell["text"] = " ".join(cell["text"].split())
    return [r for r in parser.rows if r]


CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("header", T.BooleanType()), T.StructField("rowspan", T.IntegerType()), T.StructField("colspan", T.IntegerType())])


@F.pandas_udf(T.ArrayType(T.ArrayType(CELL)))
def html_table(html: pd.Series) -> pd.Series:
    return html.map(table_rows)


def laid_out(rows: list[list[dict]] | None) -> list[dict] | None:
    """Each cell with the row and column where it begins, when those before it take the room that their spans say."""
    if rows is None:
        return None
    out, taken = [], set()
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            out.append({"row": r, "column": c, **cell})
            taken |= {(r + i, c + j) for i in range(cell["rowspan"]) for j in range(cell["colspan"])}
            c += cell["colspan"]
    return out


PLACED = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType()), *CELL.fields])


@F.pandas_udf(T.ArrayType(PLACED))
def html_grid(html: pd.Series) -> pd.Series:
    return html.map(lambda x: laid_out(table_rows(x)))


def lab_rows(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a results table (name, value, unit, range) with their section: a row with a name only begins one."""
    other = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.nullif(F.trim("unit"), F.lit("")), F.nullif(F.trim("range"), F.lit("")))
    heads = (F.trim("name") != "") & other.isNull()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumns({"is_section": heads, "section": F.last(F.when(heads, F.trim("name")), ignorenulls=True).over(w)}).where(~F.col("is_section")).drop("is_section")


def lab_report(rows: DataFrame, keys: list[str], confidence: str | None = None) -> DataFrame:
    """One report per key: results in order, and what is doubtful about it."""
    item = F.struct("ord", "section", "name", lab_value(F.col("value")).alias("value"), "unit", "range")
    bare = F.count_if((F.coalesce(F.trim("unit"), F.lit("")) != "") | (F.coalesce(F.trim("range"), F.lit("")) != "")) == 0
    weak = F.min(confidence) < 0.5 if confidence else F.lit(False)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("results"), F.array_compact(F.array(F.when(F.count("name") == 0, "NO_TABLE"), F.when(weak, "LOW_CONFIDENCE"), F.when(bare, "NO_UNITS_OR_RANGES"))).alias("warnings"))
