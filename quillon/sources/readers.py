"""Readers: exports, logs, checklists, sheets and uploads; adapters by name."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import cleaning
from quillon.operators.features import require_columns

#: Columns of a point-of-sale export that are kept (fixed values).
EXPORT_COLUMNS = ("Date", "Time", "Category", "Item", "Price Point Name", "Qty", "Net Sales", "Gross Sales", "Discounts", "Tax", "Transaction ID", "Location", "Channel")
#: Upload formats by extension, and how each is read; Office and PDF files are taken as bytes, for their decoding is not Spark's.
FORMATS = {"txt": "text", "md": "text", "csv": "csv", "pdf": "binary", "docx": "binary", "xlsx": "binary", "pptx": "binary", "jpeg": "binary", "jpg": "binary", "png": "binary", "webp": "binary"}


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-16 tab-separated export without quoting, all text; its columns are a contract."""
    raw = spark.read.options(sep="\t", encoding="UTF-16", quote="", header=True, mode="PERMISSIVE").csv(path)
    return require_columns(raw, list(EXPORT_COLUMNS))


def normalise_export(raw: DataFrame, venues: dict[str, str], *, vat_inclusive: tuple[str, ...] = (), excluded: tuple[str, ...] = (), zone: str = "Europe/London") -> DataFrame:
    """Tidy line items of an export, with drop_reason where a row can't be used: no known venue or no date."""
    c, text = F.col, cleaning.clean_string
    venue = cleaning.canonical_venue(c("Location"), venues)
    ts = cleaning.parse_when(c("Date"), c("Time"), zone)
    money = {new: cleaning.parse_currency(c(old)) for new, old in (("net_sales", "Net Sales"), ("gross_sales", "Gross Sales"), ("discounts", "Discounts"), ("tax", "Tax"))}
    named = {new: text(c(old)) for new, old in (("transaction_id", "Transaction ID"), ("category", "Category"), ("item", "Item"), ("price_point", "Price Point Name"), ("channel", "Channel"))}
    out = raw.select(*(v.alias(k) for k, v in named.items()), venue.alias("venue"), text(c("Location")).alias("venue_label"), c("Qty").try_cast("double").alias("qty"), *(v.alias(k) for k, v in money.items()), ts.alias("ts"), F.to_date(F.from_utc_timestamp(ts, zone)).alias("date"))
    out = out.withColumns({"net_sales_exvat": cleaning.without_vat(c("net_sales"), c("venue"), vat_inclusive), "excluded": F.coalesce(c("venue").isin(*excluded), F.lit(False)) if excluded else F.lit(False)})
    return out.withColumn("drop_reason", F.when(c("venue").isNull(), "unknown venue").when(c("date").isNull(), "no date"))


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "conversationId string, role string, content string, channel string, messageCreatedAt timestamp"
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def carry_header(lines: DataFrame, header: Column, order: list[str], keys: list[str]) -> DataFrame:
    """lines with `section`: the last header at or before each line of its file."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(w))


def parse_checklist(lines: DataFrame) -> DataFrame:
    """(file, section, number, text, weight, sunday_only, is_signoff) of numbered lines under markdown headings; lines: (file, line_no, line)."""
    header = F.nullif(F.regexp_extract("line", r"^#+\s*(.+?)\s*$", 1), F.lit(""))
    step = carry_header(lines, header, ["line_no"], ["file"]).withColumn("m", F.regexp_extract("line", r"^\s*(\d+)[.)]\s+(.+?)\s*$", 1)).where("m <> ''")
    text = F.regexp_extract("line", r"^\s*\d+[.)]\s+(.+?)\s*$", 1)
    return step.select("file", "section", F.col("m").cast("int").alias("number"), text.alias("text"), cleaning.criticality(text).alias("weight"), F.lower(text).contains("sunday").alias("sunday_only"), F.lower(text).rlike("sign(ed)?[ -]?off|signature|initial").alias("is_signoff"))


def parse_stock_sheet(cells: DataFrame) -> DataFrame:
    """(file, l1, l2, product, canon, qty, unit_price) of a sheet's rows (file, row_no, a, qty, unit_price).

    A row in capitals without numbers opens a first-level section, another without numbers a second-level one; rows that begin with
    "Total" are footers. A product that comes twice in a section is one: its amounts are added, its price is the median.
    """
    bare = F.col("qty").isNull() & F.col("unit_price").isNull() & F.col("a").isNotNull()
    first = F.when(bare & (F.upper("a") == F.col("a")), F.col("a"))
    w = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    l1 = cells.withColumn("l1", F.last(first, ignorenulls=True).over(w))
    second = Window.partitionBy("file", "l1").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    l2 = l1.withColumn("l2", F.last(F.when(bare & first.isNull(), F.col("a")), ignorenulls=True).over(second))
    rows = l2.where(~bare & F.col("a").isNotNull() & ~F.lower("a").startswith("total"))
    return rows.groupBy("file", "l1", "l2", cleaning.canonical_product(F.col("a")).alias("canon")).agg(F.min_by("a", "row_no").alias("product"), F.sum("qty").alias("qty"), F.percentile("unit_price", F.lit(0.5)).alias("unit_price"))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded file by its extension: (path, text), a table of text cells, or (path, length, content)."""
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unsupported format: {path}")
    if kind == "csv":
        return spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_optional(spark: SparkSession, name: str, schema: str | T.StructType) -> DataFrame:
    """A table of the catalog; an empty one of the schema where it doesn't exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


class SourceAdapter(ABC):
    """Where transactions and stock come from."""

    def __init__(self, spark: SparkSession, **options):
        self.spark, self.options = spark, options

    @abstractmethod
    def transactions(self, since: str | None = None) -> DataFrame:
        """Line items after a date, or all."""

    def stock(self, since: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([], "snapshot_date date, product string, qty double")

    def latest_date(self) -> str | None:
        return self.transactions().agg(F.max("date").cast("string")).first()[0]


class ParquetAdapter(SourceAdapter):
    def transactions(self, since: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.options["path"])
        return rows if since is None else rows.where(F.col("date") > F.lit(since).cast("date"))


class ExportAdapter(SourceAdapter):
    """Options: path; venues, slugs by name (without them no row has a known venue); vat_inclusive and excluded, slugs; zone."""

    def transactions(self, since: str | None = None) -> DataFrame:
        more = {k: self.options[k] for k in ("vat_inclusive", "excluded", "zone") if k in self.options}
        rows = normalise_export(read_export(self.spark, self.options["path"]), self.options["venues"], **more).where("drop_reason is null").drop("drop_reason")
        return rows if since is None else rows.where(F.col("date") > F.lit(since).cast("date"))


ADAPTERS: dict[str, type[SourceAdapter]] = {"parquet": ParquetAdapter, "export": ExportAdapter}


def adapter(name: str, spark: SparkSession, **options) -> SourceAdapter:
    if name not in ADAPTERS:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name](spark, **options)
