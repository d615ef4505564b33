"""Readers of raw market files into typed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.panel import keep_last, melt, merge_priority

#: Eras by their letter, with their first and last days.
ERAS = {"M": ("1868-01-25", "1912-07-29"), "T": ("1912-07-30", "1926-12-24"), "S": ("1926-12-25", "1989-01-07"), "H": ("1989-01-08", "2019-04-30"), "R": ("2019-05-01", "9999-12-31")}
#: Tenors by their column where the header can't be read.
TENORS = [f"{n}年" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 30, 40)]


def era_date(text: Column) -> Column:
    """``R8.7.31`` as a date; null unless it is a day of that era."""
    pattern = r"^\s*([MTSHR])(\d{1,2})\.(\d{1,2})\.(\d{1,2})\s*$"
    era, y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3, 4))
    out = F.lit(None).cast("date")
    for letter, (first, last) in ERAS.items():
        year = y.try_cast("int") + int(first[:4]) - 1
        day = F.try_make_date(year, m.try_cast("int"), d.try_cast("int")) if hasattr(F, "try_make_date") else F.try_to_timestamp(
            F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")
        ).cast("date")
        good = (era == letter) & (y.try_cast("int") >= 1) & (day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date"))
        out = F.when(good, day).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A number with thousands separators and marks for missing values."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def _lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """Lines of files in any Java character set, decoded where they are read."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = raw.mapInPandas(
        lambda pages: (p.assign(line=p["content"].map(lambda b: bytes(b).decode(charset).splitlines()))[["path", "line"]] for p in pages),
        "path string, line array<string>",
    )
    return text.select("path", F.posexplode("line").alias("n", "line"))


def read_fx_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide daily rates: header padding, byte-order mark and markers of missing
    values go; of repeated dates the last row counts.  Long, as ``EUR...``."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    names = [c for c in raw.columns if c and c != "Date" and not c.startswith("_c")]
    wide = raw.select(F.try_to_timestamp(F.trim("Date"), F.lit("yyyy-MM-dd")).cast("date").alias("ds"), *[number(F.col(c)).alias(c) for c in names], F.monotonically_increasing_id().alias("_at"))
    wide = keep_last(wide.where(F.col("ds").isNotNull()), ["ds"], [F.col("_at")]).drop("_at")
    return melt(wide, "ds", names, "EUR")


def read_bond_csv(spark: SparkSession, path: str) -> DataFrame:
    """Yields by era date in code page 932, as ``JGB_2Y`` and so on; lines that
    don't begin with an era date aren't data."""
    cells = F.split("line", ",")
    lines = _lines(spark, path, "cp932").withColumn("c", cells)
    heads = lines.where(F.exists("c", lambda x: F.trim(x).rlike(r"^\d+年$"))).groupBy("path").agg(F.max_by("c", "n").alias("head"))
    fixed = F.array(*map(F.lit, ["", *TENORS]))
    rows = lines.withColumn("ds", era_date(F.element_at("c", 1))).where(F.col("ds").isNotNull()).join(heads, "path", "left")
    each = F.explode(F.arrays_zip(F.coalesce("head", fixed).alias("t"), F.col("c").alias("v")))
    long = rows.select("ds", each.alias("x")).select("ds", F.trim(F.col("x")[F.lit("t")]).alias("t"), number(F.col("x")[F.lit("v")]).alias("y"))
    return long.where(F.col("t").rlike(r"^\d+年$") & F.col("y").isNotNull()).select(F.concat(F.lit("JGB_"), F.regexp_replace("t", "年", "Y")).alias("unique_id"), "ds", "y")


def read_bonds(spark: SparkSession, history: str, current: str) -> DataFrame:
    return merge_priority(read_bond_csv(spark, history), read_bond_csv(spark, current))


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily index rows in code page 932: date, close, open, high, low; the
    footer and anything without a date go."""
    c = F.split(F.regexp_replace("line", r'"\s*,\s*"', '";"'), '[;]')
    quoted = F.when(F.col("line").contains('";"') | F.col("line").rlike(r'"\s*,\s*"'), c).otherwise(F.split("line", ","))
    rows = _lines(spark, path, "cp932").withColumn("c", F.transform(quoted, lambda x: F.regexp_replace(F.trim(x), '"', "")))
    day = F.try_to_timestamp(F.regexp_replace(F.element_at("c", 1), "/", "-"), F.lit("yyyy-M-d")).cast("date")
    pick = [number(F.try_element_at("c", F.lit(k))).alias(n) for n, k in (("open", 3), ("high", 4), ("low", 5), ("close", 2))]
    return rows.select(day.alias("ds"), *pick).where(F.col("ds").isNotNull() & F.col("close").isNotNull())


def _tuples(json: Column, names: list[str]) -> Column:
    rows = F.from_json(json, "array<array<double>>")
    return F.explode(F.transform(rows, lambda r: F.struct(*[F.element_at(r, k + 1).alias(n) for k, n in enumerate(names)])))


def _without_conflicts(rows: DataFrame, key: str) -> DataFrame:
    """Identical repeats collapse; rows that differ under one key raise."""
    value = F.struct(*rows.columns)
    g = rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.first(value).alias("r"))
    return g.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting rows at "), F.col(key).cast("string")))).otherwise(F.lit(None)).alias("_e"), "r.*").where(F.col("_e").isNull()).drop("_e")


CANDLE = ["epoch", "low", "high", "open", "close", "volume"]


def parse_candles(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Candle tuples in JSON as typed rows, one per epoch."""
    rows = pages.select(_tuples(F.col(column), CANDLE).alias("c")).select("c.*").withColumn("epoch", F.col("epoch").cast("long"))
    return _without_conflicts(rows, "epoch")


def parse_volatility_index(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Index tuples in JSON (milliseconds, open, high, low, close)."""
    rows = pages.select(_tuples(F.col(column), ["timestamp_ms", "open", "high", "low", "close"]).alias("c")).select("c.*")
    return _without_conflicts(rows.withColumn("timestamp_ms", F.col("timestamp_ms").cast("long")), "timestamp_ms")


def daily_candles(candles: DataFrame) -> DataFrame:
    """The last candle of each UTC day."""
    day = F.to_date(F.timestamp_seconds("epoch"))
    return candles.groupBy(day.alias("ds")).agg(F.max_by(F.struct(*candles.columns), "epoch").alias("r")).select("ds", "r.*")


class _Page(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def paged_source(name: str, fetch: Callable[[int, int], list[tuple]], schema: str, start: int, stop: int, step: int, per_page: int = 300) -> type[DataSource]:
    """A data source that reads ``[start, stop)`` page by page, a partition for
    each page; ``fetch(a, b)`` returns a page's rows, and is tried again on
    ``OSError`` up to five times."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[_Page]:
            size = step * per_page
            return [_Page(a, min(a + size, stop)) for a in range(start, stop, size)]

        def read(self, page: _Page) -> Iterator[tuple]:
            for attempt in range(5):
                try:
                    return iter(fetch(page.start, page.stop))
                except OSError:
                    if attempt == 4:
                        raise
            return iter(())

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader()

    return Source


def continued(fetch: Callable[[int], tuple[list, int | None]], end: int) -> list:
    """Pages from the newest back: each names the end of the next older one;
    one that doesn't go back raises."""
    rows: list = []
    while True:
        page, older = fetch(end)
        rows += page
        if older is None:
            return rows
        if older >= end:
            raise ValueError("the continuation doesn't go back")
        end = older


def new_rows(fetched: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What an incremental fetch adds to the cache."""
    return fetched.join(cached.select(*keys), keys, "left_anti")
