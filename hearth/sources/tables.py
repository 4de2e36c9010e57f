"""CSV scans with column contracts, corpus and report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth import constants as C
from hearth.functions.text import missing_to_null, strip_blanks

DELIMITERS = [",", ";", "\t", "|"]
OVERFLOW = "_overflow"
CORRUPT = "_record"


class MissingColumns(ValueError):
    """The input lacks columns the job is defined on."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise MissingColumns(f"expected columns {', '.join(names)}; missing {', '.join(absent)}")
    return df


def _header_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    if row is None:
        raise MissingColumns(f"{path} is empty")
    return row[0].lstrip("﻿")


def sniff_delimiter(header: str) -> str:
    """The candidate that occurs most in the header; a comma wins ties."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def has_multiline_records(spark: SparkSession, path: str, escape: str = "\\") -> bool:
    """Does any line leave a quote open? Decides whether files may be split while reading.

    Escaped quotes do not count, so the answer follows the scan's own rules.
    """
    bare = F.col("value") if escape in ("", '"') else F.regexp_replace("value", rf"(?s)\Q{escape}\E.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def scan_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    escape: str = "\\",
    keep_bad: bool = False,
) -> DataFrame:
    """All-string scan of a headed CSV file of any common delimiter.

    Records with more fields than the header are dropped, shorter ones are
    filled with nulls, undecodable bytes are removed, and the usual spellings
    of a missing value become null. ``keep_bad`` returns the dropped records as
    ``_record`` instead. Files are split across tasks unless a record spans lines.
    """
    header = _header_line(spark, path)
    delimiter = sniff_delimiter(header)
    names = [
        n if n is not None else f"_c{i}"
        for i, n in enumerate(
            spark.range(1)
            .select(F.from_csv(F.lit(header), _string_schema(header.count(delimiter) + 1), {"sep": delimiter}).alias("h"))
            .select("h.*")
            .first()
        )
    ]
    if multi_line is None:
        multi_line = has_multiline_records(spark, path, escape)
    extra = [CORRUPT] if keep_bad else [OVERFLOW, CORRUPT]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *extra]])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", escape)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", True)
        .option("unescapedQuoteHandling", "STOP_AT_CLOSING_QUOTE")
        # a record is only compared with the header where all of it is parsed
        .option("columnPruning", not keep_bad)
        .csv(path)
    )
    if keep_bad:
        # short records are marked too: those with a field beyond the header are the dropped ones
        options = {"sep": delimiter, "quote": '"', "escape": escape, "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE"}
        beyond = F.from_csv(CORRUPT, _string_schema(len(names) + 1), options)[f"c{len(names)}"]
        record = F.coalesce(CORRUPT, f"`{names[0]}`")
        return rows.filter(F.col(CORRUPT).isNotNull() & beyond.isNotNull()).select(record.alias(CORRUPT))
    readable = rows.filter(F.col(OVERFLOW).isNull())
    return readable.select(
        *[missing_to_null(F.replace(F.col(f"`{n}`"), F.lit("�"), F.lit(""))).alias(n) for n in names]
    )


def _string_schema(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))


def union_splits(splits: list[DataFrame]) -> DataFrame:
    """Bag union by column name; a column a split lacks is null there."""
    out = splits[0]
    for other in splits[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def scan_corpus_splits(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Union of whichever of train, dev, valid and test exist in ``folder``."""
    splits = []
    for name in C.CORPUS_FILES:
        try:
            splits.append(scan_csv(spark, f"{folder.rstrip('/')}/{name}", **options))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not splits:
        raise FileNotFoundError(f"none of {', '.join(C.CORPUS_FILES)} in {folder}")
    return union_splits(splits)


def load_pairs(
    df: DataFrame,
    second: str = "response",
    limit: int | None = None,
    order_by: list[str] | None = None,
    lower: bool = False,
) -> DataFrame:
    """Trimmed, non-empty pairs of ``text`` and ``second``.

    Null cells go first, then the limit in ``order_by`` order, then pairs with an
    empty side; the order of these steps decides which rows a limit keeps.
    """
    require_columns(df, "text", second)
    rows = df.withColumns({c: missing_to_null(c) for c in ("text", second)}).dropna(subset=["text", second])
    if limit is not None and limit > 0:
        if not order_by:
            raise ValueError("a limit needs order_by columns to be repeatable")
        rows = rows.orderBy(*order_by).limit(limit)

    def tidy(name: str) -> Column:
        return strip_blanks(F.col(name))

    rows = rows.withColumn("text", tidy("text"))
    rows = rows.withColumn(second, F.lower(tidy(second)) if lower else tidy(second))
    return rows.filter((F.col("text") != "") & (F.col(second) != ""))


def load_emotion_pairs(df: DataFrame, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    return load_pairs(df, "reference_emotion", limit, order_by, lower=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV that reads back unchanged; ``path`` must be new."""
    (
        df.write.mode("error")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_written_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def metric_report(report: DataFrame) -> DataFrame:
    """One-row metric frame to ``(metric, value)`` rows, values as text."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in report.columns]
    )
    return report.select(F.inline(entries))
