"""Chat request and result records as JSON columns; batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.text import as_column, strip_blanks

# JSON values Python takes as false, as from_json writes them into a string map
FALSE_VALUES = ["false", "0", "0.0", "", "[]", "{}"]


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``message, use_filter, user_id, conversation_id, accepted`` read from a JSON body.

    A missing key takes its default and an explicit null does not. Bodies that
    are no JSON object, or have a blank message, are not accepted.
    """
    fields = F.from_json(F.col(body), "map<string,string>")
    df = df.withColumn("_fields", fields)

    def field(name: str, default: str) -> Column:
        known = F.coalesce(F.map_contains_key("_fields", F.lit(name)), F.lit(False))
        return F.when(known, F.element_at("_fields", F.lit(name))).otherwise(F.lit(default))

    flag = field("use_filter", "true")
    return (
        df.withColumn("message", F.coalesce(strip_blanks(field("message", "")), F.lit("")))
        .withColumn("use_filter", ~F.coalesce(flag.isin(FALSE_VALUES), F.lit(True)))
        .withColumn("user_id", field("user_id", C.DEFAULT_USER))
        .withColumn("conversation_id", field("conversation_id", ""))
        .withColumn("accepted", F.col("message") != "")
        .drop("_fields")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("accepted").drop("accepted")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("accepted")).drop("accepted")


def filter_applied(use_filter: Column | str, toxic: Column | str, scores: Column | str) -> Column:
    has_scores = F.coalesce(F.size(as_column(scores)), F.lit(0)) > 0
    return as_column(use_filter) & (as_column(toxic) | has_scores)


def result_json(df: DataFrame, fields: list[str] = C.RESULT_FIELDS) -> Column:
    """JSON text of a chat result; null fields are written out."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"result lacks {', '.join(missing)}")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
