"""Model replies to columns, and the summary message built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reply fallback and message texts.
NO_SUMMARY = "Brak dostępnych insightów AI"
REPLY_SCHEMA = "summary STRING, insights ARRAY<STRING>, recommendations ARRAY<STRING>"
MESSAGE_TITLE = "📊 *PODSUMOWANIE GODZINOWE* 📊\n\n"
MESSAGE_INSIGHTS = "🔍 *Najważniejsze spostrzeżenia:*\n"
MESSAGE_ADVICE = "\n💡 *Rekomendacje:*\n"
MESSAGE_TIME = "\n⏱️ *Wygenerowano:* "


def reply_json(reply: Column) -> Column:
    """The JSON text of a reply without a surrounding code fence."""
    text = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", "")
    fenced = F.regexp_replace(F.try_element_at(F.split(text, "```"), F.lit(2)), "^json", "")
    return F.regexp_replace(F.when(text.startswith("```"), fenced).otherwise(text), r"^\s+|\s+$", "")


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Append summary, insights, recommendations and whether the reply was readable."""
    body = reply_json(F.col(reply))
    readable = F.coalesce(body.startswith("{") & F.try_parse_json(body).isNotNull(), F.lit(False))
    parsed = df.withColumn("_json", F.when(readable, body)).withColumn("_reply", F.from_json("_json", REPLY_SCHEMA))
    none = F.array().cast("array<string>")
    return parsed.withColumns(
        {
            "readable": F.col("_json").isNotNull(),
            "summary": F.when(F.col("_json").isNull(), F.lit(NO_SUMMARY)).otherwise(F.col("_reply.summary")),
            "insights": F.when(F.col("_json").isNull(), none).otherwise(F.col("_reply.insights")),
            "recommendations": F.when(F.col("_json").isNull(), none).otherwise(F.col("_reply.recommendations")),
        }
    ).drop("_json", "_reply")


def _numbered(items: Column) -> Column:
    lines = F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item, F.lit("\n")),
    )
    return F.array_join(lines, "")


def summary_message(replies: DataFrame, generated_at: Column) -> DataFrame:
    """The hourly summary text of each parsed reply."""
    text = F.concat(
        F.lit(MESSAGE_TITLE), F.lit("*"), F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit("Brak podsumowania")),
        F.lit("*\n\n"), F.lit(MESSAGE_INSIGHTS), _numbered(F.col("insights")),
        F.lit(MESSAGE_ADVICE), _numbered(F.col("recommendations")),
        F.lit(MESSAGE_TIME), F.coalesce(generated_at.cast("string"), F.lit("przed chwilą")),
    )
    return replies.withColumn("message", text)
