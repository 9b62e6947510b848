"""Progress-event frames and request status (X13-X15, T3, T4) as column jobs.

A progress stream is a table of text chunks per request.  Decoding splits each
chunk into lines, keeps ``data: `` lines and parses the JSON after the prefix,
all with built-in functions; the latest status is a ``max_by`` aggregate and the
running reply length a running-sum window ordered by sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import col_

FRAME_PREFIX = "data: "
EVENT_SCHEMA = ("status STRING, message STRING, partial BIGINT, data STRING, error STRING, "
                "request_id BIGINT, seq BIGINT")

# UI progress texts per status.
TEXT_CONNECTING = "Connecting to AI..."
TEXT_GENERATING = "Generating marketing content..."
TEXT_PROCESSING = "Processing response..."


def frame(payload: Column) -> Column:
    """Server side framing of one JSON event: ``data: {…}`` + blank line."""
    return F.concat(F.lit(FRAME_PREFIX), payload, F.lit("\n\n"))


def decode_frames(chunks: DataFrame, chunk_col: str = "chunk", keep: Sequence[str] = ()) -> DataFrame:
    """One row per ``data:`` line of every chunk, JSON fields as columns.

    Lines are numbered within their chunk (``line_no``) so order is kept.
    Lines that are not valid JSON give null fields (the UI skips them).
    """
    lines = chunks.select(*keep, F.posexplode(F.split(F.col(chunk_col), "\n")).alias("line_no", "line"))
    data = lines.filter(F.col("line").startswith(FRAME_PREFIX))
    parsed = F.from_json(F.substring(F.col("line"), len(FRAME_PREFIX) + 1, 1 << 30), EVENT_SCHEMA)
    return data.select(*keep, "line_no", parsed.alias("e")).select(*keep, "line_no", "e.*")


def progress_text(status, partial, error) -> Column:
    """The UI line for an event; an error event shows its error text."""
    s = col_(status)
    return (F.when(col_(error).isNotNull(), col_(error))
            .when(s == "connecting", F.lit(TEXT_CONNECTING))
            .when(s == "generating", F.lit(TEXT_GENERATING))
            .when(s == "streaming", F.concat(F.lit("Generating content... ("),
                                             col_(partial).cast("string"), F.lit(" chars)")))
            .when(s == "processing", F.lit(TEXT_PROCESSING))
            .when(s == "complete", F.lit("")))


def latest_status(events: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                  value_cols: Sequence[str]) -> DataFrame:
    """The last event of every request (``max_by`` on the sequence)."""
    order = F.struct(*[F.col(c) for c in order_cols])
    last = F.max_by(F.struct(*[F.col(c) for c in value_cols]), order).alias("last")
    return events.groupBy(*key_cols).agg(last, F.count(F.lit(1)).alias("n_events")) \
        .select(*key_cols, "n_events", "last.*")


def running_length(chunks: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                   text_col: str = "text") -> DataFrame:
    """T4: cumulative reply length after every chunk (the ``partial`` count).

    The window is a running frame over one request's chunks, evaluated in one
    sorted pass; its size is the number of chunks of one reply.
    """
    w = Window.partitionBy(*key_cols).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("partial", F.sum(F.length(text_col).cast("bigint")).over(w))


# Error classes and their user messages (three variants).
ERR_AUTH = "Invalid OpenAI API key. Please check your API key and try again."
ERR_RATE = "Rate limit exceeded. Please wait a moment and try again."
ERR_CONN = "Cannot connect to OpenAI. Please check your internet connection."
ERR_AUTH_PLAIN = "Invalid OpenAI API key. Please check your API key."
ERR_AUTH_SERVER = "Invalid OpenAI API key. Please check the server configuration."
ERR_RATE_SERVER = "Rate limit exceeded. Please wait and try again."
ERR_MODEL_SERVER = "Model not found. Please check the model name."


def error_class(message, model, variant: str = "stream") -> Column:
    """Classify an error text; returns ``struct(error_class, user_message)``.

    ``stream``: auth / rate limit / model not found / connection / other.
    ``plain`` (non-stream): no connection class; only ``rate_limit`` spelled with
    an underscore.  ``server``: fixed model message, no ``invalid_api_key`` word.
    """
    m = F.lower(col_(message))
    mdl = col_(model)

    def res(cls: str, msg: Column) -> Column:
        return F.struct(F.lit(cls).alias("error_class"), msg.alias("user_message"))

    other = res("other", F.concat(F.lit("Error: "), col_(message)))
    if variant == "stream":
        return (F.when(m.contains("authentication") | m.contains("api key") | m.contains("invalid_api_key"),
                       res("authentication", F.lit(ERR_AUTH)))
                .when(m.contains("rate_limit") | m.contains("rate limit"), res("rate_limit", F.lit(ERR_RATE)))
                .when(m.contains("model") & (m.contains("not found") | m.contains("does not exist")),
                      res("model_not_found", F.concat(F.lit("Model '"), mdl,
                                                      F.lit("' not found. Please check the model name."))))
                .when(m.contains("connection"), res("connection", F.lit(ERR_CONN)))
                .otherwise(other))
    if variant == "plain":
        return (F.when(m.contains("authentication") | m.contains("api key"),
                       res("authentication", F.lit(ERR_AUTH_PLAIN)))
                .when(m.contains("rate_limit"), res("rate_limit", F.lit(ERR_RATE)))
                .when(m.contains("model") & m.contains("not found"),
                      res("model_not_found", F.concat(F.lit("Model '"), mdl,
                                                      F.lit("' not found. Please use a valid model name."))))
                .otherwise(other))
    if variant == "server":
        return (F.when(m.contains("authentication") | m.contains("api key"),
                       res("authentication", F.lit(ERR_AUTH_SERVER)))
                .when(m.contains("rate_limit"), res("rate_limit", F.lit(ERR_RATE_SERVER)))
                .when(m.contains("model") & m.contains("not found"),
                      res("model_not_found", F.lit(ERR_MODEL_SERVER)))
                .when(m.contains("connection"), res("connection", F.lit(ERR_CONN)))
                .otherwise(other))
    raise ValueError(f"unknown variant {variant}")
