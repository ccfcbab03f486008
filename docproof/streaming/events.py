"""Event-time windows, stateful rate control and the request loop, as Structured Streaming; each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def token_bucket(events: DataFrame, key: str, capacity: int, seconds: int = 60) -> DataFrame:
    """Admits an event if fewer than `capacity` were admitted for its key in the last `seconds`, else refuses it;
    the state holds the admitted times only."""
    width = pd.Timedelta(seconds=seconds)
    schema = f"{key} long, event_id long, ts timestamp, admitted boolean"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        kept = [pd.Timestamp(t, unit="us") for t in kept]
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            kept = [t for t in kept if r.ts - t < width]
            fits = len(kept) < capacity
            if fits:
                kept.append(r.ts)
            out.append((k[0], r.event_id, r.ts, fits))
        state.update(([int(t.value // 1000) for t in kept],))
        yield pd.DataFrame(out, columns=[key, "event_id", "ts", "admitted"])

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(run, schema, "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def responses(requests: DataFrame, *keep: str) -> DataFrame:
    """JSON-RPC lines in `value` to reply lines, with columns to keep; notifications get none, malformed lines an error, never a verdict."""
    got = F.from_json("value", "jsonrpc string, id string, method string, params struct<name:string,arguments:struct<text:string,path:string,offline:boolean>>")
    rows = requests.select("value", *keep, got.alias("r"))
    malformed = F.col("r").isNull() | F.col("r.method").isNull()
    known = F.col("r.method").isin("initialize", "tools/list", "tools/call", "ping")
    result = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("r.id").alias("id"), F.struct(F.col("r.method").alias("method"), F.length("r.params.arguments.text").alias("n_chars")).alias("result")))

    def error(code: int, text: str):
        return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("r.id").alias("id"), F.struct(F.lit(code).alias("code"), F.lit(text).alias("message")).alias("error")))

    reply = F.when(malformed, error(-32700, "parse error")).when(~known, error(-32601, "unknown method")).otherwise(result)
    return rows.where(malformed | F.col("r.id").isNotNull()).select(reply.alias("value"), *keep)


def serve(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Reads request lines from files as they arrive and writes reply lines; resumes from its checkpoint."""
    lines = spark.readStream.text(source)
    return responses(lines).writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
