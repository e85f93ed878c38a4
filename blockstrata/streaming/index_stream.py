"""Streaming forms: the index as keyed state, time-outs of pending requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ANSWER = "seq long, key long, op string, found boolean, old_metadata double"


def answers(requests: DataFrame) -> DataFrame:
    """Each request of a stream (seq, key, op, metadata) answered as the batch form answers it.

    State is one present flag and one value a key; requests of one key must come in order of seq.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        present, value = state.get if state.exists else (False, None)
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        out = []
        for seq, op, new in zip(rows["seq"], rows["op"], rows["metadata"], strict=True):
            out.append((int(seq), key[0], op, bool(present), value if present else None))
            if op == "DELETE":
                present, value = False, None
            elif op == "UPDATE" or op == "POST" and not present:
                present, value = True, None if pd.isna(new) else float(new)
        state.update((present, value))
        yield pd.DataFrame(out, columns=["seq", "key", "op", "found", "old_metadata"])

    return requests.groupBy("key").applyInPandasWithState(step, _ANSWER, "present boolean, value double", "append", "NoTimeout")


def timeouts(requests: DataFrame, answers_: DataFrame, seconds: int = 5) -> DataFrame:
    """Requests without an answer within ``seconds``: a stream-stream left join on event time.

    A row comes out once the watermark has passed its deadline, so state holds only pending requests.
    """
    r = requests.withWatermark("request_ts", f"{seconds} seconds").alias("r")
    a = answers_.withWatermark("response_ts", f"{seconds} seconds").alias("a")
    on = (F.col("r.key") == F.col("a.key")) & (F.col("a.response_ts") >= F.col("r.request_ts")) & (F.col("a.response_ts") <= F.col("r.request_ts") + F.expr(f"interval {seconds} seconds"))
    return r.join(a, on, "left").filter(F.col("a.key").isNull()).select("r.key", "r.request_ts")


def first_copies(blocks: DataFrame) -> DataFrame:
    """Whether each block of a stream (name, seq) is new or a duplicate.

    State is one flag for every name ever seen, without a bound, since a name may come
    again at any time; ``recent_copies`` forgets names instead.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("seq", kind="stable")
        seen = state.exists
        state.update((True,))
        yield pd.DataFrame({"name": rows["name"].to_numpy(), "seq": rows["seq"].to_numpy(), "is_duplicate": [seen or k > 0 for k in range(len(rows))]})

    return blocks.groupBy("name").applyInPandasWithState(step, "name string, seq long, is_duplicate boolean", "seen boolean", "append", "NoTimeout")


def recent_copies(blocks: DataFrame, ts: str, keep: str = "1 hour") -> DataFrame:
    """The blocks of a stream (name and event time ``ts``) whose name did not come within ``keep`` before; names older than the watermark are forgotten."""
    return blocks.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["name"])


def chapter_sink(records: DataFrame, path: str, checkpoint: str):
    """A writer that appends closed chapters in micro-batches, one folder a chapter; running a batch again replaces its chapters."""
    from blockstrata.sources.chapters import write_chapters

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_chapters(df, path))
