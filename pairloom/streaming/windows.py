"""Streams: step windows, event-time windows, sessions, running discovery, and batches without repeated texts.

Step windows come from the step number, not from a clock. Sinks are idempotent: a micro-batch that is replayed replaces
what it wrote before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import canonical


#: Languages that a composite key has room for: odd, as a power of two would put all pairs into the same cells of a sketch.
LANGUAGES = 4093


def step_windows(records: DataFrame, interval: int, step: str = "step") -> DataFrame:
    """``window_id`` and ``half_id`` of each row: windows of ``interval`` steps in two halves."""
    half = max(1, interval // 2)
    return records.withColumn("window_id", F.floor(F.col(step) / interval)).withColumn("half_id", F.least(F.floor(F.pmod(F.col(step), F.lit(interval)) / half), F.lit(1)))


def step_discovery(obs: DataFrame, interval: int) -> DataFrame:
    """Running sums per step window, pair and language, of a stream or a table; a window begins from nothing."""
    rows = step_windows(obs, interval)
    return rows.groupBy("window_id", "pair_key", "lang_idx").agg(F.sum("utility").alias("utility"), F.count("*").alias("support"))


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per event-time window.

    A stream drops rows later than ``late`` behind the watermark and forgets windows older than that; written in update
    mode, a micro-batch has only the windows that it changed. ``latest`` puts these together again.
    """
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(frame.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def stream_dedup(pairs: DataFrame, batch_size: int, by: str) -> DataFrame:
    """A stream's pairs without repeated texts in each batch of ``batch_size`` of its ``by`` group: (``by``, batch, slot, anchor, positive).

    The state of a group is the texts of its open batch, so it is bounded by the batch size.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, slot, seen = state.get if state.exists else (0, 0, [])
        texts = set(seen)
        for frame in frames:
            out = []
            for a, p in zip(frame["anchor"], frame["positive"]):
                if a is None or p is None:
                    continue
                forms = {canonical(a), canonical(p)}
                if forms & texts:
                    continue
                out.append((key[0], batch, slot, a, p))
                texts |= forms
                slot += 1
                if slot == batch_size:
                    batch, slot, texts = batch + 1, 0, set()
            yield pd.DataFrame(out, columns=[by, "batch", "slot", "anchor", "positive"])
        state.update((batch, slot, sorted(texts)))

    kind = dict(pairs.dtypes)[by]
    return pairs.groupBy(by).applyInPandasWithState(run, f"`{by}` {kind}, batch int, slot int, anchor string, positive string", "batch int, slot int, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def exactly_once(path: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to its own folder: a replay writes the same folder again."""

    def write(df: DataFrame, batch: int) -> None:
        change(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def latest(written: DataFrame, *key: str, batch: str = "batch") -> DataFrame:
    """Of rows that micro-batches wrote in update mode, the last of each ``key``."""
    others = [c for c in written.columns if c not in (*key, batch)]
    return written.groupBy(*key).agg(F.max_by(F.struct(*others), batch).alias("_r")).select(*key, "_r.*")


def batch_stream(spark: SparkSession, batches: DataFrame, per_trigger: int = 16, start: int = 0) -> DataFrame:
    """Planned batches (batch, slot, ...) as an endless stream: their numbers come from a counting source, in order.

    ``batches`` is a table (``sampling.homogeneous_batches`` and the like, written once) in which a batch is found by its
    number, so a stream that resumes from its checkpoint goes on with the next, and one that begins at ``start`` equals the
    rest of one that began at 0. It ends up empty where the table does.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_trigger).load()
    return ticks.select((F.col("value") + start).alias("batch")).join(batches, "batch")


def running_discovery(obs: DataFrame, capacity: int, top: int, by: str = "stream_id") -> DataFrame:
    """Bounded discovery over a stream of (``by``, pair_key, lang_idx, p, grad): each micro-batch passes on the kept records.

    (``by``, composite_key, pair_key, lang_idx, utility, probability_sum, support). A stream's state is one
    ``BoundedObserver``, of at most ``capacity`` records and a sketch of three rows; a micro-batch's rows of one ``by`` are
    one call. Composite keys have room for the languages that ``LANGUAGES`` bounds.
    """
    from ..operators.discovery import BoundedObserver

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        observer = BoundedObserver.load(json.loads(state.get[0])) if state.exists else BoundedObserver(capacity, top, LANGUAGES)
        rows = pd.concat(list(frames))
        rows = rows[rows["pair_key"].notna() & rows["lang_idx"].notna()]
        if len(rows):
            observer.observe(rows["pair_key"], rows["lang_idx"], rows["p"], rows["grad"])
        state.update((json.dumps(observer.state()),))
        yield pd.DataFrame([(key[0], *r.values()) for r in observer.snapshot()], columns=[by, "composite_key", "pair_key", "lang_idx", "utility", "probability_sum", "support"])

    kind = dict(obs.dtypes)[by]
    schema = f"`{by}` {kind}, composite_key long, pair_key long, lang_idx int, utility double, probability_sum double, support long"
    return obs.groupBy(by).applyInPandasWithState(run, schema, "observer string", "update", GroupStateTimeout.NoTimeout)


def resume_batch(global_step: int, accumulation: int, configured: int = 0) -> int:
    """The batch at which a resumed run goes on; a configured start must be 0 or the same."""
    at = global_step * accumulation
    if configured not in (0, at):
        raise ValueError(f"start {configured} does not fit step {global_step}")
    return at


def saved_state(folder: str | Path, settings: dict) -> dict | None:
    """State saved in ``folder`` under the same settings; None if there is none, an error under others."""
    path = Path(folder) / "state.json"
    if not path.exists():
        return None
    state = json.loads(path.read_text())
    if state.get("settings") != settings:
        raise ValueError("the state was saved under other settings")
    return state


def save_state(folder: str | Path, settings: dict, **state) -> None:
    from ..sources.sinks import write_json

    write_json({"settings": settings, **state}, Path(folder) / "state.json")
