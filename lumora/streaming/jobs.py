"""The kernels and ledgers as Structured Streaming jobs.

Per-stream kernels keep their object in state; late rows get the kernel's own reason.
Sinks are idempotent: a micro-batch that runs twice adds nothing the second time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import EVIDENCE_SCHEMA, SAMPLER_SCHEMA, SEGMENT_SCHEMA, Evidence, Sampler, Segmenter
from .consumer import Consumer, consume, taken


def keyed_fold(frames: DataFrame, make: Callable[[], object], schema: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """The kernel over a stream, its object in the state of each stream_id.

    A stream_id without rows for idle_ms is over: what its kernel still holds comes out and its state goes. Without
    idle_ms streams have no end and their last, open rows stay in state.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(state.get[0]) if state.exists else make()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *r) for r in kernel.finish()], columns=names)
            return
        rows = []
        every = pd.concat(list(batches)).sort_values(order)
        for row in every.itertuples(index=False):
            rows += [(key[0], *r) for r in kernel.push(row)]
        state.update((pickle.dumps(kernel),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=names)

    return frames.groupBy("stream_id").applyInPandasWithState(step, schema, "kernel binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def sampled(frames: DataFrame, idle_ms: int | None = None, **policy) -> DataFrame:
    return keyed_fold(frames, lambda: Sampler(**policy), SAMPLER_SCHEMA, "frame_index", idle_ms)


def evidence(frames: DataFrame, idle_ms: int | None = None, **policy) -> DataFrame:
    """Rows come out as they settle: the ring of context candidates stays in state until the stream goes on."""
    return keyed_fold(frames, lambda: Evidence(**policy), EVIDENCE_SCHEMA, "frame_index", idle_ms)


def segmented(chunks: DataFrame, idle_ms: int | None = None, **policy) -> DataFrame:
    return keyed_fold(chunks, lambda: Segmenter(**policy), SEGMENT_SCHEMA, "pts_ms", idle_ms)


def fused_windows(observation: DataFrame, window: str, late: str) -> DataFrame:
    """Counts per stream, window and modality on event time. Rows later than the watermark are not counted; a consumer with an event time keeps them in a table of its own."""
    return observation.withWatermark("at", late).groupBy("stream_id", F.window("at", window), "modality").agg(F.count(F.lit(1)).alias("n"))


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> DataStreamWriter:
    """A sink that adds the rows whose keys are not there yet: at-least-once delivery becomes once. The ledger is read, of the sink only what meets a batch's range of keys."""
    return consume(stream, Consumer(path, tuple(keys)), taken, checkpoint)
