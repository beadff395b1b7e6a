"""Incremental manifests over a stream of new files: each micro-batch does what is left to do, and merges its rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from brightloom.operators.joins import remaining
from brightloom.sources.runs import RunStore


def follow(stream: DataFrame, store: RunStore, name: str, key: str, content: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs `work` on rows whose content key no finished record has; its rows need key, status and the content columns.

    A version of the manifest is marked with the checkpoint and the batch that made it. A batch that is run again, since
    the stream stopped after its version was complete but before its checkpoint was, leaves everything as it is; one that
    stopped before is written anew."""
    of = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        if store.marked(name, mark := f"{of}x{number}"):
            return
        todo = remaining(rows, store.load(name), content) if store.exists(name) else rows
        store.merge(name, work(todo), key, mark)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
