"""The interaction log and the result store as streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tonearm import vocab
from tonearm.operators import history, snapshots
from tonearm.sources import buckets as tables


def history_entries(
    events: DataFrame, songs: DataFrame, selection_writes_history: bool = True, clicks: DataFrame | None = None,
) -> DataFrame:
    """Stream of history entries: recorded interactions joined with the static catalogue.

    ``clicks`` (song_id, cnt), how often songs were chosen so far, tells which of them are hot; it is looked at when the stream is
    defined. A song that becomes hot later is only slower.
    """
    return history.history_entry(history.recorded(events, selection_writes_history), songs, clicks=clicks)


# Rows of a batch and its stored buckets that one task sorts.
ROWS_A_TASK = 500_000
# One pass over what is there; a continuous run takes {"processingTime": "10 seconds"} instead.
ONCE = {"availableNow": True}


def _folded(
    stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], fold: Callable[[DataFrame | None, DataFrame], DataFrame],
    buckets: int, trigger: Mapping[str, object],
) -> StreamingQuery:
    """Fold every batch into a bucketed table. A batch rewrites the buckets of its keys; one that comes again changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        tables.merge(held, path, key, fold, buckets=buckets, batch=number)
        held.unpersist()
        tables.prune(batch.sparkSession, path)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def keep_last_n(
    events: DataFrame, path: str, checkpoint: str, n: int = vocab.HISTORY_SIZE,
    order: Sequence[str] = ("selected_at", "event_id"), by: Sequence[str] = ("user_id",),
    buckets: int = tables.BUCKETS, trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Keep the last n entries per user in a bucketed table: at most n rows per user, spread by user.

    A batch reads and writes the buckets of its users. Entries with equal order columns are one entry.
    """

    def fold(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if stored is None else stored.unionByName(batch, allowMissingColumns=True)
        return history.last_n(both.dropDuplicates([*by, *order]), n, order, by)

    return _folded(events, path, checkpoint, by, fold, buckets, trigger)


def upsert_stream(
    results: DataFrame, path: str, checkpoint: str, order: str = "collected_at",
    buckets: int = tables.BUCKETS, trigger: Mapping[str, object] = ONCE,
) -> StreamingQuery:
    """Keep the latest result per (song, endpoint, parameters); a batch reads and writes the buckets of its songs' results.

    Tasks are as many as the rows need; the rows of one key are sorted in one task, which may spill.
    """

    def fold(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.count() + (0 if stored is None else stored.count())
        tasks = max(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
        return snapshots.upsert_results(batch.limit(0) if stored is None else stored, batch, order, tasks)

    return _folded(results, path, checkpoint, snapshots.RESULT_KEY, fold, buckets, trigger)
