"""Feature tables that follow their sources: only new, changed and gone songs are worked on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import session
from tonearm.operators import features
from tonearm.sources import buckets

SIGNATURE = "source_signature"
COUNTS = "feature string, item string, cnt long"
# Of the stored texts: 0.6 of the bytes that Spark's own choice takes.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def _paths(path: str) -> tuple[str, str]:
    return f"{path}/wide", f"{path}/counts"


def signature(columns: list[str], version: str):
    """Digest of all columns of a source row and of the version of what is derived from them."""
    return F.sha2(F.concat_ws("|", F.lit(version), F.to_json(F.struct(*sorted(columns)))), 256)


def _changes(signed: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    """(key, fresh): songs to derive, and with ``fresh`` false songs that are gone."""
    now = signed.select(key, SIGNATURE)
    if stored is None:
        return now.select(key, F.lit(True).alias("fresh"))
    then = stored.select(key, F.col(SIGNATURE).alias("_then"))
    both = now.join(then, key, "full_outer")
    return both.where(~F.col(SIGNATURE).eqNullSafe(F.col("_then"))).select(key, F.col(SIGNATURE).isNotNull().alias("fresh"))


def _follow(
    joined: DataFrame, where: str, derive: Callable[[DataFrame], DataFrame], version: str, fingerprint: str | None, key: str, n: int,
) -> buckets.Manifest:
    """Texts are copied twice, to the signed source rows and to the buckets, and not shuffled here: what is known of keys
    comes to the rows as bitmaps (see ``buckets.split_off``)."""
    spark = joined.sparkSession
    known = buckets.manifest(spark, where) or buckets.Manifest("parquet", (key,), n)
    signed = joined.where(F.col(key).isNotNull()).withColumn(SIGNATURE, signature(joined.columns, version))
    stored = buckets.read(spark, where, known)
    # Read once: what is compared is what is derived, whatever becomes of the sources meanwhile.
    source = session.scratch(spark)
    signed.write.options(**PACKED).parquet(source)
    signed = spark.read.parquet(source)
    changes = session.materialize(_changes(signed, stored, key))
    fresh = signed if stored is None else buckets.split_off(buckets.located(signed), changes.where("fresh"), key, True)
    rows = derive(fresh)
    changed = buckets.touched(changes, known)
    held = buckets.read(spark, where, known, changed, places=True)
    if held is not None:
        rows = buckets.split_off(held, changes, key, False).unionByName(rows, allowMissingColumns=True)
    made = buckets.rewrite(rows, where, replace(known, notes={"fingerprint": fingerprint}), changed, deal=False, **PACKED)
    place, system = buckets._files(spark, source)
    system.delete(place(source), True)
    return made


def _recounted(spark: SparkSession, path: str, wide: buckets.Manifest) -> buckets.Manifest:
    """Bring the counters to the state ``wide`` of the catalogue.

    They know the state that they count. Of the buckets that differ between the two, rows of the earlier state are
    taken off and rows of the later one added, so a run that died before this step is made good by the next one.
    If the earlier state is no longer kept, all is counted.
    """
    songs, where = _paths(path)
    known = buckets.manifest(spark, where) or buckets.Manifest("parquet", ("feature", "item"), wide.buckets)
    of = known.notes.get("of")
    if of == wide.version:
        return known
    earlier = buckets.manifest(spark, songs, of) if of in buckets.versions(spark, songs) else None
    before = earlier.places if earlier else {}
    differ = sorted(b for b in {*before, *wide.places} if before.get(b) != wide.places.get(b))
    parts = []
    for state, sign in ((earlier, -1), (wide, 1)):
        held = buckets.read(spark, songs, state, differ) if state else None
        if held is not None:
            counted = features.frequency_counts(features.feature_rows(held))
            parts.append(counted.select("feature", "item", (F.col("cnt") * sign).alias("cnt")))
    delta = spark.createDataFrame([], COUNTS)
    for part in parts:
        delta = delta.unionByName(part)
    delta = session.materialize(_summed(delta).where("cnt <> 0"))
    changed = buckets.touched(delta, known)
    if earlier is None:
        changed, stored = sorted({*changed, *known.places}), None
    else:
        stored = buckets.read(spark, where, known, changed)
    rows = delta if stored is None else _summed(stored.unionByName(delta)).where("cnt <> 0")
    return buckets.rewrite(rows, where, replace(known, notes={"of": wide.version}), changed)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature", "item").agg(F.sum("cnt").alias("cnt"))


def refresh(
    joined: DataFrame, path: str, derive: Callable[[DataFrame], DataFrame], version: str, fingerprint: str | None = None,
    key: str = "song_id", n: int = buckets.BUCKETS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide, long, counts) of the catalogue, kept in bucketed tables below ``path``.

    ``joined`` has one row for each song, ``derive`` works row by row and keeps the columns ``key`` and the
    signature. Only songs whose source row or ``version`` is not the stored one are derived, songs that are gone are
    removed, and the counters take over the difference. With the ``fingerprint`` of the last refresh nothing is looked at.
    A null key is left out. A second writer at the same time gets a ``Conflict``.
    """
    spark = joined.sparkSession
    songs, counts = _paths(path)
    state = buckets.manifest(spark, songs)
    with session.short_shuffles(spark):
        if state is None or fingerprint is None or state.notes.get("fingerprint") != fingerprint:
            state = _follow(joined, songs, derive, version, fingerprint, key, n)
        _recounted(spark, path, state)
    for table in (songs, counts):
        buckets.prune(spark, table)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide, long, counts) as the last refresh left them; the long table is a view on the lists of the wide one."""
    songs, where = _paths(path)
    wide = buckets.read_all(spark, songs).drop(SIGNATURE)
    return wide, features.feature_rows(wide), buckets.read_all(spark, where)
