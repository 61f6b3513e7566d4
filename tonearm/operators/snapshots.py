"""Flattening nested per-song JSON documents to the catalogue's wide row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import numbers, text, udfs



def field(value: Column | str, path: str, kind: str = "string") -> Column:
    """Typed value at a path of a variant; null when it is missing or has another type."""
    return F.try_variant_get(text.col(value), path, kind)


def items(value: Column | str, path: str) -> Column:
    """Elements of a list at a path as variants; null when there is no list."""
    return field(value, path, "array<variant>")


def first(values: Column) -> Column:
    return F.get(values, 0)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def truthy(source: Column | str, path: str) -> Column:
    """Text of the value at a path; null for what falls through to the next choice: "", the number 0 and false.

    The texts "0" and "false" are values like any other.
    """
    value = field(source, path)
    kind = F.schema_of_variant(field(source, path, "variant"))
    nothing = F.when(kind == "STRING", value == "").when(kind == "BOOLEAN", value == "false").otherwise(
        F.coalesce(value.try_cast("double") == 0, F.lit(False)))
    return F.when(~nothing, value)


def first_ok_response(document: Column | str, endpoint: str) -> Column:
    """Response object of the first result of an endpoint that has no error."""
    usable = F.filter(
        items(document, f"$.api_results.{endpoint}"),
        lambda row: truthy(row, "$.error").isNull()
        & F.coalesce(is_object(field(row, "$.response", "variant")), F.lit(False)),
    )
    return field(first(usable), "$.response", "variant")


def pick_by_id(candidates: Column, target: Column) -> Column:
    """Element whose id is the target, else the first one."""
    same = F.filter(candidates, lambda item: field(item, "$.id") == target)
    return F.coalesce(first(same), first(candidates))


def detail_song(document: str, target: Column, strict: bool = True) -> Column:
    """The song object of the stored detail, else of the detail response."""
    stored = field(document, "$.raw_detail", "variant")
    detail = F.when(F.coalesce(is_object(stored), F.lit(False)), stored).otherwise(
        first_ok_response(document, "song_detail")
    )
    songs = items(detail, "$.songs")
    if not strict:
        songs = F.coalesce(songs, items(detail, "$.body.songs"))
    return pick_by_id(songs, target)


def first_comment(comments: Column, prefix: str) -> dict[str, Column]:
    comment = first(comments)
    return {
        f"first_{prefix}comment_user": field(comment, "$.user.nickname"),
        f"first_{prefix}comment_likes": field(comment, "$.likedCount"),
        f"first_{prefix}comment": text.excerpt(field(comment, "$.content"), 500),
    }


def names(values: Column, path: str, separator: str = " | ") -> Column:
    return text.join_parts(F.transform(values, lambda item: field(item, path)), separator)


def similar_info(document: str) -> dict[str, Column]:
    songs = items(first_ok_response(document, "simi_song"), "$.songs")

    def artists(song: Column) -> Column:
        return names(F.coalesce(items(song, "$.artists"), items(song, "$.ar")), "$.name", "/")

    return {
        "similar_song_ids": names(songs, "$.id"),
        "similar_song_names": names(songs, "$.name"),
        "similar_artist_names": text.join_parts(F.transform(songs, artists)),
    }


def lyric_part(document: str, key: str) -> Column:
    """First non-blank lyric of a kind: the newer endpoint before the older one."""
    found = [
        F.nullif(text.lyric_json_lines(field(first_ok_response(document, endpoint), f"$.{key}.lyric")), F.lit(""))
        for endpoint in ("lyric_new", "lyric")
    ]
    return F.coalesce(*found, F.lit(""))


def url_columns(document: str) -> dict[str, Column]:
    """Six fields per link level; the last result of a level wins."""
    results = F.transform(
        items(document, "$.api_results.song_url_v1"),
        lambda row: F.struct(
            F.coalesce(
                truthy(row, "$.params.level"), field(row, "$.response.data[0].level")
            ).alias("level"),
            field(row, "$.response.data[0]", "variant").alias("item"),
        ),
    )
    usable = F.filter(results, lambda result: F.coalesce(is_object(result["item"]), F.lit(False)))

    def item(level: str) -> Column:
        return F.try_element_at(F.filter(usable, lambda result: result["level"] == level), F.lit(-1))["item"]

    return {
        f"{level}_{name}": field(item(level), f"$.{name}")
        for level in vocab.URL_LEVELS
        for name in vocab.URL_FIELDS
    }


def flatten_snapshots(
    documents: DataFrame, content: str = "value", file_name: str = "file_name",
    include_lyrics: bool = False, strict: bool = True,
) -> DataFrame:
    """The 95 (with lyrics 98) catalogue columns of each readable document.

    One projection over the parsed document; only the summary text needs a UDF, because its words
    are taken in document order, which a parsed variant does not keep.
    """
    parsed = documents.withColumn("d", F.try_parse_json(content)).where(F.col("d").isNotNull())
    target = field("d", "$.song_id")
    staged = parsed.withColumn("song", detail_song("d", target, strict)).withColumns(
        {
            "privilege": F.coalesce(
                pick_by_id(items("d", "$.raw_detail.privileges"),
                           F.coalesce(truthy("d", "$.song_id"), field("song", "$.id"))),
                field("song", "$.privilege", "variant"),
            ),
            "artists": F.coalesce(
                F.when(F.size(items("d", "$.artists")) > 0, items("d", "$.artists")), items("song", "$.ar")
            ),
            "check": first_ok_response("d", "check_music"),
            "comments": first_ok_response("d", "comment_music"),
            "lyric_text": lyric_part("d", "lrc"),
            "translation_text": lyric_part("d", "tlyric"),
            "romaji_text": lyric_part("d", "romalrc"),
            "wiki": F.get_json_object(content, "$.api_results.song_wiki_summary"),
        }
    )
    staged = staged.withColumn("wiki_texts", udfs.harvest_first_good("wiki"))
    duration = F.coalesce(truthy("d", "$.duration_ms"), field("song", "$.dt"))
    published = field("song", "$.publishTime")
    hot = items("comments", "$.hotComments")

    def song(path: str) -> Column:
        return field("song", f"$.{path}")

    def privilege(path: str) -> Column:
        return field("privilege", f"$.{path}")

    def either(own: str, nested: str) -> Column:
        return F.coalesce(truthy("d", f"$.{own}"), song(nested))

    def flag(name: str) -> Column:
        return (F.col(name) != "").cast("string")

    known_privilege = F.coalesce(is_object(F.col("privilege")), F.lit(False)) & (
        F.to_json("privilege") != "{}"
    )
    stem = F.regexp_replace(file_name, r"\.[^.]*\z", "")
    row: Mapping[str, Column] = {
        "source_file": F.col(file_name),
        "song_id": F.coalesce(truthy("d", "$.song_id"), truthy("song", "$.id"), stem),
        "name": either("name", "name"),
        "aliases": text.join_parts(F.transform(items("song", "$.alia"), lambda item: field(item, "$"))),
        "translations": text.join_parts(F.transform(items("song", "$.tns"), lambda item: field(item, "$"))),
        "artist_names": names(F.col("artists"), "$.name"),
        "artist_ids": names(F.col("artists"), "$.id"),
        "album_id": either("album_id", "al.id"),
        "album_name": either("album_name", "al.name"),
        "album_pic_url": song("al.picUrl"),
        "duration_ms": duration,
        "duration_seconds": F.bround(duration.try_cast("double") / 1000, 3).cast("string"),
        "duration_text": numbers.duration_text(duration),
        "publish_time_ms": published,
        "publish_date": numbers.epoch_ms_to_date(published),
        "disc": song("cd"), "track_no": song("no"), "popularity": song("pop"), "mv_id": song("mv"),
        "fee": song("fee"), "copyright": song("copyright"), "status": song("st"),
        "version": F.coalesce(truthy("song", "$.version"), song("v")),
        "collected_at": field("d", "$.collected_at"),
        "check_success": field("check", "$.success"),
        "check_message": F.coalesce(truthy("check", "$.message"), field("check", "$.msg")),
        "playable": F.when(known_privilege, truthy("privilege", "$.pl").isNotNull().cast("string")),
        "max_br_level": privilege("maxBrLevel"), "max_bitrate": privilege("maxbr"),
        "play_max_br_level": privilege("playMaxBrLevel"), "play_max_bitrate": privilege("playMaxbr"),
        "download_max_br_level": privilege("downloadMaxBrLevel"),
        "download_max_bitrate": privilege("downloadMaxbr"),
        "free_level": privilege("flLevel"), "paid": privilege("payed"),
        "privilege_fee": privilege("fee"), "privilege_status": privilege("st"),
        "comment_total": field("comments", "$.total"),
        "hot_comment_count": F.coalesce(F.array_size(hot), F.lit(0)).cast("string"),
        **first_comment(hot, "hot_"),
        **first_comment(items("comments", "$.comments"), ""),
        "has_lyric": flag("lyric_text"),
        "lyric_line_count": text.line_count("lyric_text").cast("string"),
        "lyric_excerpt": text.excerpt("lyric_text", 500),
        "has_translation": flag("translation_text"),
        "translation_excerpt": text.excerpt("translation_text", 500),
        "has_romaji": flag("romaji_text"),
        "romaji_excerpt": text.excerpt("romaji_text", 500),
        **similar_info("d"),
        "wiki_summary_excerpt": text.excerpt(text.join_parts("wiki_texts"), 800),
        **{f"{level}_{name}": song(f"{level}.{name}")
           for level in vocab.QUALITY_LEVELS for name in vocab.QUALITY_FIELDS},
        **url_columns("d"),
    }
    columns = vocab.BASE_COLUMNS + vocab.QUALITY_COLUMNS + vocab.URL_COLUMNS
    extra = [F.col(name) for name in vocab.LYRIC_COLUMNS] if include_lyrics else []
    return staged.select(*[text.safe_raw(row[name]).alias(name) for name in columns], *extra)


def unreadable(documents: DataFrame, content: str = "value", file_name: str = "file_name") -> DataFrame:
    """Error table of documents that are no JSON."""
    bad = documents.where(F.try_parse_json(content).isNull())
    return bad.select(file_name, F.lit("not valid JSON").alias("error"))


def with_unlicensed_flag(documents: DataFrame, content: str = "value", marker: str = vocab.UNLICENSED_MARKER) -> DataFrame:
    """Add ``unlicensed``: a message leaf in the API results holds the marker.

    Only documents whose raw text holds the marker reach the UDF with content, so almost all rows
    are decided by a substring test.
    """
    suspect = F.when(F.contains(F.col(content), F.lit(marker)), F.get_json_object(content, "$.api_results"))
    return documents.withColumn("unlicensed", udfs.has_marker(suspect, marker))


def licensed(documents: DataFrame, content: str = "value", marker: str = vocab.UNLICENSED_MARKER, keep: bool = False) -> DataFrame:
    """Documents without the unlicensed marker; ``keep`` turns the filter off."""
    if keep:
        return documents
    return with_unlicensed_flag(documents, content, marker).where(~F.col("unlicensed")).drop("unlicensed")


def assemble_snapshots(songs: DataFrame, results: DataFrame) -> DataFrame:
    """(song_id, document): one JSON document per song with its results grouped by endpoint.

    Stored JSON texts go in as they are, so their keys keep their order; what is no JSON becomes null, and
    null fields stay. Results are ordered by (endpoint, id). A song's results are one document by
    definition, so the group is as large as the document that is asked for.
    """
    kept = {"ignoreNullFields": "false"}
    row = F.to_json(F.struct("id", "song_id", "endpoint", "status", "code", "error", "collected_at"), kept)
    row = _with_members(row, params=_raw("params_json"), response=_raw("response_json"))
    by_endpoint = results.groupBy("song_id", "endpoint").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("r")))), lambda item: item["r"]).alias("rs")
    )
    entry = F.concat(text.json_string("endpoint"), F.lit(":["), F.array_join("rs", ","), F.lit("]"))
    by_song = by_endpoint.groupBy("song_id").agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("api")
    )
    head = F.to_json(F.struct("song_id", "name", "album_id", "album_name", "duration_ms", "collected_at"), kept)
    api = F.concat(F.lit("{"), F.coalesce("api", F.lit("")), F.lit("}"))
    joined = songs.join(by_song, "song_id", "left")
    document = _with_members(head, artists=_raw("artists_json"), raw_detail=_raw("raw_detail_json"), api_results=api)
    return joined.select("song_id", document.alias("document"))


def _raw(content: str) -> Column:
    """A JSON text as it is, ``null`` for anything else."""
    return F.when(F.try_parse_json(content).isNotNull(), F.col(content)).otherwise("null")


def _with_members(json_object: Column, **members: Column) -> Column:
    """A non-empty JSON object's text with more members at its end."""
    added = [part for name, value in members.items() for part in (F.lit(f',"{name}":'), value)]
    return F.concat(F.substr(json_object, F.lit(1), F.length(json_object) - 1), *added, F.lit("}"))


RESULT_KEY = ("song_id", "endpoint", "params_hash")


def upsert_results(existing: DataFrame, incoming: DataFrame, order: str = "collected_at", tasks: int | None = None) -> DataFrame:
    """Insert, or replace on (song_id, endpoint, params_hash); the latest collection wins.

    Rows are sorted by key. With ``tasks`` they are dealt out by key to that many before, so what a task sorts doesn't follow
    the size of a split.
    """
    keys = list(RESULT_KEY)
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    both = both.repartition(tasks, *keys) if tasks else both
    values = [name for name in existing.columns if name not in keys]
    latest = F.max_by(F.struct(*values), F.struct(order, "_new"))
    return both.groupBy(*keys).agg(latest.alias("row")).select(*keys, "row.*").select(*existing.columns)


def playlist_track_ids(documents: DataFrame, content: str = "value", key: str = "playlist_id") -> DataFrame:
    """(playlist, song_id, position): ids of the listed songs, else of the track ids, distinct in order."""
    body = F.coalesce(field("d", "$.body", "variant"), F.col("d"))

    def ids(source: Column) -> Column:
        found = F.transform(source, lambda item: truthy(item, "$.id").try_cast("long"))
        return F.array_distinct(F.filter(found, lambda item: item.isNotNull()))

    parsed = documents.select(key, F.try_parse_json(content).alias("d")).select(key, body.alias("b"))
    songs, tracks = ids(items("b", "$.songs")), ids(items("b", "$.playlist.trackIds"))
    chosen = F.when(F.size(F.coalesce(songs, F.array().cast("array<bigint>"))) > 0, songs).otherwise(tracks)
    return parsed.select(key, F.posexplode(chosen).alias("position", "song_id"))
