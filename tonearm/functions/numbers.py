"""Numeric, boolean and date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions.text import ColumnLike, col, safe_text, strip


def to_number(value: ColumnLike, default: float | None = 0.0) -> Column:
    """Lenient number; text that is no number gives the default."""
    number = strip(col(value).cast("string")).try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def parse_bool(value: ColumnLike) -> Column:
    return F.lower(safe_text(value)).isin("true", "1", "yes", "y")


def round_half_even(value: ColumnLike, digits: int = 0) -> Column:
    return F.rint(col(value)) if digits == 0 else F.bround(col(value), digits)


def clip(value: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(value)))


def sigmoid(value: ColumnLike) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(value)))


def softmax(values: ColumnLike) -> Column:
    """Softmax of an array of doubles, shifted by the maximum."""
    array = col(values)
    powers = F.transform(array, lambda item: F.exp(item - F.array_max(array)))
    return bind(
        powers,
        lambda raised: bind(
            F.aggregate(raised, F.lit(0.0), lambda total, item: total + item),
            lambda total: F.transform(raised, lambda item: item / total),
        ),
    )


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def summary_bpm(summary: ColumnLike) -> Column:
    """Tempo noted in a summary: ``BPM | n`` anywhere first, then ``BPM: n``."""
    text = safe_text(summary)
    noted = [r"(?iU)BPM\s*\|\s*(\d{2,3})", r"(?iU)BPM[:：\s]+(\d{2,3})"]
    found = [F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in noted]
    return F.coalesce(*found).cast("int")


def row_bpm(columns: Sequence[ColumnLike], summary: ColumnLike) -> Column:
    """First column holding a tempo of 40..260, else the tempo noted in the summary."""
    given = [to_number(item, None) for item in columns]
    usable = [F.when(item.between(40, 260), F.rint(item).cast("int")) for item in given]
    return F.coalesce(*usable, summary_bpm(summary))


def fold_tempo(tempo: ColumnLike) -> Column:
    """Octave of a tempo nearest to 100 within 72..145, else within 55..190."""
    value = col(tempo).cast("double")

    def nearest(pool: Column) -> Column:
        ranked = F.transform(pool, lambda item: F.struct(F.abs(item - 100).alias("gap"), item.alias("bpm")))
        return F.array_min(ranked)["bpm"]

    octaves = F.array(*[value * factor for factor in (0.25, 0.5, 1.0, 2.0, 4.0)])
    listenable = F.filter(octaves, lambda item: item.between(55, 190))
    preferred = F.filter(octaves, lambda item: item.between(72, 145))
    beyond = F.when(
        value < 55, value * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(55.0) / value)))
    ).otherwise(value / F.pow(F.lit(2.0), F.ceil(F.log2(value / F.lit(190.0)))))
    return F.when(value > 0, F.coalesce(nearest(preferred), nearest(listenable), beyond))


def tempo_label(tempo: ColumnLike, fast: float, slow: float) -> Column:
    value = col(tempo)
    return (
        F.when(value >= fast, vocab.FAST).when(value <= slow, vocab.SLOW)
        .when(value.isNotNull(), vocab.MEDIUM)
    )


def epoch_ms_to_date(value: ColumnLike) -> Column:
    """ISO date (UTC) of epoch milliseconds; unusable values give the empty text."""
    number = col(value).try_cast("double")
    last = 253402300800000  # first millisecond after the year 9999
    day = F.date_from_unix_date(F.floor(number / 86400000).cast("int"))
    return F.when((number > 0) & (number < last), F.date_format(day, "yyyy-MM-dd")).otherwise("")


def duration_text(value: ColumnLike) -> Column:
    """``m:ss`` or ``h:mm:ss`` of milliseconds, seconds rounded half to even."""
    number = col(value).try_cast("double")
    total = F.rint(number / 1000).cast("long")
    hours, minutes = F.floor(total / 3600), F.pmod(F.floor(total / 60), F.lit(60))
    seconds = F.lpad(F.pmod(total, F.lit(60)).cast("string"), 2, "0")
    short = F.concat(F.floor(total / 60).cast("string"), F.lit(":"), seconds)
    long = F.concat(
        hours.cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), seconds
    )
    return F.when(number.isNull(), "").when(hours != 0, long).otherwise(short)


# Forms of a date beside the ISO ones, tried in this order; of two numbers the month is first.
DATE_FORMS = ("yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "M/d/yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M", "MMMM yyyy")


def publish_year(value: ColumnLike) -> Column:
    """Year of a date text in ISO or another usual form; null for anything else."""
    shown = strip(col(value).cast("string"))
    others = [F.try_to_timestamp(shown, F.lit(form)).cast("date") for form in DATE_FORMS]
    return F.year(F.coalesce(shown.try_cast("date"), *others))


def decade_tag(value: ColumnLike, suffix: str = vocab.DECADE_SUFFIX) -> Column:
    """Decade label of a date text; null when there is no year or it is before 1970."""
    year = F.nullif(F.regexp_extract(safe_text(value), r"^(\d{4})", 1), F.lit("")).cast("int")
    decade = (F.floor(year / 10) * 10).cast("string")
    return F.when(year >= 1970, F.concat(decade, F.lit(suffix)))
