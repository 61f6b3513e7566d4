"""String expressions. Every function takes and returns a Column; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonearm import vocab

ColumnLike = Column | str

# Patterns. The blank class is every character that counts as white space in text.
_BLANK_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_CHARS = "".join(
    chr(code)
    for code in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                 0x202F, 0x205F, 0x3000)
)
# The engine tests every part of a class on each character, so a first class turns visible ASCII away at once.
_BLANKS = f"[[^!-~]&&[{_BLANK_CLASS}]]+"
_LINE_END = r"[[^ -~]&&[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]](?:(?<=\r)\n)?"
_STAMP = r"\[[^\]]+\]"
_LINE_ENDS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
_CREDIT_LINE = r"(?imUd)^\s*(作词|作曲|编曲|制作人|OP|SP|Publisher)\s*[:：].*$"
_PLACEHOLDER = r"(?U)纯音乐[，,、\s]*请欣赏"
_BRACKETED = r"\[[^\]]*\]|\([^)]*\)|（[^）]*）"
_PUNCTUATION = r"""[`~!@#$%^&*_=+\[\]{}\\|;:'",.<>/?，。、《》？；：‘’“”【】！￥…—·]"""
_TOKEN_EDGES = r"(?U)^[^\w\u3040-\u30ff\u3400-\u9fff]+|[^\w\u3040-\u30ff\u3400-\u9fff]+\z"
_ZH_RUN, _ZH_ANY = r"[\u4e00-\u9fff]{2,}", r"[\u4e00-\u9fff]"
_JA_RUN, _JA_ANY = r"[\u3040-\u30ff\u3400-\u9fff]{2,}", r"[\u3040-\u30ff]"
_EN_RUN, _EN_ANY = r"[a-zA-Z][a-zA-Z']+", r"[a-zA-Z]{3,}"
_TITLE_BREAK = f"""[{_BLANK_CLASS}""" + r""",，。/\\|·・:：;；\-—_()\[\]{}<>《》“”"'!！?？]+"""
_FILE_NAME_BREAKS = (" - ", " – ", " — ", "-")


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: ColumnLike) -> Column:
    """Text without blanks at both ends (every Unicode blank, not only spaces)."""
    return F.trim(col(value), F.lit(_BLANK_CHARS))


def constant_array(values: Sequence[str]) -> Column:
    """A constant array of texts without line ends, as one literal."""
    return F.split(F.lit("\n".join(values)), "\n") if values else no_items()


def no_items() -> Column:
    return F.array().cast("array<string>")


def safe_text(value: ColumnLike) -> Column:
    """Null becomes the empty text; everything else is cast and stripped."""
    return F.coalesce(strip(col(value).cast("string")), F.lit(""))


def is_blank(value: ColumnLike) -> Column:
    return safe_text(value) == ""


def join_parts(values: ColumnLike, separator: str = " | ") -> Column:
    """Stripped non-blank elements of an array, joined."""
    texts = F.transform(col(values), lambda item: safe_text(item))
    return F.coalesce(F.array_join(F.filter(texts, lambda item: item != ""), separator), F.lit(""))


def split_pipe(value: ColumnLike) -> Column:
    """Parts of a ``|``-joined text, stripped, blanks dropped, duplicates kept."""
    parts = F.transform(F.split(F.coalesce(col(value), F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda item: item != "")


def collapse_blanks(value: ColumnLike) -> Column:
    return F.regexp_replace(col(value), _BLANKS, " ")


def normalize_for_search(value: ColumnLike) -> Column:
    return collapse_blanks(F.lower(safe_text(value)))


def excerpt(value: ColumnLike, limit: int = 300) -> Column:
    """One-line display text of at most ``limit`` characters, cut texts end in an ellipsis."""
    text = strip(F.replace(F.replace(safe_raw(value), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" / ")))
    cut = F.rtrim(F.substring(text, 1, limit - 3), F.lit(_BLANK_CHARS))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def safe_raw(value: ColumnLike) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit(""))


def line_count(value: ColumnLike) -> Column:
    """Number of lines; a line end that closes the text opens no further line."""
    text = safe_raw(value)
    last_open = F.when(F.right(text, F.lit(1)).rlike(_LINE_END), 0).otherwise(1)
    # Counted by what is left without them: no pattern is tried at every character.
    ends = F.length(text) - F.length(F.translate(text, _LINE_ENDS, ""))
    double = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    return F.when(text == "", 0).otherwise((ends - double).cast("int") + last_open)


def lines(value: ColumnLike) -> Column:
    return F.split(safe_raw(value), _LINE_END)


def compact_text(value: ColumnLike) -> Column:
    """Lower-case text without bracketed parts and punctuation, single blanks."""
    text = F.regexp_replace(F.lower(safe_raw(value)), _BRACKETED, " ")
    return strip(collapse_blanks(F.regexp_replace(text, _PUNCTUATION, " ")))


def match_key(value: ColumnLike) -> Column:
    """Comparison key of a title or artist: compact text without any blank."""
    return F.regexp_replace(compact_text(value), _BLANKS, "")


def clean_lyric(value: ColumnLike) -> Column:
    """Lyric text without time stamps, credit lines and the instrumental placeholder."""
    text = F.regexp_replace(safe_text(value), _STAMP, " ")
    text = F.regexp_replace(text, _CREDIT_LINE, " ")
    return strip(collapse_blanks(F.regexp_replace(text, _PLACEHOLDER, " ")))


def lyric_file_text(value: ColumnLike) -> Column:
    """Plain lyric lines for storage: JSON lines, stamps and blank lines dropped."""
    kept = F.filter(lines(value), lambda line: ~F.ltrim(line).startswith("{"))
    bare = F.transform(kept, lambda line: strip(F.regexp_replace(line, r"\[[^\]]*\]", "")))
    return F.array_join(F.filter(bare, lambda line: line != ""), "\n")


def lyric_json_lines(value: ColumnLike) -> Column:
    """Resolve lyric lines stored as JSON objects (``{"c":[{"tx":"text"}]}``) to their text."""

    def resolved(line: Column) -> Column:
        parts = F.try_variant_get(F.try_parse_json(line), "$.c", "array<variant>")
        words = F.transform(parts, lambda part: F.try_variant_get(part, "$.tx", "string"))
        return F.when(line.startswith("{"), strip(F.array_join(words, ""))).otherwise(line)

    text = safe_text(value)
    stripped = F.filter(F.transform(lines(text), strip), lambda line: line != "")
    has_json = F.exists(stripped, lambda line: line.startswith("{"))
    kept = F.filter(F.transform(stripped, resolved), lambda line: line != "")
    return F.when(has_json, F.array_join(kept, "\n")).otherwise(text)


def normalize_token(value: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(safe_text(value)), _TOKEN_EDGES, "")


def contains_any(value: ColumnLike, needles: Sequence[str]) -> Column:
    """Literal, case-insensitive substring test for any of the needles."""
    lowered = constant_array([needle.lower() for needle in needles])
    text = F.lower(safe_raw(value))
    return F.exists(lowered, lambda needle: F.contains(text, needle))


def matching_tags(lowered_text: ColumnLike, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Tags of the rules with a needle in the (already lower-cased) text, in rule order.

    Each rule is a plain condition, so that the tests compile; the first needle found ends a rule.
    """
    text = col(lowered_text)
    hits = [
        F.when(reduce(or_, [F.contains(text, F.lit(needle.lower())) for needle in needles]), F.lit(tag))
        for tag, needles in rules if needles
    ]
    return F.filter(F.array(*hits), lambda tag: tag.isNotNull()) if hits else no_items()


def file_name_identity(stem: ColumnLike) -> Column:
    """(artist, title) of a file name; the first separator kind that occurs decides."""
    text = col(stem)
    identity = F.struct(F.lit("").alias("artist"), strip(text).alias("title"))
    for mark in reversed(_FILE_NAME_BREAKS):
        at = F.instr(text, mark)
        parts = F.struct(
            strip(F.substring_index(text, mark, 1)).alias("artist"),
            strip(F.substr(text, at + F.lit(len(mark)))).alias("title"),
        )
        identity = F.when(at > 0, parts).otherwise(identity)
    return identity


def score_text(label: ColumnLike, score: ColumnLike, pattern: str = "0.0000") -> Column:
    """``label:score`` with half-even decimals."""
    return F.concat(col(label), F.lit(":"), decimals(score, pattern))


def decimals(value: ColumnLike, pattern: str) -> Column:
    """Number in a decimal pattern such as ``0.00``, half-even."""
    return F.call_function("format_number", col(value), F.lit(pattern))


def as_text(value: ColumnLike, kind: str = "scalar") -> Column:
    """Text of any value: booleans as true / false, objects and lists as compact JSON."""
    text = F.to_json(col(value)) if kind == "object" else col(value).cast("string")
    return F.coalesce(text, F.lit(""))


def record_link(song_id: ColumnLike, prefix: str) -> Column:
    return F.concat(F.lit(prefix), col(song_id).cast("string"))


def has_web_scheme(link: ColumnLike) -> Column:
    text = F.lower(safe_text(link))
    return text.startswith("http://") | text.startswith("https://")


def json_string(value: ColumnLike) -> Column:
    """A text as a quoted JSON string."""
    wrapped = F.to_json(F.struct(safe_raw(value).alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def sorted_json(fields: Mapping[str, ColumnLike]) -> Column:
    """JSON object of text fields, keys in order, ``", "`` and ``": "`` as separators."""
    parts = [F.concat(F.lit(f'"{key}": '), json_string(fields[key])) for key in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def params_hash(fields: Mapping[str, ColumnLike]) -> Column:
    return F.sha2(sorted_json(fields), 256)


def event_token(song_id: ColumnLike, name: ColumnLike, artists: ColumnLike, link: ColumnLike) -> Column:
    """The id when there is one, else a digest of name, artists and link."""
    digest = F.md5(
        sorted_json(
            {"name": safe_text(name), "artist_names": safe_text(artists), "link": safe_text(link)}
        )
    )
    return F.when(is_blank(song_id), digest).otherwise(safe_text(song_id))


def tokens(value: ColumnLike, language_tags: ColumnLike) -> Column:
    """Words of a text. A script's tokenizer runs if the language tag or the script is present."""
    text, tags = col(value), col(language_tags)

    def words(run: str, condition: Column) -> Column:
        return F.when(condition, F.regexp_extract_all(text, F.lit(run), F.lit(0))).otherwise(no_items())

    chinese = F.arrays_overlap(tags, constant_array(vocab.CHINESE_LANGUAGES))
    return F.concat(
        words(_ZH_RUN, chinese | text.rlike(_ZH_ANY)),
        words(_JA_RUN, F.array_contains(tags, vocab.JAPANESE_LANGUAGE) | text.rlike(_JA_ANY)),
        words(_EN_RUN, F.array_contains(tags, vocab.ENGLISH_LANGUAGE) | text.rlike(_EN_ANY)),
    )


def title_terms(
    name: ColumnLike,
    aliases: ColumnLike,
    translations: ColumnLike,
    album: ColumnLike,
    language_tags: ColumnLike,
    stop_words: Sequence[str] = tuple(vocab.STOP_WORDS),
) -> Column:
    """Distinct words of the title fields, without stop words and whole titles."""
    fields = [safe_text(item) for item in (name, aliases, translations, album)]
    text = F.lower(F.concat_ws(" ", *fields))
    whole = F.transform(
        F.concat(F.array(fields[0], fields[3]), split_pipe(fields[1]), split_pipe(fields[2])),
        normalize_token,
    )
    raw = F.concat(tokens(text, language_tags), F.split(text, _TITLE_BREAK))
    excluded = F.concat(whole, constant_array(stop_words))
    return F.array_distinct(
        F.filter(
            F.transform(raw, normalize_token),
            lambda term: F.length(term).between(2, 12)
            & ~F.array_contains(excluded, term)
            & ~(term.rlike(_ZH_ANY) & (F.length(term) > 6)),
        )
    )


def lyric_words(
    cleaned: ColumnLike, language_tags: ColumnLike, stop_words: Sequence[str] = tuple(vocab.STOP_WORDS),
    found: Column | None = None,
) -> Column:
    """Normalised lyric words in text order, duplicates kept.

    Words of the built-in tokenizers hold only letters and inner quotes, so closing quotes are all
    there is to strip. ``found`` gives words of a segmenter instead, which get the full treatment.
    """
    if found is None:
        normal = F.transform(tokens(cleaned, language_tags), lambda word: F.rtrim(F.lower(word), F.lit("'")))
        return F.filter(normal, lambda term: (F.length(term) >= 2) & ~term.isin(*stop_words))
    return F.filter(
        F.transform(found, normalize_token),
        lambda term: (F.length(term) >= 2) & ~term.isin(*stop_words) & ~term.rlike(r"(?U)^\d+\z"),
    )


def language_tags(summary: ColumnLike, generated: ColumnLike, candidates: Sequence[str] = tuple(vocab.LANGUAGE_TAGS)) -> Column:
    """Language labels named in the summary, then generated ones, else the unknown label."""
    text = safe_text(summary)
    named = F.filter(constant_array(candidates), lambda tag: F.contains(text, tag))
    found = F.array_distinct(F.concat(named, split_pipe(generated)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(vocab.UNKNOWN)))
