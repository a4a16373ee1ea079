"""Text functions: Column in, Column out."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space, what ends a line, what ends a sentence, and the script looked for.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
SENTENCE_ENDS = "。！？!?"
JAPANESE = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
LINE = rf"[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+"
SENTENCE = rf"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+"
MAX_CHARS = 420


def py_strip(c: Column) -> Column:
    """Without white space (ideographic blanks too) at both ends."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def has_japanese(c: Column, pattern: str = JAPANESE) -> Column:
    return c.rlike(pattern)


def split_lines(c: Column) -> Column:
    """Array of (content, ending); only CR and LF are endings, other separators stay in the content."""
    content = lambda x: F.rtrim(x, F.lit("\r\n"))
    return F.transform(
        F.regexp_extract_all(c, F.lit(LINE), 0),
        lambda x: F.struct(content(x).alias("content"), F.substring(x, F.length(content(x)) + 1, F.lit(2)).alias("ending")),
    )


def split_sentences(c: Column) -> Column:
    """Pieces that end after each terminator; no empty ones."""
    return F.regexp_extract_all(c, F.lit(SENTENCE), 0)


def _slices(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1), F.lit(n)), lambda i: F.substring(c, i + 1, F.lit(n)))


def pack_sentences(c: Column, max_chars: int = MAX_CHARS) -> Column:
    """Sentences packed greedily into chunks of at most max_chars; an over-long sentence closes the open chunk and is
    cut into slices, the last of which is closed too. A short text stays whole."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        done, open_ = acc["done"], acc["open"]
        flushed = F.concat(done, F.when(open_ != "", F.array(open_)).otherwise(none))
        return (
            F.when(F.length(s) > max_chars, F.struct(F.concat(flushed, _slices(s, max_chars)).alias("done"), F.lit("").alias("open")))
            .when(
                (open_ != "") & (F.length(open_) + F.length(s) > max_chars),
                F.struct(flushed.alias("done"), s.alias("open")),
            )
            .otherwise(F.struct(done.alias("done"), F.concat(open_, s).alias("open")))
        )

    packed = F.aggregate(
        split_sentences(c), start, step, lambda acc: F.concat(acc["done"], F.when(acc["open"] != "", F.array(acc["open"])).otherwise(none))
    )
    return F.when(F.length(c) <= max_chars, F.array(c)).otherwise(packed)


def clip(c: Column, n: int, marker: str = "[…]") -> Column:
    """Stripped; over n characters: the first n, a line break and the marker."""
    c = py_strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("\n" + marker))).otherwise(c)


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clean_translation(c: Column) -> Column:
    """Without think blocks, a leading label and one pair of equal quotes around it."""
    c = py_strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    c = F.regexp_replace(c, rf"\A(?:翻译|译文)[{WHITE}]*[:：][{WHITE}]*", "")
    first = F.left(c, F.lit(1))
    quoted = (F.length(c) >= 2) & (first == F.right(c, F.lit(1))) & first.isin('"', "'", "“", "”")
    return py_strip(F.when(quoted, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c))


def collapse_repeats(c: Column) -> Column:
    """A beginning of at least 4 characters that stands three times or more in a row is kept once (the shortest such
    beginning); a rest that begins like it goes."""
    unit = F.regexp_extract(c, r"(?s)\A(.{4,}?)\1{2,}", 1)
    run = F.regexp_extract(c, r"(?s)\A(.{4,}?)\1{2,}", 0)
    rest = F.substring(c, F.length(run) + 1, F.length(c))
    return F.when(unit == "", c).otherwise(F.concat(unit, F.when(F.startswith(unit, rest), F.lit("")).otherwise(rest)))


def is_noise_text(c: Column) -> Column:
    return py_strip(c).rlike(r"\A[\x00-\x7f]?\z")


def normalize_ocr_line(c: Column) -> Column:
    """A line of recognised text without marks and white space."""
    c = py_strip(F.btrim(py_strip(c), F.lit("`")))
    c = F.ltrim(F.replace(c, F.lit("*"), F.lit("")), F.lit("#"))
    return F.translate(F.regexp_replace(c, r"<[^>]+>", " "), WHITE_CHARS, "")


def normalize_ocr_lines(c: Column) -> Column:
    """Array of normalised lines; empty ones go."""
    lines = F.transform(F.split(c, f"[{LINE_ENDS}]"), normalize_ocr_line)  # all that ends a line is white space, too
    return F.filter(lines, lambda x: x != "")


def echoes(line: Column, keywords: Column) -> Column:
    """Whether the lower-cased line holds any keyword."""
    return F.exists(keywords, lambda k: F.contains(F.lower(line), k))


def sanitize_filename(c: Column) -> Column:
    """Last part of a path with safe characters only (letters, numbers, ``_.-()[]`` and blanks), 180 at most; ``upload.bin`` if
    nothing is left. Escapes are decoded one run at a time: bad ones stay as they are, and bytes that are no UTF-8 are unsafe."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|%|[^%]+"), 0)
    bytes_of = lambda run: F.make_valid_utf8(F.unhex(F.replace(run, F.lit("%"), F.lit(""))).cast("string"))
    decoded = F.array_join(F.transform(runs, lambda run: F.when(run.rlike(r"\A%."), bytes_of(run)).otherwise(run)), "")
    name = py_strip(F.regexp_extract(decoded, r"[^/\\]*\z", 0))
    name = F.left(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.\-()\[\] ]+", "_"), r"\A[ .]+|[ .]+\z", ""), F.lit(180))
    return F.when(name == "", F.lit("upload.bin")).otherwise(name)


def redact_keys(m: Column, mask: str = "***") -> Column:
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("token|secret|password|key"), F.lit(mask)).otherwise(v))


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB, in steps of 1024; one decimal but for B."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.concat(F.format_string("%.1f", F.bround(n / float(1024**i), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(n / float(1024**4), 1)), F.lit(" TB")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(basename(path), r"\A.+(\.[^.]+)\z", 1))


def unsafe_member(name: Column) -> Column:
    """Absolute names and those that climb with ``..``."""
    name = F.replace(name, F.lit("\\"), F.lit("/"))
    return name.rlike(r"\A/") | name.rlike(r"(?:\A|/)\.\.(?:/|\z)")


def output_name(path: Column, suffix: str = "_zh") -> Column:
    """The suffix before the extension; folders stay."""
    return F.regexp_replace(path, r"(?s)\A(.*?[^/])(\.[^./]+)?\z", f"$1{suffix}$2")


def inner_text(c: Column, closed: bool = False) -> Column:
    """Text of a block: ruby readings and tags go, all entities, named and numbered, are decoded (``closed``: those that end
    in a semicolon only), ends are stripped."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<rt\b[^>]*>.*?</rt>", ""), r"(?s)<[^>]+>", "")
    return py_strip(unescape_closed(c) if closed else unescape(c))


@F.arrow_udf(StringType())
def unescape(texts: pa.Array) -> pa.Array:
    """Entities decoded as in HTML 5; the table of names is the Python library's."""
    return pa.array([t if t is None or "&" not in t else html.unescape(t) for t in texts.to_pylist()], pa.string())


_ENTITY = re.compile(r"&(?:#\d+|#[xX][\da-fA-F]+|(\w+));")


@F.arrow_udf(StringType())
def unescape_closed(texts: pa.Array) -> pa.Array:
    """The same for whole entities, their semicolon included: a text may have been cut within one."""
    whole = lambda m: html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0]
    return pa.array([t if t is None or "&" not in t else _ENTITY.sub(whole, t) for t in texts.to_pylist()], pa.string())


#: Block elements, and elements that show a picture.
BLOCK = r"(?is)<(p|h[1-6]|blockquote)\b[^>]*>(.*?)</\1>"
MEDIA = r"(?i)<(?:img|image|svg)\b"


def has_media(c: Column) -> Column:
    return c.rlike(MEDIA)
