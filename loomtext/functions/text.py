"""Column expressions for text → bytes → tokens (all JVM-side built-ins).

Token surface convention: a token is the upper-case hex of its UTF-8 bytes
("48" is one byte, "4865" a merged token).  Inside the BPE loop a whole
sequence is one delimited string ``<48><65><6C>`` so that applying a merge is
a single built-in ``replace`` — exact, greedy left to right, non-overlapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-token strings of the line tokenizer (default set) and
# of the word tokenizer configuration.  Ids follow the 256 byte ids in order.
DEFAULT_SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>"]
WORD_SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>", "<mask>", "<sep>", "<cls>"]

# Fixed value: GPT-2 style pre-tokenization pattern (Java regex) for word mode.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flatten_newlines(col) -> Column:
    """B2: replace only LF with a space (CR is kept)."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def strip_trailing_newlines(col) -> Column:
    """Drop trailing LF characters only (trailing spaces survive)."""
    return F.expr(f"trim(TRAILING '\\n' FROM {_sql(col)})")


def normalize(col, lowercase: bool = False) -> Column:
    """Optional lower-casing."""
    return F.lower(_c(col)) if lowercase else _c(col)


def utf8_hex(col) -> Column:
    """Upper-case hex of the UTF-8 bytes of a string."""
    return F.hex(F.encode(_c(col), "UTF-8"))


def byte_tokens(col) -> Column:
    """H1: text → array of byte surfaces ('48','C3',…); empty text → []."""
    return F.regexp_extract_all(utf8_hex(col), F.lit(".."), 0)


def byte_ids(col) -> Column:
    """H1 as ids 0..255."""
    return F.transform(byte_tokens(col), lambda h: F.conv(h, 16, 10).cast("int"))


def byte_label(hex_col) -> Column:
    """H2: byte surface → '<0xhh>' label (lower-case hex, as persisted labels)."""
    return F.concat(F.lit("<0x"), F.lower(_c(hex_col)), F.lit(">"))


def label_to_byte(label_col) -> Column:
    """H3: '<0xhh>' → byte value."""
    return F.conv(F.substring(_c(label_col), 4, 2), 16, 10).cast("int")


def delimited(tokens_col) -> Column:
    """Array of surfaces → '<48><65>' sequence string used by the merge loop."""
    t = _c(tokens_col)
    return F.when(F.size(t) == 0, F.lit("")).otherwise(
        F.concat(F.lit("<"), F.array_join(t, "><"), F.lit(">")))


def undelimit(q_col) -> Column:
    """'<48><6565>' → ['48','6565']; '' → []."""
    q = _c(q_col)
    return F.when(F.length(q) == 0, F.array().cast("array<string>")).otherwise(
        F.split(q.substr(F.lit(2), F.length(q) - 2), "><"))


def adjacent_pairs(tokens_col) -> Column:
    """zip(s, s[1:]) as array<struct<a,b,pos>> with 0-based pos; no shuffle."""
    t = _c(tokens_col)
    return F.transform(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, i: F.struct(a.alias("a"), F.get(t, i + 1).alias("b"), i.alias("pos")),
    )


def hex_to_text(hex_col) -> Column:
    """H6: hex bytes → text; malformed UTF-8 becomes U+FFFD (never raises)."""
    return F.make_valid_utf8(F.unhex(_c(hex_col)).cast("string"))


def drop_invalid_utf8(col) -> Column:
    """A2 policy: drop malformed bytes (as reading with errors='ignore')."""
    c = _c(col)
    return F.when(F.is_valid_utf8(c), c).otherwise(
        F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit("")))


def shard_name(split_col, shard_col) -> Column:
    """H12: '{split}_{shard:05d}'."""
    return F.format_string("%s_%05d", _c(split_col), _c(shard_col))


def word_pieces(col, pattern: str = WORD_PATTERN) -> Column:
    """GPT-2 style pre-tokenization into words (Java regex)."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), 0)


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("pass a column name for SQL-expression helpers")
