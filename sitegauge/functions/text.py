"""Text helpers: mark-up removal, fingerprints, glyph counts, name keys, plural forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Letters with a multi-letter Latin form; applied before the single letters.
MULTI_LETTER = (
    ("щ", "shch"), ("ж", "zh"), ("ч", "ch"), ("ш", "sh"), ("ю", "iu"), ("я", "ia"),
    ("є", "ie"), ("х", "kh"), ("ц", "ts"), ("ё", "io"),
)
SINGLE_FROM = "їабвгґдезиійклмнопрстуфыэ"
SINGLE_TO = "iabvhgdezyiiklmnoprstufye"
DROPPED = "ьъ'’"

# Latin letters that would lose their nature if accents were just stripped.
DIGRAPH_LETTERS = (("š", "sh"), ("č", "ch"), ("ž", "zh"), ("ć", "ts"))
PLAIN_FROM = "łśźżńąęóřůěťďňýáíéú"
PLAIN_TO = "lszznaeoruetdnyaieu"

# Spelling variants brought to one key, in this order.
KEY_RULES = (
    ("shch|sczc|stch|sch(?=[aeiouy])", "X"),
    ("tch", "ch"),
    ("kh", "h"),
    ("ck", "k"),
    ("ff$", "v"),
    ("j(?=[aeiou])", "i"),
    ("ya|ja", "ia"),
    ("yu|ju", "iu"),
    ("ye|je", "ie"),
    ("yo|jo", "io"),
    ("X", "shch"),
    ("(?:ii|iy|yi|ij|yj|y|j)$", "i"),
    ("y", "i"),
    ("(.)\\1+", "$1"),
)
# --- end of fixed values ----------------------------------------------------

# A dot that stands for any character: a class such as [\s\S] means the same and takes ten times as long.
_COMMENT = r"(?s)<!--.*?-->"

# Runs of blanks but for a single space, which stays as it is: most of a text's blanks are that. The class is written out
# because its characters alone are looked up in a table, here and in other patterns that try each position of a page.
_BLANKS = r"[ \t\n\x0B\f\r](?:[ \t\n\x0B\f\r]+|(?<! ))"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_numeric_entities(text: Column) -> Column:
    """Replace ``&#NNN;`` by its character, once and from left to right; texts without one are passed through.

    The text is cut at ``&#``: a piece that begins with digits and a semicolon is an entity, any other keeps its mark.
    What a decoded ``&`` may form with the text behind it is not decoded again. Two entities that follow each other and
    are the halves of a character give that character.
    """
    cut = lambda t: bind(_pieces(t), _joined)
    return bind(text, lambda t: F.when(t.contains("&#"), cut(t)).otherwise(t))


def _pieces(text: Column) -> Column:
    """Array of struct(digits, point, rest); digits are empty where a piece is no entity, as the first one."""

    def piece(p: Column, i: Column) -> Column:
        head = F.when(i > 0, F.regexp_extract(p, r"^(\d+);", 1)).otherwise("")
        rest = lambda d: F.when(d == "", p).otherwise(F.substr(p, F.length(d) + 2))
        return bind(head, lambda d: F.struct(d.alias("digits"), _number(d).alias("point"), rest(d).alias("rest")))

    return F.transform(F.split(text, "&#", -1), piece)


def _joined(pieces: Column) -> Column:
    def half(p: Column, first: int) -> Column:
        return F.coalesce(p["point"].between(first, first + 0x3FF), F.lit(False))

    def told(p: Column, i: Column) -> Column:
        before, behind = F.get(pieces, i - 1), F.get(pieces, i + 1)
        whole = (p["point"] - 0xD800) * 1024 + (behind["point"] - 0xDC00) + 0x10000
        return (
            F.when(p["digits"] == "", F.concat(F.when(i > 0, "&#").otherwise(""), p["rest"]))
            .when(half(p, 0xD800) & (p["rest"] == "") & half(behind, 0xDC00), character(whole))
            .when(half(p, 0xDC00) & half(before, 0xD800) & (before["rest"] == ""), p["rest"])
            .otherwise(F.concat(character(p["point"]), p["rest"]))
        )

    return F.array_join(F.transform(pieces, told), "")


def character(point: Column) -> Column:
    """The character of a code point; U+FFFD for what is none. Made of its UTF-8 bytes, so nothing can fail."""

    def tail(shift: int) -> Column:
        return F.lit(0x80).bitwiseOR(F.shiftright(p, shift).bitwiseAND(F.lit(63)))

    none = (point < 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    p = F.when(F.coalesce(none, F.lit(True)), F.lit(0xFFFD)).otherwise(point).cast("int")
    two = (F.shiftright(p, 6) + 0xC0) * 256 + tail(0)
    three = ((F.shiftright(p, 12) + 0xE0) * 256 + tail(6)) * 256 + tail(0)
    four = (((F.shiftright(p, 18) + 0xF0).cast("long") * 256 + tail(12)) * 256 + tail(6)) * 256 + tail(0)
    code = F.when(p < 0x80, F.lpad(F.hex(p), 2, "0")).when(p < 0x800, F.hex(two)).when(p < 0x10000, F.hex(three)).otherwise(F.hex(four))
    return F.unhex(code).cast("string")


def _number(code: Column) -> Column:
    """Digits as a number; null beyond nine of them, which is no code point."""
    digits = F.regexp_replace(code, "^0+(?=\\d)", "")
    return F.when(F.length(digits) <= 9, digits.try_cast("int"))


def decode_named_entities(text: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _up_to_last(text: Column, closing: str, opening: str, to: str) -> Column:
    """Replace blocks, looking for openings only in front of the last closing mark.

    There every opening finds its end, so the work is linear; behind it, a page of
    unclosed openings would be searched to its end once for each of them.
    """

    def swap(t: Column) -> Column:
        front = F.regexp_extract(t, rf"(?is)^.*{closing}", 0)
        return bind(
            front,
            lambda f: F.when(f == "", t).otherwise(
                F.concat(F.regexp_replace(f, opening, to), F.substr(t, F.length(f) + 1))
            ),
        )

    return bind(text, swap)


def drop_blocks(html: Column, tag: str, to: str) -> Column:
    """Remove ``<tag ...> ... </tag>``; pages without the closing tag pass."""
    return _up_to_last(html, f"</{tag}>", rf"(?is)<{tag}.*?</{tag}>", to)


def drop_tags(html: Column, to: str) -> Column:
    return _up_to_last(html, ">", r"<[^>]+>", to)


def html_to_text(html: Column) -> Column:
    """Visible text: script, style and noscript dropped, tags to blanks, entities decoded."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = drop_blocks(out, tag, " ")
    return collapse(decode_numeric_entities(decode_named_entities(drop_tags(out, " "))))


def normalize_html(html: Column) -> Column:
    """Mark-up without script, style, comments and blank runs, for comparing two answers.

    The whole page is kept, so that two long pages that differ only near their end differ.
    """
    out = drop_blocks(drop_blocks(html, "script", ""), "style", "")
    return collapse(_up_to_last(out, "-->", _COMMENT, ""))


def fingerprint(html: Column) -> Column:
    return F.sha1(normalize_html(html))


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def count_class(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` inside a regex character class."""
    return F.regexp_count(text, F.lit(f"[{char_class}]"))


def beyond_ascii(char_class: str) -> bool:
    """Whether a character class surely holds no ASCII character; told for plain classes only."""
    try:
        one = re.compile(f"[{char_class}]")
    except re.error:
        return False
    return not any(one.match(chr(c)) for c in range(128))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def transliterate(text: Column) -> Column:
    """Cyrillic letters to Latin ones, lower and upper case alike to lower case Latin."""
    out = text
    for letter, latin in MULTI_LETTER:
        out = F.replace(F.replace(out, F.lit(letter), F.lit(latin)), F.lit(letter.upper()), F.lit(latin))
    source = SINGLE_FROM + SINGLE_FROM.upper() + DROPPED + "ЬЪ"
    return F.translate(out, source, SINGLE_TO + SINGLE_TO)


def _rewrite(text: Column, pattern: str, to: str) -> Column:
    """One spelling rule; rules without regex syntax are plain replacements."""
    if re.fullmatch(r"[A-Za-z|]+", pattern):
        for part in pattern.split("|"):
            text = F.replace(text, F.lit(part), F.lit(to))
        return text
    return F.regexp_replace(text, pattern, to)


def _to_ascii(low: Column) -> Column:
    out = F.when(low.rlike(r"[\u0400-\u04FF]"), transliterate(low)).otherwise(low)
    for letter, latin in DIGRAPH_LETTERS:
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return unaccent(F.translate(out, PLAIN_FROM, PLAIN_TO))


def name_key(text: Column) -> Column:
    """One key for all spellings of a word; plain ASCII words skip the letter tables."""
    out = bind(F.lower(F.trim(text)), lambda w: F.when(w.rlike(r"[^\x00-\x7F]"), _to_ascii(w)).otherwise(w))
    out = F.regexp_replace(out, "[^a-z]", "")
    for pattern, to in KEY_RULES:
        out = _rewrite(out, pattern, to)
    return out


@lru_cache(1)
def _plain_letters() -> dict[str, str]:
    """Every letter whose full decomposition begins with a Latin letter, and that letter."""
    pairs = {}
    for c in map(chr, range(0xC0, 0x30000)):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            first = unicodedata.normalize("NFD", c)[0]
            if first.isascii() and first.isalpha():
                pairs[c] = first
    return pairs


def unaccent(text: Column) -> Column:
    """Strip accents of Latin letters (the letters a Unicode decomposition would split)."""
    pairs = _plain_letters()
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural class of ``n``: 1 / 2-4 / the rest, with 11-14 in the rest."""
    tens = F.abs(n) % 100
    ones = F.abs(n) % 10
    return (
        F.when(tens.between(11, 14), many)
        .when(ones == 1, one)
        .when(ones.between(2, 4), few)
        .otherwise(many)
    )


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def round_half_up(x: Column) -> Column:
    """Rounding towards plus infinity at .5, as an integer."""
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def phrase(template: str, *values: Column) -> Column:
    """``template`` with each ``%s`` replaced by a value; missing values make it null."""
    pieces = template.split("%s")
    parts: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if i < len(values):
            parts.append(values[i].cast("string"))
    return F.concat(*parts)
