"""Text and markup functions, Column to Column, without Python code at run time."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as active markup, remote images and forbidden markup.
ACTIVE_TAGS = "script|iframe|object|embed|form"
PAIRED_ACTIVE = rf"(?is)<({ACTIVE_TAGS})\b[^>]*>.*?</\1\s*>"
SINGLE_ACTIVE = rf"(?is)<(?:{ACTIVE_TAGS})\b[^>]*/?>"
EVENT_HANDLER = r"(?is)\s+on[a-z]+\s*=\s*(['\"]).*?\1"
SCRIPT_URL = r"(?is)\s+(?:href|src)\s*=\s*(['\"])\s*javascript:.*?\1"
REMOTE_IMAGE = r"(?is)<img\b[^>]*\bsrc\s*=\s*(['\"])https?://.*?\1[^>]*>"
FORBIDDEN = rf"(?i)<(?:{ACTIVE_TAGS})\b"
REMOTE_ASSET = r"(?i)src=['\"]https?://"
BOUNDARY_TAGS = "p|div|section|br|td|th|caption|tr"
# Messages of the sanitiser.
MESSAGES = (
    "Active HTML content was removed",
    "Unsafe HTML attributes were removed",
    "Remote images were omitted; provide local assets to embed them",
)

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x{A0}\x{85}\x{2028}\x{2029}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+"


def sub(value: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(value, pattern, new)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(value: Column) -> Column:
    return sub(value, rf"^{SPACE}|{SPACE}$")


def sanitize(value: Column) -> Column:
    """Struct of the ``clean`` markup and the counts of what was removed: ``active``, ``attributes``, ``images``."""
    paired = sub(value, PAIRED_ACTIVE)
    active = sub(paired, SINGLE_ACTIVE)
    handlers = sub(active, EVENT_HANDLER)
    links = sub(handlers, SCRIPT_URL)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    return F.struct(
        sub(links, REMOTE_IMAGE).alias("clean"),
        (count(value, PAIRED_ACTIVE) + count(paired, SINGLE_ACTIVE)).alias("active"),
        (count(active, EVENT_HANDLER) + count(handlers, SCRIPT_URL)).alias("attributes"),
        count(links, REMOTE_IMAGE).alias("images"),
    )


def sanitize_messages(result: Column) -> Column:
    """The messages that belong to the counts of :func:`sanitize`."""
    said = F.array(*[F.when(result[k] > 0, F.lit(m)) for k, m in zip(("active", "attributes", "images"), MESSAGES, strict=True)])
    return F.filter(said, lambda m: m.isNotNull())


def body(value: Column) -> Column:
    """What the first body element holds, else all of it, stripped."""
    pattern = r"(?is)<body[^>]*>(.*?)</body>"
    return let(value, lambda v: strip(F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1)).otherwise(v)))


#: Names that need no semicolon, the longest first, as the start of what follows an ampersand.
_OPEN_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
_NUMBER = "^#(?:([0-9]+)|[xX]([0-9a-fA-F]+));?"
_NAMES = json.dumps(html5)
#: What the numbers 128 to 159 stand for: Windows-1252, or themselves where it has nothing.
_C1 = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number: U+FFFD for null, surrogates and what is beyond Unicode, nothing for what is none."""
    n = F.conv(F.when(F.length(digits) > 12, F.repeat(F.lit("9"), 9)).otherwise(digits), base, 10).cast("long")
    code = F.lpad(F.hex(n), 8, "0")
    control = ((n < 32) & ~n.isin(9, 10, 12, 13)) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
        .when(n.between(128, 159), F.substring(F.lit(_C1), (n - 127).cast("int"), F.lit(1)))
        .when(control | (n == 11), "")
        .otherwise(F.decode(F.unhex(code), "UTF-32"))
    )


def _reference(piece: Column, closed_only: bool) -> Column:
    """What stands behind an ampersand, with the character reference at its start, if there is one, decoded."""
    pattern = _NUMBER.removesuffix("?") if closed_only else _NUMBER
    number = F.regexp_extract(piece, pattern, 0)
    decimal, hexadecimal = F.regexp_extract(piece, pattern, 1), F.regexp_extract(piece, pattern, 2)
    closed = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0)
    open_name = F.lit("") if closed_only else F.regexp_extract(piece, _OPEN_NAMES, 1)
    names = F.from_json(F.lit(_NAMES), "map<string,string>")
    rest = lambda start: F.substring(piece, F.length(start) + 1, F.length(piece))
    return (
        F.when(decimal != "", F.concat(_numbered(F.coalesce(F.nullif(F.ltrim(decimal, F.lit("0")), F.lit("")), F.lit("0")), 10), rest(number)))
        .when(hexadecimal != "", F.concat(_numbered(F.coalesce(F.nullif(F.ltrim(hexadecimal, F.lit("0")), F.lit("")), F.lit("0")), 16), rest(number)))
        .when((closed != "") & names[closed].isNotNull(), F.concat(names[closed], rest(closed)))
        .when(open_name != "", F.concat(names[open_name], rest(open_name)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(value: Column, closed_only: bool = False) -> Column:
    """All character references of HTML decoded once: named ones, with a semicolon or without where that is allowed, and numbers.

    ``closed_only``: what lacks its semicolon is text, as in XML.
    """
    decoded = lambda x: F.array_join(F.transform(F.split(x, "&"), lambda p, i: F.when(i == 0, p).otherwise(_reference(p, closed_only))), "")
    return let(value, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


def escape(value: Column) -> Column:
    """HTML-escape, quotes included."""
    for character, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(character), F.lit(name))
    return value


def collapse(value: Column) -> Column:
    return F.trim(sub(value, SPACE, " "))


def plain_heading(value: Column, closed_only: bool = False) -> Column:
    """Visible text: no comments, no tags, entities decoded, white space collapsed."""
    return collapse(unescape(sub(sub(value, r"(?s)<!--.*?-->"), r"<[^>]+>"), closed_only))


def text_content(value: Column, closed_only: bool = False) -> Column:
    """Text of markup with a space at both ends of block elements; Unicode must already be composed."""
    spaced = sub(value, rf"(?is)</?(?:{BOUNDARY_TAGS})(?:[\s/][^>]*)?>", " ")
    return collapse(unescape(sub(sub(spaced, r"(?s)<!--.*?-->"), r"(?s)<[^>]+>"), closed_only))


def word_count(value: Column) -> Column:
    bare = sub(sub(sub(value, r"!\[[^\]]*\]\([^)]*\)"), r"<[^>]+>", " "), r"[<>*_#`\[\]()]", " ")
    return F.regexp_count(bare, F.lit(WORD)).cast("long")


def visible_text(value: Column) -> Column:
    return strip(sub(sub(value, r"<[^>]+>"), r"[*_`#\[\]()]"))


def casefold(value: Column) -> Column:
    """Lower case with sharp s opened; equal to full case folding on text without other multi-letter folds."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def header_key(value: Column) -> Column:
    """Key by which running headers of pages are the same."""
    return casefold(collapse(sub(sub(value, r"<[^>]+>"), r"^[#*_\s]+|[#*_\s]+$")))


def safe_name(value: Column) -> Column:
    dashed = sub(sub(casefold(value), "[^a-z0-9]+", "-"), "^-+|-+$")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 60), F.lit("")), F.lit("chapter"))


def numbered_name(index: Column, title: Column) -> Column:
    return F.concat(F.format_string("%03d", index), F.lit("-"), safe_name(title), F.lit(".xhtml"))


def inline_markup(value: Column, flags: Column) -> Column:
    """Style bits as elements: 16 strong, 2 em, 1 sup, the last outermost."""
    out = escape(value)
    for bit, name in ((16, "strong"), (2, "em"), (1, "sup")):
        out = F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.concat(F.lit(f"<{name}>"), out, F.lit(f"</{name}>"))).otherwise(out)
    return out


def undecodable(value: Column) -> Column:
    return value.rlike("[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")


def paragraphs(value: Column) -> Column:
    """Blank-line separated blocks as escaped paragraphs."""
    blocks = F.filter(F.transform(F.split(F.replace(value, F.lit("\r\n"), F.lit("\n")), r"\n\s*\n"), strip), lambda x: x != "")
    return F.transform(blocks, lambda x: F.concat(F.lit("<p>"), F.replace(escape(x), F.lit("\n"), F.lit("<br />")), F.lit("</p>")))


def prefer_prose(legacy: Column, candidate: Column) -> Column:
    """Whether a candidate reading is long enough, covers the words and is materially less fragmented."""
    count = lambda text: F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\n\s*\n")))
    return (
        (F.length(strip(candidate)) >= 800)
        & (10 * word_count(strip(candidate)) >= 9 * word_count(strip(legacy)))
        & (4 * F.size(F.split(strip(candidate), r"\n\s*\n")) <= F.greatest(F.lit(1), 3 * count(legacy)))
    )


def redact_images(value: Column) -> Column:
    """Image targets hidden before text is sent to a reviewer."""
    return sub(value, r"(!\[[^\]]*\]\()[^)]*(\))", "$1ASSET_PATH_REDACTED$2")


def local_name(value: Column) -> Column:
    return F.substring_index(value, "}", -1)


def namespace(value: Column) -> Column:
    return F.regexp_extract(value, r"^\{([^}]*)\}", 1)


# Strong markers of text in the legacy Vietnamese encoding TCVN 5712-1, and what the code points from
# U+00A1 to U+00FF, and then the minus sign, stand for in it.
LEGACY_MARKERS = "¤¥¦§¨©¬®µ¶¸¹¾×−"
LEGACY_TARGETS = (
    "ĂÂÊÔƠƯĐăâêôơưđẰ\u0300\u0309\u0303\u0301\u0323àảãáạẲằẳẵắẴẮẦẨẪẤỀặầẩẫấậèỂẻẽéẹềểễếệìỉỄẾỒĩíịòỔỏõóọồổỗốộờởỡớợùỖủũúụừửữứựỳỷỹýỵỐ" + "ư"
)
LEGACY_SOURCES = "".join(map(chr, range(0xA1, 0x100))) + "−"


def legacy_gate(value: Column) -> Column:
    """Struct of ``total`` and distinct ``present`` markers, and whether a text ``is_legacy``."""
    marks = F.array(*[F.lit(c) for c in LEGACY_MARKERS])
    total = F.length(value) - F.length(F.translate(value, LEGACY_MARKERS, ""))
    present = F.size(F.filter(marks, lambda m: F.contains(value, m)))
    legacy = (total >= 4) & (present >= 3) & (total * 500 >= F.greatest(F.lit(1), F.length(value)))
    return F.struct(total.cast("long").alias("total"), present.cast("long").alias("present"), legacy.alias("is_legacy"))


def decode_span(value: Column, font: Column) -> Column:
    """Text of a span in a legacy font; fonts that end in ``H`` hold capitals.  Combining marks are composed by :mod:`.unicode`."""
    plain = F.translate(value, LEGACY_SOURCES, LEGACY_TARGETS)
    capital = font.rlike("H(?:,|$)")
    return F.when(font.startswith(".Vn"), F.when(capital, F.upper(plain)).otherwise(plain)).otherwise(value)
