"""What content is, told from its bytes and characters and never from its name. All are column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading bytes, name, media type, extension; the first that fits counts.
SIGNATURES = [
    ("89504E470D0A1A0A", "png", "image/png", "png"),
    ("FFD8FF", "jpeg", "image/jpeg", "jpg"),
    ("474946383761", "gif", "image/gif", "gif"),
    ("474946383961", "gif", "image/gif", "gif"),
    ("255044462D", "pdf", "application/pdf", "pdf"),
    ("504B0304", "zip", "application/zip", "zip"),
    ("504B0506", "zip", "application/zip", "zip"),
    ("1F8B08", "gzip", "application/gzip", "gz"),
    ("425A68", "bzip2", "application/x-bzip2", "bz2"),
    ("FD377A585A00", "xz", "application/x-xz", "xz"),
    ("53514C69746520666F726D6174203300", "sqlite", "application/vnd.sqlite3", "sqlite"),
    ("377ABCAF271C", "7z", "application/x-7z-compressed", "7z"),
    ("526172211A07", "rar", "application/vnd.rar", "rar"),
    ("664C6143", "flac", "audio/flac", "flac"),
    ("4F676753", "ogg", "application/ogg", "ogg"),
    ("494433", "mp3", "audio/mpeg", "mp3"),
    ("424D", "bmp", "image/bmp", "bmp"),
]
# Bytes at an offset (0-based), the same at a second one, and what they mean.
LATER_SIGNATURES = [
    (0, "52494646", 8, "57454250", "webp", "image/webp", "webp"),
    (0, "52494646", 8, "57415645", "wav", "audio/wav", "wav"),
    (4, "66747970", 4, "66747970", "mp4", "video/mp4", "mp4"),
]
# Two leading bytes.
SHORT_SIGNATURES = [
    ("FFFB", "mp3", "audio/mpeg", "mp3"),
    ("FFF3", "mp3", "audio/mpeg", "mp3"),
    ("FFF2", "mp3", "audio/mpeg", "mp3"),
    ("7801", "zlib", "application/zlib", "zlib"),
    ("785E", "zlib", "application/zlib", "zlib"),
    ("789C", "zlib", "application/zlib", "zlib"),
    ("78DA", "zlib", "application/zlib", "zlib"),
]
# Formats of each category.
CATEGORIES = {
    "image": ["png", "jpeg", "gif", "webp", "bmp"],
    "document": ["pdf", "docx", "xlsx", "pptx"],
    "text": ["text", "json", "xml", "html"],
    "audio": ["mp3", "flac", "ogg", "wav"],
    "video": ["mp4"],
    "archive": ["zip", "7z", "rar", "gzip", "bzip2", "xz", "zlib"],
    "database": ["sqlite"],
}
# Media types of text formats.
TEXT_MIMES = {"text": "text/plain", "json": "application/json", "xml": "application/xml", "html": "text/html"}


def _at(content: Column, offset: int, hexes: str) -> Column:
    return F.substring(content, offset + 1, len(hexes) // 2) == F.unhex(F.lit(hexes))


def detect_format(content: Column) -> Column:
    """Struct (name, mime, extension) by signature, null if none fits. An empty or null content has none."""
    rules = [(_at(content, 0, s), r) for s, *r in SIGNATURES]
    rules += [((F.length(content) >= 12) & _at(content, a, x) & _at(content, b, y), r) for a, x, b, y, *r in LATER_SIGNATURES]
    rules += [(F.hex(F.substring(content, 1, 2)) == s, r) for s, *r in SHORT_SIGNATURES]
    out = None
    for fits, (name, mime, ext) in rules:
        value = F.struct(F.lit(name).alias("name"), F.lit(mime).alias("mime"), F.lit(ext).alias("extension"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


# The wider profile's leading bytes, after the shared ones.
WIDE_SIGNATURES = [
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("47494638", "gif"),
    ("255044462D", "pdf"),
    ("504B0304", "zip"),
    ("504B0506", "zip"),
    ("504B0708", "zip"),
    ("1F8B", "gzip"),
    ("D0CF11E0A1B11AE1", "ole"),
    ("377ABCAF271C", "7z"),
    ("526172211A07", "rar"),
    ("53514C69746520666F726D6174203300", "sqlite"),
    ("4F676753", "ogg"),
    ("494433", "mp3"),
    ("424D", "bmp"),
]


def detect_format_wide(content: Column) -> Column:
    """The wider profile's format name: shorter signatures, OLE and ISO media; null if none fits."""
    out = None
    for hexes, name in WIDE_SIGNATURES:
        out = (F if out is None else out).when(_at(content, 0, hexes), name)
    out = out.when(_at(content, 0, "52494646") & _at(content, 8, "57415645"), "wav")
    return out.when(_at(content, 4, "66747970"), "iso_media")


def magic_bytes(content: Column, n: int = 32) -> Column:
    return F.lower(F.hex(F.substring(content, 1, n)))


def printable_ratio_bytes(content: Column) -> Column:
    """Share of tab, line feed, return and visible ASCII among the bytes, to 4 places; 0 if empty."""
    plain = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\t\n\r\x20-\x7e]", "")
    return F.when(F.length(content) == 0, F.lit(0.0)).otherwise(F.round(F.length(plain) / F.length(content), 4))


def printable_ratio_chars(text: Column) -> Column:
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.round(1 - controls / F.length(text), 4))


def is_readable(text: Column) -> Column:
    """Under 1 % of the characters are unprintable, blanks and line ends apart; an empty text is readable."""
    odd = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]"))
    return (F.length(text) == 0) | (odd < F.length(text) * 0.01)


def is_xml(text: Column) -> Column:
    """Whether a text is one well-formed element, by Spark's XML parser; a document type declaration is refused. Null: false.

    The text is parsed inside an element of ours, whose only content must be one child: what stands before or behind
    a root element shows there.
    """
    inside = F.concat(F.lit("<w>"), F.regexp_replace(text, r"(?s)^\s*<\?xml\b.*?\?>", ""), F.lit("</w>"))
    parsed = F.from_xml(inside, F.lit("xs_any array<string>, _VALUE string, _corrupt_record string"), {"mode": "PERMISSIVE", "rowTag": "w", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.coalesce(parsed["_corrupt_record"].isNull() & (F.size(parsed["xs_any"]) == 1) & parsed["_VALUE"].isNull(), F.lit(False))


def opens_html(text: Column) -> Column:
    """Whether a text opens like an HTML document: its beginning is enough to tell."""
    return F.regexp_like(text, F.lit(r"(?is)^\s*(<!doctype\s+html|<html\b)"))


def classify_text(text: Column) -> Column:
    """json, html, xml or text, for completely read content; JSON and XML are told by parsers."""
    t = F.regexp_replace(text, r"^\s+", "")
    json = t.startswith("{") | t.startswith("[")
    return F.when(json, F.when(F.try_parse_json(t).isNotNull(), "json").otherwise("text")).when(opens_html(t), "html").when(t.startswith("<"), F.when(is_xml(t), "xml").otherwise("text")).otherwise("text")


def category_of(fmt: Column) -> Column:
    out = None
    for category, formats in CATEGORIES.items():
        out = (F if out is None else out).when(fmt.isin(formats), category)
    return out.otherwise("unknown")


def coverage(size: Column, limit: int = 65536) -> Column:
    return F.when(size <= limit, "whole_file").otherwise("prefix_only")


def reading_status(text: Column, fmt: Column) -> Column:
    """empty, empty_content, corrupt (opens like JSON, isn't), unsupported (no format), or sampled."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    opens = F.substring(bare, 1, 1).isin("{", "[")
    return F.when(F.length(text) == 0, "empty").when(bare == "", "empty_content").when(opens & (fmt != "json"), "corrupt").when(fmt.isNull(), "unsupported").otherwise("sampled")


def inspect(files: DataFrame, limit: int = 65536) -> DataFrame:
    """(file_id, original_name, content string) -> one inspection record per file, in one projection.

    mime is that of the signature or of the text format, encoding that of readable text, error says why a file has no type.

    Null content is an empty file: status empty, no type. A bad file becomes a row with a status, never a failure.
    Only the first `limit` bytes are looked at, but for size and hash: ratio and readability are those of the prefix (a
    character cut by its end left out). Content beyond it is HTML if it opens so, which the prefix shows, and else plain
    text, since a part of a document proves no JSON and no XML.
    """
    text = F.coalesce("content", F.lit(""))
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    prefix = F.substring(raw, 1, limit)
    uncut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(4)])
    text = F.when(size <= limit, text).otherwise(uncut)
    named = detect_format(prefix)
    found = F.when(size == 0, F.lit(None)).when(named.isNotNull(), named["name"]).when(~is_readable(text), F.lit(None)).when(size > limit, F.when(opens_html(text), "html").otherwise("text")).otherwise(classify_text(text))
    done = files.select("file_id", "original_name", size.cast("long").alias("file_size"), magic_bytes(prefix).alias("magic_bytes"), printable_ratio_bytes(prefix).alias("printable_ratio"), found.alias("detected_type"), coverage(size, limit).alias("coverage"), F.sha2(raw, 256).alias("sha256"), named["mime"].alias("_mime"))
    status = F.when(F.col("file_size") == 0, "empty").when(F.col("detected_type").isNull(), "unsupported").otherwise("ok")
    confidence = F.when(F.col("detected_type").isNull(), "unknown").when(F.col("detected_type").isin("text", "json", "xml", "html"), "heuristic").otherwise("signature")
    textual = F.col("detected_type").isin(CATEGORIES["text"])
    mime = F.coalesce("_mime", F.element_at(F.create_map(*[F.lit(x) for pair in TEXT_MIMES.items() for x in pair]), F.when(textual, F.col("detected_type"))), F.lit("application/octet-stream"))
    error = F.when(F.col("file_size") == 0, "empty file").when(F.col("detected_type").isNull(), "no known format")
    told = done.select("*", category_of(F.coalesce("detected_type", F.lit(""))).alias("category"), status.alias("status"), confidence.alias("confidence"), mime.alias("mime"), F.when(textual, "utf-8").alias("encoding"), error.alias("error"))
    return told.drop("_mime")


def xor_image_key(content: Column) -> Column:
    """The key of a constant single-byte XOR under which the bytes are an image; null if there is none, or fewer than 8 bytes.

    PNG and GIF are told by their signatures, WEBP by both parts of its, JPEG by its first three and last two bytes.
    """

    def byte(i: int) -> Column:
        return F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("int")

    def key_of(parts: list[tuple[int, str]]) -> Column:
        """Parts: a place (1-based; negative: from the end) and the bytes that stand there, in hexadecimal."""
        want = [(at + i, b) for at, hexes in parts for i, b in enumerate(bytes.fromhex(hexes))]
        key = byte(want[0][0]).bitwiseXOR(F.lit(want[0][1]))
        fits = (key != 0) & (F.length(content) >= max([8, *(i for i, _ in want)]))
        for i, b in want[1:]:
            fits = fits & (byte(i).bitwiseXOR(F.lit(b)) == key)
        return F.when(fits, key)

    of = {name: hexes for hexes, name, *_ in SIGNATURES}
    gifs = [hexes for hexes, name, *_ in SIGNATURES if name == "gif"]
    webp = next((first, second) for _, first, _, second, name, *_ in LATER_SIGNATURES if name == "webp")
    kinds = [[(1, of["png"])], *[[(1, g)] for g in gifs], [(1, webp[0]), (9, webp[1])], [(1, of["jpeg"]), (-2, "FFD9")]]
    return F.coalesce(*[key_of(k) for k in kinds])


#: Names that count without a semicolon, too; longer ones first.
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that stand for the characters of Windows-1252.
_WINDOWS = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _numbered(code: Column) -> Column:
    """The character of a reference's number: 0, surrogates and what lies beyond Unicode are U+FFFD, control characters and non-characters vanish."""
    windows = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    none = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, code)), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when(F.try_element_at(windows, code).isNotNull(), F.try_element_at(windows, code)).when(none, F.lit("")).otherwise(char)


def unescape_html(text: Column) -> Column:
    """Character references decoded once, as HTML 5 parsers do: numbers, names, and the old names that need no semicolon. Anything else stays."""
    named = {n.removesuffix(";"): c for n, c in html5.items() if n.endswith(";")}
    chars = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])

    def decoded(p: Column) -> Column:
        hexa, deci = F.regexp_extract(p, r"^#[xX]0*([0-9A-Fa-f]+);?", 1), F.regexp_extract(p, r"^#0*([0-9]+);?", 1)
        beyond = F.lit(0x110000)
        code = F.when(F.regexp_like(p, F.lit("^#[xX][0-9A-Fa-f]")), F.when(F.length(hexa) > 6, beyond).when(hexa == "", 0).otherwise(F.conv(hexa, 16, 10).cast("int"))).when(F.regexp_like(p, F.lit("^#[0-9]")), F.when(F.length(deci) > 7, beyond).when(deci == "", 0).otherwise(deci.cast("int")))
        name, old = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(p, "^(" + "|".join(_OLD_NAMES) + ")", 1)
        known, known_old = F.try_element_at(chars, name), F.try_element_at(chars, F.nullif(old, F.lit("")))
        after = lambda n: F.substring(p, n, F.length(p))
        numbered = F.concat(_numbered(code), F.regexp_replace(p, r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", ""))
        return F.coalesce(numbered, F.concat(known, after(F.length(name) + 2)), F.concat(known_old, after(F.length(old) + 1)), F.concat(F.lit("&"), p))

    pieces = F.split(text, "&", -1)
    whole = F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


#: A tag: in it, a quoted value behind an equals sign may hold >.
_TAG = r"""</?[a-zA-Z](?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>|<[!?][^>]*>"""


def html_title(html: Column) -> Column:
    """The first title's text, empty if there is none."""
    return unescape_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def html_text(html: Column, limit: int = 2048) -> Column:
    """Text outside of tags, scripts, styles and comments: pieces joined by a blank, character references decoded, cut to `limit` characters, runs of blanks folded."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<!doctype[^>]*>", "<!>")
    pieces = F.filter(F.split(bare, _TAG, -1), lambda x: x != "")
    return F.trim(F.regexp_replace(F.substring(F.array_join(F.transform(pieces, unescape_html), " "), 1, limit), r"[ \t\n\r\f]+", " "))
