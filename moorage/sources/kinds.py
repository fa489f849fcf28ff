"""What kind of document a file is (S05-S10, S12, S28), as Column expressions over name, MIME type and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, MIME patterns in order, and signatures in order.
EXTENSIONS = {
    "text": "txt md markdown rst log csv tsv json jsonl yaml yml srt vtt ics rtf tex",
    "code": "ts tsx js jsx py java go rb c h cpp cs php swift kt rs sql sh css scss vue svelte ipynb",
    "pdf": "pdf",
    "docx": "docx doc odt",
    "pptx": "pptx ppt odp key",
    "xlsx": "xlsx xls ods numbers",
    "hwp": "hwp hwpx",
    "image": "png jpg jpeg webp gif bmp tif tiff heic heif avif",
    "audio": "mp3 m4a wav flac ogg aac wma",
    "video": "mp4 mov avi mkv webm m4v",
    "archive": "zip tar gz tgz 7z rar",
    "html": "html htm mhtml xml",
    "email": "eml msg",
}
MIME = [
    ("^application/pdf", "pdf"),
    (r"wordprocessingml|msword|opendocument\.text", "docx"),
    (r"presentationml|ms-powerpoint|opendocument\.presentation", "pptx"),
    (r"spreadsheetml|ms-excel|opendocument\.spreadsheet", "xlsx"),
    ("^image/", "image"),
    ("^audio/", "audio"),
    ("^video/", "video"),
    ("zip|x-tar|gzip|x-7z|rar", "archive"),
    ("^text/html|xml", "html"),
    ("^message/rfc822", "email"),
    ("^text/", "text"),
]
SIGNATURES = [("25504446", "pdf"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("1F8B", "archive"), ("D0CF11E0", "hwp"), ("504B0304", "archive"), ("52494646", "audio")]
GUESSED_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "pdf": "application/pdf"}
SAMPLE, MOST_CONTROL = 4096, 0.02


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(name), r"\.([A-Za-z0-9]+)$", 1))


def kind_by_extension(name: Column) -> Column:
    ext, out = extension(name), F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(names.split()), kind).otherwise(out)
    return out


def kind_by_signature(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 8)), F.lit(None).cast("string")
    for signature, kind in reversed(SIGNATURES):
        out = F.when(head.startswith(signature), kind).otherwise(out)
    return F.when(F.length(content) >= 8, out)


def kind_by_mime(mime: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(MIME):
        out = F.when(mime.rlike(pattern), kind).otherwise(out)
    return out


def looks_like_text(content: Column) -> Column:
    """No NUL and few control characters in the first bytes; bytes are read as Latin-1, one character each."""
    head = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    n = F.length(head)
    control = n - F.length(F.regexp_replace(head, r"[\x01-\x08\x0e-\x1f]", ""))
    return F.coalesce((n > 0) & ~head.rlike(r"\x00") & (control / n < MOST_CONTROL), F.lit(False))


def detect_kind(name: Column, mime: Column, content: Column) -> Column:
    """A signature that contradicts the extension wins, but for archives, and for old containers of documents and sheets; then extension, signature, MIME type, text."""
    ext, sig = kind_by_extension(name), kind_by_signature(content)
    contradicts = sig.isNotNull() & (sig != "archive") & ext.isNotNull() & (sig != ext)
    old = (sig == "hwp") & ext.isin("docx", "xlsx")
    rest = F.coalesce(ext, sig, kind_by_mime(mime), F.when(looks_like_text(content), "text"), F.lit("unknown"))
    return F.when(contradicts & old, ext).when(contradicts, sig).otherwise(rest)


def refine_zip(names: Column) -> Column:
    """What a zip container with these entries is."""
    has = lambda f: F.exists(names, f)
    return (
        F.when(has(lambda n: n.startswith("word/")), "docx")
        .when(has(lambda n: n.startswith("ppt/")), "pptx")
        .when(has(lambda n: n.startswith("xl/")), "xlsx")
        .when(has(lambda n: n.contains("Contents/section") | (n == "version.xml")), "hwp")
        .when(has(lambda n: (n == "mimetype") | n.startswith("META-INF/")), "docx")
        .otherwise("archive")
    )


def guess_mime(kind: Column, name: Column) -> Column:
    ext, out = extension(name), F.when(kind == "image", "image/png").otherwise("application/octet-stream")
    for e, mime in GUESSED_MIME.items():
        out = F.when(ext == e, mime).otherwise(out)
    return out


def exif_date(content: Column) -> Column:
    """The first date of a photograph in its first 128 KiB, as "YYYY-MM-DD HH:MM:SS"; null without one."""
    head = F.decode(F.substring(content, 1, 131_072), "ISO-8859-1")
    found = F.regexp_extract(head, r"((?:19|20)[0-9]{2}:[01][0-9]:[0-3][0-9] [0-2][0-9]:[0-5][0-9]:[0-5][0-9])", 1)
    return F.when(found != "", F.concat(F.translate(F.substring(found, 1, 10), ":", "-"), F.substring(found, 11, 9)))


def image_size(content: Column) -> Column:
    """Width and height in the header of a PNG, GIF or JPEG picture; nulls for others."""
    head = F.hex(F.substring(content, 1, 131_072))
    at = lambda i, n: F.substring(head, 2 * i + 1, 2 * n)
    swapped = lambda i: F.concat(at(i + 1, 1), at(i, 1))
    frame = lambda group: F.nullif(F.regexp_extract(head, r"^(?:..)*?FFC[0-2]......(....)(....)", group), F.lit(""))
    number = lambda x: F.conv(x, 16, 10).cast("int")
    png, gif, jpeg = head.startswith("89504E470D0A1A0A"), head.rlike("^47494638(?:37|39)61"), head.startswith("FFD8")
    width = F.when(png, at(16, 4)).when(gif, swapped(6)).when(jpeg, frame(2))
    height = F.when(png, at(20, 4)).when(gif, swapped(8)).when(jpeg, frame(1))
    return F.struct(number(width).alias("width"), number(height).alias("height"))
