"""Texts of known formats as plain text (S13-S19, S27, S31), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import WS, trim

# The order of the steps is part of the result (&amp;lt; becomes <).
HTML_STEPS = [
    (r"(?i)<script[\s\S]*?</script>", ""),
    (r"(?i)<style[\s\S]*?</style>", ""),
    (rf"(?i)<br{WS}*/?>", "\n"),
    (r"(?i)</(?:p|div|li|tr|h[1-6])>", "\n"),
    (r"<[^>]+>", " "),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]
OOXML_STEPS = [
    (r"<w:tab/>|<a:tab/>", "\t"),
    (r"</a:p>|</w:p>", "\n"),
    (r"</a:tc>|</w:tc>", " | "),
    (r"</a:tr>|</w:tr>", "\n"),
    (r"<[^>]+>", ""),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&apos;", "'"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]
HWPX_STEPS = [
    (r"<hp:tab[^>]*/>", "\t"),
    (r"</hp:p>", "\n"),
    (r"</hp:tc>", " | "),
    (r"</hp:tr>", "\n"),
    (r"<[^>]+>", ""),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"\n{3,}", "\n\n"),
]
#: Rows of a table, its header among them; characters of a notebook's output; links of a page.
TABLE_ROWS, OUTPUT_CHARS, LINKS = 400, 800, 60


def _steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return trim(text)


def html_to_text(html: Column) -> Column:
    return _steps(html, HTML_STEPS)


def ooxml_to_text(xml: Column) -> Column:
    return _steps(xml, OOXML_STEPS)


def hwpx_to_text(xml: Column) -> Column:
    return _steps(xml, HWPX_STEPS)


def html_links(html: Column, most: int = LINKS) -> Column:
    """The first links of a page, each "text → address"; links without text are left out."""
    pattern = F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"'][^>]*>(.*?)</a>")
    hrefs, texts = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))
    lines = F.zip_with(F.slice(texts, 1, most), F.slice(hrefs, 1, most), lambda t, h: F.concat(trim(F.regexp_replace(t, r"<[^>]+>", "")), F.lit(" → "), h))
    return F.filter(lines, lambda x: ~x.startswith(" →"))


def delimited_to_text(text: Column, name: Column) -> Column:
    """A CSV or TSV as lines of "column: cell", cut at every delimiter; a single line stays as it is."""
    by = F.when(F.lower(name).endswith(".tsv"), F.lit("\t")).otherwise(F.lit(","))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.length(trim(x)) > 0)
    cells = F.transform(F.slice(lines, 1, TABLE_ROWS), lambda x: F.split(x, by))
    header, body = F.get(cells, F.lit(0)), F.slice(cells, 2, TABLE_ROWS)

    def row(values: Column) -> Column:
        pairs = F.transform(header, lambda h, i: F.concat(trim(h), F.lit(": "), trim(F.coalesce(F.get(values, i), F.lit("")))))
        return F.array_join(F.filter(pairs, lambda p: ~p.endswith(": ")), " | ")

    more = F.when(F.size(lines) > TABLE_ROWS, F.concat(F.lit("\n… (총 "), (F.size(lines) - 1).cast("string"), F.lit(f"행 중 앞 {TABLE_ROWS - 1}행)"))).otherwise(F.lit(""))
    out = F.concat(F.lit("[표: "), name, F.lit("]\n열: "), F.array_join(header, " | "), F.lit("\n"), F.array_join(F.transform(body, row), "\n"), more)
    return F.when(F.size(lines) < 2, text).otherwise(out)


def notebook_to_text(raw: Column) -> Column:
    """Markdown cells as they are, code cells fenced, with their outputs; what isn't JSON stays as it is."""
    v = F.try_parse_json(raw)

    def joined(x: Column) -> Column:
        whole = F.try_variant_get(x, "$", "string")
        return F.coalesce(F.array_join(F.try_variant_get(x, "$", "array<string>"), ""), whole, F.lit(""))

    def part(cell: Column) -> Column:
        kind, source = F.try_variant_get(cell, "$.cell_type", "string"), joined(F.try_variant_get(cell, "$.source", "variant"))
        outputs = F.coalesce(F.try_variant_get(cell, "$.outputs", "array<variant>"), F.array().cast("array<variant>"))
        said = F.transform(outputs, lambda o: joined(F.coalesce(F.try_variant_get(o, "$.text", "variant"), F.try_variant_get(o, "$.data['text/plain']", "variant"))))
        shown = F.transform(F.filter(said, lambda t: t != ""), lambda t: F.concat(F.lit("출력: "), F.substring(t, 1, OUTPUT_CHARS)))
        code = F.concat(F.array(F.concat(F.lit("```\n"), source, F.lit("\n```"))), shown)
        return F.when(kind == "markdown", F.array(source)).when(kind == "code", code).otherwise(F.array().cast("array<string>"))

    cells = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.array().cast("array<variant>"))
    return F.when(v.isNull(), raw).otherwise(F.array_join(F.flatten(F.transform(cells, part)), "\n\n"))


def subtitles_to_text(raw: Column) -> Column:
    """The spoken lines of subtitles: without numbers, times and the header."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: ~trim(x).rlike("^[0-9]+$") & ~x.contains("-->") & ~trim(x).startswith("WEBVTT"))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def rtf_to_text(raw: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(raw, rf"\\[a-z]+-?[0-9]*{WS}?", ""), r"[{}]", ""))


def email_parts(raw: Column) -> Column:
    """subject, sender, recipient, date and body. The header ends at the first empty line of bare line feeds; without one all is body."""
    end = F.instr(raw, "\n\n")
    header = F.when(end > 0, F.substring(raw, F.lit(1), end - 1)).otherwise(F.lit(""))
    body = F.when(end > 0, F.substring(raw, end, F.length(raw))).otherwise(raw)

    def field(name: str) -> Column:
        got = F.regexp_extract(header, rf"(?mi)^{name}:{WS}*(.+)$", 1)
        return F.when(got != "", trim(got))

    return F.struct(field("Subject").alias("subject"), field("From").alias("sender"), field("To").alias("recipient"), field("Date").alias("date"), html_to_text(body).alias("body"))


def join_pages(texts: Column) -> Column:
    """Pages as one text, an empty line between them."""
    kept = F.filter(F.transform(texts, trim), lambda t: F.length(t) > 0)
    return trim(F.regexp_replace(F.array_join(kept, "\n\n"), r"\n{4,}", "\n\n\n"))
