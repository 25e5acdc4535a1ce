"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[\p{L}\p{N}_]"
#: Letters of the document codes (fixed values): Latin and Cyrillic, and what may follow the first one.
CODE_LETTER = "A-Za-zА-Яа-яЁё"
IDENTIFIER = rf"(?<![{CODE_LETTER}0-9])([{CODE_LETTER}][{CODE_LETTER}0-9]*(?:[_.-][{CODE_LETTER}0-9]+)+)(?![{CODE_LETTER}0-9])"
#: Prefixes of the embedding model, and the entities that the plain tag stripper knows (fixed values).
PASSAGE, QUERY = "passage: ", "query: "
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&apos;": "'", "&#39;": "'"}
#: Symbols that titles are freed of: pictographs, dingbats, miscellaneous symbols, flags (fixed values).
NOISE = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{1F1E0}-\x{1F1FF}]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def contains_ascii_fold(text: Column, part: Column | str) -> Column:
    """Substring test that ignores the case of ASCII letters only."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.translate(text, UPPER, LOWER).contains(F.translate(part, UPPER, LOWER))


def folded(text: Column) -> Column:
    """Lower case, with the sharp s as two letters, as case folding has it."""
    return F.replace(F.lower(text_or_empty(text)), F.lit("ß"), F.lit("ss"))


def normalized(text: Column) -> Column:
    """Lower case, everything but letters, digits and `_` to one space, trimmed."""
    out = F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def stable_chunk_id(*fields: Column) -> Column:
    """First 24 hex digits of the digest of the fields joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("")) for f in fields]), 256), 1, 24)


def page_ids(text: Column) -> Column:
    """A bare number of 6 to 12 digits, else the numbers of that length after each `pageId`, in order, once each."""
    bare = F.regexp_extract(text, r"^\s*(\d{6,12})\s*$", 1)
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bpageId\s*[:=]?\s*(\d{6,12})\b")))
    return F.when(bare != "", F.array(bare)).otherwise(named)


def identifiers(text: Column) -> Column:
    """Document codes, once each, longest first, those of one length in order."""
    found = F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(IDENTIFIER)))
    ordered = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.transform(ordered, lambda s: s.x)


def words(text: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(rf"({WORD}{{{least},}})"))


def query_terms(text: Column) -> Column:
    """Folded words of three characters or more that are not numbers."""
    return F.transform(F.filter(words(text, 3), lambda w: ~w.rlike(r"^[0-9]+$")), folded)


def truncated(text: Column, n: int, mark: str = "... [текст обрезан]") -> Column:
    """The text, or its first n characters and a mark."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def _diacritics() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by canonical decomposition."""
    pairs = []
    for ranges in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for c in map(chr, range(*ranges)):
            base = unicodedata.normalize("NFD", c)
            if len(base) > 1 and base[0].isascii():
                pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _diacritics()


def search_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits, lower case, Latin marks dropped (H1)."""
    return F.regexp_extract_all(F.translate(F.lower(text_or_empty(text)), MARKED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"))


def strip_tags(html: Column) -> Column:
    """Tags to spaces, seven entities decoded (each place once), runs of blanks to one."""
    out = F.regexp_replace(text_or_empty(html), "<[^>]+>", " ")
    pieces = F.split(F.regexp_replace(out, "(&[a-zA-Z]+;|&#[0-9]+;|&#x[0-9a-fA-F]+;)", "\x00$1\x00"), "\x00")
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    out = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at(known, x), x)), "")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def html_tables(html: Column) -> Column:
    """One text for each <table>: its number, then rows with their cells, the plain way by patterns."""
    tables = F.regexp_extract_all(text_or_empty(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"))
    return F.transform(tables, lambda t, i: _table_text(t, i + 1))


def _table_text(table: Column, number: Column) -> Column:
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"))

    def line(row, i):
        cells = F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>")), strip_tags)
        label = F.when(row.rlike(r"(?i)<th\b"), F.lit("заголовок")).otherwise(F.concat(F.lit("строка "), (i + 1).cast("string")))
        return F.when(F.exists(cells, lambda c: c != ""), F.concat(F.lit("| "), label, F.lit(" | "), F.array_join(cells, " | "), F.lit(" |")))

    lines = F.filter(F.transform(rows, line), lambda x: x.isNotNull())
    head = F.concat(F.lit("[Таблица "), number.cast("string"), F.lit("]\n"))
    return F.when(F.size(rows) == 0, strip_tags(table)).when(F.size(lines) == 0, F.lit("")).otherwise(F.concat(head, F.array_join(lines, "\n")))


def breadcrumbs(ancestor_titles: Column, title: Column) -> Column:
    """Non-empty titles of the ancestors, then the title unless it is the last of them, joined by ` > `."""
    parts = F.filter(F.transform(F.coalesce(ancestor_titles, F.array().cast("array<string>")), lambda x: F.trim(text_or_empty(x))), lambda x: x != "")
    own = F.trim(text_or_empty(title))
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.array_join(F.when((own != "") & ~last.eqNullSafe(own), F.concat(parts, F.array(own))).otherwise(parts), " > ")


def without_header(text: Column) -> Column:
    """A chunk's text without the path and title lines put before it."""
    return F.regexp_replace(text, r"^(?:Путь: .+\n)?Заголовок: .+\n\n", "")


def plain_title(text: Column) -> Column:
    """Folded title without pictographs and other symbols, blanks collapsed."""
    out = F.regexp_replace(text_or_empty(text), NOISE, " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s\-./]+", " ")
    return F.trim(F.regexp_replace(folded(out), r"\s+", " "))


def collection_name(base: str, model_version: Column) -> Column:
    """base, a slug of at most 68 characters, and ten digits of the model's digest; null where no character is usable."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(model_version, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""))
    return F.when(slug != "", F.concat(F.lit(base + "__"), F.substring(slug, 1, 68), F.lit("-"), F.substring(F.sha2(model_version, 256), 1, 10)))


def parsed_date(text: Column) -> Column:
    """An ISO date or date and time, with `Z`, `+03:00` or `+0300`; null where it is none (G24). Without a zone it is UTC."""
    fixed = F.regexp_replace(F.trim(text), r"(:\d{2}(?:\.\d{1,6})?[+-]\d{2})(\d{2})$", "$1:$2")
    fixed = F.regexp_replace(fixed, r"^(.{10}[T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    fixed = F.when(fixed.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), fixed)
    return fixed.try_cast("timestamp")


def minute_format(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm` of a date in its own zone; what is no date is cut to 16 characters."""
    cut = F.replace(F.substring(text, 1, 16), F.lit("T"), F.lit(" "))
    return F.when(parsed_date(text).isNotNull() & (F.length(F.trim(text)) == 10), F.concat(F.trim(text), F.lit(" 00:00"))).otherwise(cut)


def prefixed(text: Column, prefix: str) -> Column:
    """The text as the embedding model wants it."""
    return F.concat(F.lit(prefix), text_or_empty(text))
