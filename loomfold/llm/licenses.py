"""Operator 7, licence scans by canonical digest: whole texts, normalised, hash-joined to the digests of known licences.

Normalising drops copyright notices (no more of their line than the notice), lower-cases, replaces equivalent spellings and the
names of holders, and keeps only runs of letters and digits with one space between. Each licence is known with and without its title,
and with and without what follows its terms. All of it is built-in expressions; the licences are a table of fixed size, so it is broadcast.

Defined results: null, empty and blank texts match nothing; a text of any length is read whole; repeated rows give equal rows; each row gives
one row; an empty table gives none; further columns are ignored. SQL for DuckDB is not given: its patterns have no look-around.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licence texts as published, and spellings that count as equal.
LICENSES = {
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: Further licences, as published, in files named by their SPDX identifier.
TEXTS = Path(__file__).parent / "license_texts"
#: Titles of licences whose text is stored without one.
TITLES = {
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "BSD-2-Clause": ["BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "MIT-0": ["MIT No Attribution", "MIT-0", "MIT No Attribution License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "Zero Clause BSD License (0BSD)", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"],
}
#: Words after which a line that begins with "copyright" is no notice, and words of the terms that end a notice on the same line.
NO_NOTICE = "notice|holder|owner|law|licen[cs]e|statement|interest|protect|treat|right|disclaim|and|or|in|is|on|to|by|of|for|as"
OPENING = r"permission\s+is\s+hereby|permission\s+to\s+use|redistribution\s+and\s+use|licensed\s+under|this\s+software\s+is|everyone\s+is\s+permitted"
NOTICE = (
    r"(?im)(?:\bcopyright[ \t:,]*(?:\(c\)|©|&copy;)|(?:\bcopyright[ \t:,]*|\(c\)[ \t]*|©[ \t]*)[\[<]?(?:\d{4}|yyyy|year)\b"
    rf"|^[^\p{{L}}\p{{N}}\n]*copyright[ \t:]+(?!(?:{NO_NOTICE}))(?=\p{{L}}))[^\n]{{0,300}}?(?=$|\b(?:{OPENING}))"
    r"|^[^\p{L}\p{N}\n]*all rights reserved\.?[ \t]*$"
)
SPELLINGS = {"licence": "license", "organisation": "organization", "noncommercial": "non commercial", "merchantibility": "merchantability", "sub license": "sublicense", "whilst": "while", "https": "http"}
#: What stands for the holder in the canonical text, and numbers of the BSD clauses.
HOLDERS = [
    (r"\bneither the names? of .{1,200}? nor the names? of (?:(?:its|any|the|other) )*contributors\b", "neither the name of the holder nor the names of its contributors"),
    (r"\bprovided by .{1,100}? as is\b", "provided by the holder as is"),
    (r"\bin no event shall .{1,200}? be liable\b", "in no event shall the holder be liable"),
    (r"\b\d (redistributions (?:of|in)|neither the name of)\b", "$1"),
]


def canonical(text):
    """A column of text in canonical form."""
    out = F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), NOTICE, " "))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for a, b in SPELLINGS.items():
        out = F.regexp_replace(out, rf"\b{a}", b)
    for a, b in HOLDERS:
        out = F.regexp_replace(out, a, b)
    return out


def variants() -> list[tuple[str, str]]:
    """license, text: each licence with and without its title, and without what follows its terms."""
    end = "END OF TERMS AND CONDITIONS"
    out = []
    for name, body in [*LICENSES.items(), *((p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt")))]:
        own = [body]
        if name not in TITLES:
            own.append(body.strip("\f\n").partition("\n\n")[2])
        for x in list(own):
            head, mark, _ = x.partition(end)
            own += [head + mark, head] if mark else []
        own += [f"{title}\n\n{body}" for title in TITLES.get(name, [])]
        out += [(name, x) for x in own if x.strip()]
    return out


def known(spark) -> DataFrame:
    rows = spark.createDataFrame(variants(), "license string, body string")
    return rows.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest")).dropDuplicates(["digest"])


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (null where none). `licenses`: license, digest; one row for each digest."""
    found = F.broadcast(known(docs.sparkSession)) if licenses is None else licenses.dropDuplicates(["digest"])
    return docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(found, "digest", "left").select("doc_id", "digest", "license")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
