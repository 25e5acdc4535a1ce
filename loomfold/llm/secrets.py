"""Operator 2, secret scans: three patterns, and a battery of randomness tests. DataFrame functions only.

Positions come from cutting a text at a pattern's matches: the lengths of the pieces and of the matches, added up, are the
spans in code points. Patterns: see BASE; the span of a match is the whole match.

The battery looks at tokens of 20 or more characters of `[A-Za-z0-9+/_=-]` that hold a digit. Their encoding is inferred
(hex of either case, with dashes or without, base32, base62 or base64, which sets the alphabet; see ENCODINGS), and three statistics are
taken: chi-squared of the alphabet (or, what is the same up to scale, the coincidence of characters), runs, and lag-1 serial correlation.
Two hypotheses are tested by them, each by a weighted Benjamini-Hochberg procedure over all tokens of the document, whose weights grow
with the token's length (mean one). Under that of ordinary text the coincidence is higher and runs of digits and words are fewer:
a token must be a discovery against it, at FALSE_DISCOVERY. Under that of uniform characters the least of the three p values counts,
with Bonferroni's factor: a token that is a discovery against that one, at BATTERY_ALPHA, goes. What is left is of kind `random`.

Defined results: a null text is an empty one, without spans; repeated rows give equal rows; spans that tie go by kind; a text of any length is
read whole, in time that grows with its length and n log n with its matches; each row gives one row; an empty table gives none; further
columns are ignored (redact keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group, least length of the group (fixed values).
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
BATTERY_ALPHA, FALSE_DISCOVERY = 0.001, 0.01
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = BASE62 + "+/"
#: Spans of a text above which redact() cuts it into characters.
MANY = 100
#: Pattern, alphabet, coincidence of characters in ordinary text that fits the pattern and the variance it has besides pair sampling
#: (4 / n of the next figure), and how often a letter or digit of such text begins a new run (see RUN): less often where there is one case. Text of hex letters and digits is mostly digits (1/10, even); other text has letters' frequencies.
ENCODINGS = [
    ("[0-9a-f]+(-[0-9a-f]+)*", HEX, 0.1, 0.0, 0.08),
    ("[0-9A-F]+(-[0-9A-F]+)*", HEX.upper(), 0.1, 0.0, 0.08),
    ("[A-Z2-7]+=*", BASE32, 0.06, 0.0012, 0.08),
    ("[A-Za-z0-9]+", BASE62, 0.06, 0.0012, 0.15),
    ("[^ ]+", BASE64, 0.06, 0.0012, 0.15),
]
#: Runs: digits, a lower-case word, or a word with capitals before it.
RUN = "[0-9]+|[A-Z]+[a-z]*|[a-z]+"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """SQL for array<struct<start, kind order, kind, end, body>> of one kind, by start."""
    p, order = _sql(pattern), [k for k, *_ in BASE].index(kind) if kind != "random" else len(BASE)
    empty = "cast(array() as array<struct<start:bigint,ord:int,kind:string,stop:bigint,body:string>>)"
    # where each match ends: running sums of the lengths of pieces and matches
    lengths = f"transform(arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0)), x -> cast(length(x.`0`) + coalesce(length(x.`1`), 0) as bigint))"
    rows = f"arrays_zip({_scan(lengths, 'a + b', '0L')}, regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {group}))"
    found = f"transform(filter({rows}, x -> length(x.`2`) >= {least}), x -> struct(x.`0` - length(x.`1`) as start, {order} as ord, '{kind}' as kind, x.`0` as stop, x.`1` as body))"
    return f"if(regexp_like(text, {p}), {found}, {empty})"


def _scan(array: str, both: str, nothing: str) -> str:
    """SQL for the running `both` (of a and b) over an array of long: log n rounds, in each of which an element takes in the one 2^r before."""
    return (
        f"element_at(transform(array({array}), z -> aggregate(sequence(0, cast(ceil(log2(greatest(size(z), 2))) as int) - 1), z,"
        f" (s, r) -> if(shiftleft(1, r) >= size(s), s, zip_with(s, concat(array_repeat({nothing}, shiftleft(1, r)), slice(s, 1, size(s) - shiftleft(1, r))), (a, b) -> {both})))), 1)"
    )


def _phi(z: str) -> str:
    """The normal distribution function (logistic form, error below 0.0002)."""
    return f"(1 / (1 + exp(-(1.5976 * ({z}) + 0.070566 * pow({z}, 3)))))"


def _token_stats() -> str:
    """SQL over the spans: of each token its length, encoding, characters and runs. Dashes of hex and padding do not count; `-_` are `+/`."""
    form = "case " + " ".join(f"when regexp_like(x.body, '^({pattern})$') then struct('{letters}' as letters, {null}D as null_c, {more}D as more, {rate}D as rate)" for pattern, letters, null, more, rate in ENCODINGS) + " end"
    bare = "if(length(y.form.letters) = 16, replace(y.x.body, '-', ''), translate(rtrim('=', y.x.body), '-_', '+/'))"
    return (
        f"transform(transform(transform(spans, x -> struct(x as x, {form} as form)),"
        f" y -> struct(y.x as x, y.form as form, if(length({bare}) >= 20, {bare}, y.x.body) as body)),"
        " y -> struct(y.x as span, y.body as body, length(y.body) as n, y.form.letters as letters, y.form.null_c as null_c, y.form.more as more, y.form.rate as rate, split(y.body, '') as chars,"
        f" length(regexp_replace(y.body, '[^A-Za-z0-9]', '')) as m, size(regexp_extract_all(regexp_replace(y.body, '[^A-Za-z0-9]', ''), '{RUN}', 0)) as starts))"
    )


def tokens_with_tests(spans: DataFrame) -> DataFrame:
    """Adds `tests`: for each token its span, length, p_text and p_random."""
    step = spans.withColumn("t", F.expr(_token_stats()))
    step = step.withColumn(
        "t",
        F.expr(
            "transform(t, x -> struct(x.span as span, x.null_c as null_c, x.more as more, x.rate as rate, x.m as m, x.starts as starts, x.n as n, if(length(x.letters) > 64, 64, length(x.letters)) as k,"
            " aggregate(transform(array_distinct(x.chars), c -> cast(x.n - length(replace(x.body, c, '')) as double)), 0D, (s, v) -> s + v * v) as squares,"
            " transform(x.chars, c -> cast(instr(x.letters, c) as double)) as v))"
        ),
    )
    step = step.withColumn(
        "t",
        F.expr(
            "transform(t, x -> struct(x.span as span, x.null_c as null_c, x.more as more, x.rate as rate, x.m as m, x.starts as starts, x.n as n, x.k as k, x.squares as squares,"
            " aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1), (a, b) -> if((a * 2 <= x.k) = (b * 2 <= x.k), 0D, 1D)), 1D, (s, y) -> s + y) as runs,"
            " aggregate(x.v, 0D, (s, y) -> s + if(y * 2 <= x.k, 1D, 0D)) as low,"
            " aggregate(zip_with(slice(x.v, 1, x.n - 1), slice(x.v, 2, x.n - 1), (a, b) -> (a - (x.k + 1) / 2D) * (b - (x.k + 1) / 2D)), 0D, (s, y) -> s + y) as lag,"
            " aggregate(x.v, 0D, (s, y) -> s + pow(y - (x.k + 1) / 2D, 2)) as spread))"
        ),
    )
    mean_runs = "(1 + 2 * x.low * (x.n - x.low) / x.n)"
    # chi squared by its own mean and variance under uniformity: k-1 and 2(k-1)(n-1)/n, which hold for short tokens too
    z_chi = "((x.k * x.squares / x.n - x.n) - (x.k - 1)) / sqrt(2D * (x.k - 1) * (x.n - 1) / x.n)"
    z_runs = f"(x.runs - {mean_runs}) / sqrt(greatest(({mean_runs} - 1) * ({mean_runs} - 2) / (x.n - 1), 0.25D))"
    z_lag = "x.lag / greatest(x.spread, 1D) * sqrt(x.n)"
    coincidence = "((x.squares - x.n) / (x.n * (x.n - 1D)))"
    z_coincidence = f"({coincidence} - x.null_c) / sqrt(2D * x.null_c * (1 - x.null_c) / (x.n * (x.n - 1D)) + 4 * x.more / x.n)"
    # half a switch is taken off for continuity
    z_switches = f"(x.starts - 1.5D - x.rate * (x.m - 1)) / sqrt(x.rate * (1 - x.rate) * greatest(x.m - 1, 1))"
    z_text = f"({z_coincidence} - {z_switches}) / sqrt(2D)"
    return step.withColumn(
        "tests",
        F.expr(
            f"transform(t, x -> struct(x.span as span, cast(x.n as double) as n, {_phi(f'least(greatest({z_text}, -6D), 6D)')} as p_text,"
            f" least(1D, 3 * least({_phi(f'-least(greatest({z_chi}, -6D), 6D)')}, 2 * {_phi(f'-least(abs({z_runs}), 6D)')}, 2 * {_phi(f'-least(abs({z_lag}), 6D)')})) as p_random))"
        ),
    ).drop("t")


def scan(docs: DataFrame, carry: str = "cast(doc_id as bigint)") -> DataFrame:
    """doc_id, base (spans of BASE) and found (all spans), each by start, then kind. `carry`: SQL for what doc_id is to hold."""
    df = docs.selectExpr(f"{carry} doc_id", "coalesce(cast(text as string), '') text")
    df = df.withColumn("base", F.expr("array_sort(concat(" + ", ".join(_spans(*b) for b in BASE) + "))"))
    df = df.withColumn("spans", F.expr(f"filter({_spans('random', TOKEN, 0, 20)}, x -> regexp_like(x.body, '[0-9]'))")).drop("text")
    df = tokens_with_tests(df)
    df = df.withColumn("mean_n", F.expr("aggregate(tests, 0D, (s, x) -> s + x.n) / greatest(size(tests), 1)"))
    df = df.withColumns({"bar": F.expr(_bar("p_text", FALSE_DISCOVERY)), "veto": F.expr(_bar("p_random", BATTERY_ALPHA))})
    kept = "transform(filter(tests, x -> x.p_text * mean_n / x.n <= bar and x.p_random * mean_n / x.n > veto), x -> x.span)"
    return df.select("doc_id", "base", F.expr(f"array_sort(concat(base, {kept}))").alias("found"))


def _bar(p: str, level: float) -> str:
    """Weighted Benjamini-Hochberg: q = p / weight, the weight growing with length; the largest i with q_i <= i / m * level sets the bar."""
    q = f"array_sort(transform(tests, x -> x.{p} * mean_n / x.n))"
    return f"element_at(transform(array({q}), q -> coalesce(array_max(transform(q, (v, i) -> if(v <= {level} * (i + 1) / size(q), v, -1D))), -1D)), 1)"


def _written(column: str) -> str:
    return f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"


def digests(docs: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in BASE]
    return scan(docs).select("doc_id", *counts, F.expr(f"sha2({_written('base')}, 256)").alias("base_sha256"), F.expr(_written("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every found span of its texts masked by one `*` for each character; null texts stay null, columns unchanged."""
    whole = "named_struct(" + ", ".join(f"'c{k}', `{c.replace('`', '``')}`" for k, c in enumerate(docs.columns)) + ")"
    at = docs.columns.index("text")
    text = f"doc_id.c{at}"
    # what each span masks begins no earlier than the furthest end before it; between both the text stays
    furthest = _scan("transform(found, x -> x.stop)", "greatest(a, b)", "0L")
    spans = f"transform(arrays_zip(found, concat(array(0L), {furthest})), y -> struct(y.found.start as start, y.found.stop as stop, y.`1` as before))"

    def masked(piece, rest):
        kept = piece.format(start="x.before", length="greatest(x.start - x.before, 0L)")
        parts = f"transform(filter(s, x -> x.start is not null), x -> concat({kept}, repeat('*', cast(greatest(x.stop - greatest(x.start, x.before), 0L) as int))))"
        return f"concat(array_join({parts}, ''), {rest})"

    last = "element_at(s, -1).before"
    few = masked(f"substring({text}, cast({{start}} + 1 as int), cast({{length}} as int))", f"substring({text}, cast({last} + 1 as int))")
    # a text with many spans is cut into characters once, as substring() counts from the text's beginning
    many = masked("array_join(slice(c, cast({start} + 1 as int), cast({length} as int)), '')", f"array_join(slice(c, cast({last} + 1 as int), size(c)), '')")
    many = f"element_at(transform(array(split({text}, '')), c -> {many}), 1)"
    fold = f"element_at(transform(array({spans}), s -> if(size(s) <= {MANY}, {few}, {many})), 1)"
    columns = [F.expr(f"if(size(found) = 0, doc_id.c{k}, {fold})" if k == at else f"doc_id.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return scan(docs, whole).select(*columns)
