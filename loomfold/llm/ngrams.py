"""Operator 6, quality rules: base rules on words and lines, and n-gram perplexity bands.

A character model of order ORDER with modified Kneser-Ney smoothing for each language, counted by Spark over all
documents: tasks count n-grams of their rows, a shuffle adds counts, lower orders count the distinct characters before
an n-gram. N-grams are exact (four code points in two integers), and all tables of the model are Spark tables that grow with the
corpus: nothing is capped and no two n-grams share a count. As every document that is scored is counted too, the cost of each
distinct window of ORDER characters is worked out once, by joins of the orders. Up to BROADCAST_GRAMS windows, their 64-bit hashes
and costs are broadcast as sorted arrays; above it the documents' own windows are shuffled and joined with the table. A text's mean negative log probability per character is compared with
the band of its language: the interval of costs with the most right decisions on the labelled documents that pass the base rules (see
`best_band`). A language without labels of both kinds takes the interval of all labels together, as distances from its median. No band is
wider than the median plus or minus BAND times the distance from the median to the outer tenth, over all documents with words.

Defined results: a null text is an empty one, without words, and fails; a null language is a language of its own; each row
gives one row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfold.llm.common import durable, lean, plain, table

#: SQL that names a row by its content.
ROW = "md5(concat(coalesce(cast(doc_id as string), ''), ':', coalesce(cast(lang as string), ''), ':', coalesce(cast(text as string), '')))"
ORDER, BAND, FLOOR = 4, 8.0, 0.35
#: Windows whose costs may be broadcast (12 bytes each); above it the join shuffles.
BROADCAST_GRAMS = 4_000_000
#: The code point that stands before the start mark, and points that are handled at once.
PAD, STEP = 0x110000, 200_000
#: Points of a language that a task holds until it counts their windows.
HELD = 400_000
#: Width of the bins in which costs of labelled documents are counted.
BIN = 0.002
#: What the base rules reject.
FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), covered


def codes(text: str) -> np.ndarray:
    """Code points, white space runs as one space, after ORDER - 2 pads and a start mark."""
    points = np.frombuffer(("\x02" + " ".join(WORD.findall(text))).encode("utf-32-le"), np.uint32)
    return np.concatenate([np.full(ORDER - 2, PAD, np.uint64), points.astype(np.uint64)])


def pieces(points: np.ndarray):
    """Parts of bounded size that hold each window of ORDER points once."""
    for at in range(0, len(points) - ORDER + 1, STEP):
        yield points[at : at + STEP + ORDER - 1]


def packed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of four points: the first two in one integer, the last two in another."""
    pairs = (points[:-1] << np.uint64(21)) | points[1:]
    return pairs[:-2], pairs[2:]


def hashed(hi: np.ndarray, lo: np.ndarray, seed) -> np.ndarray:
    """64-bit hashes of packed windows; `seed` stands for the language."""
    h = (hi ^ (seed << np.uint64(32))) * MIX
    h ^= h >> np.uint64(32)
    h = (h ^ lo ^ seed) * MIX2
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def seed_of(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()))


def distinct_windows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi, lo and count of the distinct windows of all parts together; no window reaches from one part into the next."""
    points = np.concatenate(parts)
    alphabet = np.flatnonzero(np.bincount(points.astype(np.int64), minlength=1)).astype(np.uint64)
    if len(alphabet) > 1 << 16:
        return tuple(np.concatenate(x) for x in zip(*(distinct_windows([p[k : k + 60_003]]) for p in parts for k in range(0, len(p) - ORDER + 1, 60_000)), strict=True))
    place = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    place[alphabet.astype(np.int64)] = np.arange(len(alphabet), dtype=np.uint64)
    x = place[points.astype(np.int64)]
    pairs = (x[:-1] << np.uint64(16)) | x[1:]
    inside = np.ones(len(points), bool)
    for end in np.cumsum([len(p) for p in parts]):
        inside[max(end - ORDER + 1, 0) : end] = False
    keys, c = np.unique(((pairs[:-2] << np.uint64(32)) | pairs[2:])[inside[: len(points) - ORDER + 1]], return_counts=True)
    a, b, y, z = (alphabet[((keys >> np.uint64(k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in (48, 32, 16, 0))
    return (a << np.uint64(21)) | b, (y << np.uint64(21)) | z, c


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(f"{ROW} row", "cast(doc_id as long) doc_id", "coalesce(cast(lang as string), '') lang", "cast(text as string) text")


def counted(batches):
    """lang, hi, lo, c: the distinct windows of runs of texts of a language, with their counts."""
    parts, held = {}, Counter()

    def table_of(lang):
        hi, lo, c = distinct_windows(parts.pop(lang))
        held.pop(lang)
        arrays = [pa.repeat(pa.scalar(lang, pa.string()), len(hi)), *(pa.array(x.astype(np.int64)) for x in (hi, lo, c))]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "hi", "lo", "c"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in pieces(codes(plain(text))):
                parts.setdefault(lang, []).append(part)
                held[lang] += len(part)
                if held[lang] > HELD:
                    yield table_of(lang)
    for lang in list(parts):
        yield table_of(lang)


def windows(docs: DataFrame) -> DataFrame:
    """lang, hi, lo, c: the distinct windows of all documents with their counts, null where pads stand before the start mark."""
    rows = texts_of(docs).select("lang", "text").mapInArrow(lean(counted), "lang string, hi long, lo long, c long")
    return rows.groupBy("lang", "hi", "lo").agg(F.sum("c").alias("c")).withColumn("c", F.when(F.shiftright("hi", 21) != PAD, F.col("c")))


def costs(docs: DataFrame) -> DataFrame:
    """lang, hi, lo, cost: the negative log probability of the last character of each distinct window, given the others."""
    low = (1 << 21) - 1
    table = durable(windows(docs)).selectExpr("lang", *(f"{x} {a}" for a, x in zip("abyz", ("shiftright(hi, 21)", f"hi & {low}", "shiftright(lo, 21)", f"lo & {low}"), strict=True)), "c")
    levels = {ORDER: table}
    for n in range(ORDER - 1, 0, -1):
        seen = F.count("c")
        levels[n] = durable(levels[n + 1].groupBy("lang", *"abyz"[ORDER - n :]).agg(F.when(seen > 0, seen).alias("c")))
    counts = None
    for n, level in levels.items():
        part = level.agg(F.lit(n).alias("n"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
        counts = part if counts is None else counts.unionByName(part)
    cuts = {}
    for r in counts.collect():
        n1, n2, n3, n4 = (max(1.0, float(x)) for x in r[1:])
        y = n1 / (n1 + 2 * n2)
        cuts[r.n] = np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.1, 0.2, 0.3], [0.9, 1.8, 2.7]).tolist()
    types = [F.count_if(F.col("c") == k) for k in (1, 2)] + [F.count_if(F.col("c") >= 3)]
    below = None
    for n in range(1, ORDER + 1):
        cut = cuts[n]
        context = ["lang", *"abyz"[ORDER - n : ORDER - 1]]
        back = sum(F.lit(d) * t for d, t in zip(cut, types, strict=True))
        level = levels[n]
        if n == 1:
            # a few rows for each language; joined, so that no task takes a whole language
            level = level.join(F.broadcast(level.groupBy("lang").agg(F.sum("c").alias("total"), back.alias("back"))), "lang").withColumn("p", F.lit(1.0 / 50_000))
        else:
            w = Window.partitionBy(*context)
            held = sum(F.lit(d) * t.over(w) for d, t in zip(cut, types, strict=True))
            level = level.select("*", F.sum("c").over(w).alias("total"), held.alias("back")).join(below, ["lang", *"abyz"[ORDER - n + 1 :]])
        own = F.coalesce(F.col("c") - F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2]), F.lit(0.0))
        mixed = F.least((own + F.col("back") * F.col("p")) / F.col("total"), F.lit(1.0))
        below = level.select("lang", *"abyz"[ORDER - n :], F.when(F.col("total").isNull(), F.col("p")).otherwise(mixed).alias("p"))
    return below.selectExpr("lang", "shiftleft(a, 21) | b hi", "shiftleft(y, 21) | z lo", "-ln(greatest(p, 1e-12D)) cost")


class Lookup:
    """Sorted hashes with costs, entered by their leading bits."""

    def __init__(self, keys: np.ndarray, cost: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.cost = keys[order], cost[order]
        bits = max(1, min(28, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.start[(keys >> self.shift).astype(np.int64)]
        late = np.flatnonzero(self.keys[at] < keys)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] < keys[late]]
        return self.cost[at]

    def mean(self, text: str, lang: str) -> float:
        """Mean cost of a text's characters."""
        points = codes(text)
        n = len(points) - ORDER + 1
        return float(sum(self(hashed(*packed(p), seed_of(lang))).sum(dtype=np.float64) for p in pieces(points)) / n) if n > 0 else 0.0


def lookup(table: DataFrame) -> Lookup:
    @F.pandas_udf("long")
    def key(lang: pd.Series, hi: pd.Series, lo: pd.Series) -> pd.Series:
        seeds = lang.map({x: int(seed_of(x)) for x in lang.unique()}).to_numpy(np.uint64)
        return pd.Series(hashed(hi.to_numpy(np.uint64), lo.to_numpy(np.uint64), seeds).view(np.int64))

    got = table.select(key("lang", "hi", "lo").alias("key"), F.col("cost").cast("float")).toArrow()
    return Lookup(got["key"].to_numpy().view(np.uint64), got["cost"].to_numpy())


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame) -> DataFrame:
    """row, doc_id, lang, base columns and `cost` of each row."""
    table = durable(costs(docs))
    small = table.count() <= BROADCAST_GRAMS
    held = docs.sparkSession.sparkContext.broadcast(lookup(table) if small else None)

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(2).to_pylist(), [plain(t) for t in batch.column(3).to_pylist()]
            base = np.array([base_rules(t) for t in texts], np.int64).reshape(-1, len(BASE))
            cost = np.array([held.value.mean(t, a) for a, t in zip(langs, texts, strict=True)] if small else np.zeros(len(texts)), np.float64)
            arrays = [*batch.columns[:3], *(pa.array(np.ascontiguousarray(x)) for x in base.T), pa.array(cost)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "lang", *BASE, "cost"])

    rows = texts_of(docs).mapInArrow(lean(run), "row string, doc_id long, lang string, " + ", ".join(f"{c} long" for c in BASE) + ", cost double")
    if small:
        return rows
    own = texts_of(docs).mapInPandas(own_windows, "row string, lang string, hi long, lo long, c long").join(table, ["lang", "hi", "lo"])
    # equal rows count their windows twice on both sides of the division
    own = own.groupBy("row", "lang").agg((F.sum(F.col("c") * F.col("cost")) / F.sum("c")).alias("own"))
    return rows.join(own, ["row", "lang"], "left").withColumn("cost", F.coalesce("own", F.lit(0.0))).select("row", "doc_id", "lang", *BASE, "cost")


def own_windows(frames):
    """row, lang and the distinct windows of each text with their counts."""
    for f in frames:
        for row, lang, text in zip(f.row, f.lang, f.text, strict=True):
            for part in pieces(codes(plain(text))):
                hi, lo, c = distinct_windows([part])
                yield pd.DataFrame({"row": row, "lang": lang, "hi": hi.astype(np.int64), "lo": lo.astype(np.int64), "c": c})


def best_band(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Bounds of the run of bins (cost, clean, junk) with the most clean less junk documents, the longest of equal ones.

    A bound lies halfway to the next labelled cost outside; it is infinite where no junk lies beyond it.
    """
    bins = sorted(bins)
    best, first, last = (-1, -1), 0, len(bins) - 1
    run, start = 0, 0
    for i, (_, clean, junk) in enumerate(bins):
        if run < 0:
            run, start = 0, i
        run += clean - junk
        if (run, i - start) > best:
            best, first, last = (run, i - start), start, i
    low = (bins[first - 1][0] + bins[first][0]) / 2 if any(j for _, _, j in bins[:first]) else -math.inf
    high = (bins[last][0] + bins[last + 1][0]) / 2 if any(j for _, _, j in bins[last + 1 :]) else math.inf
    return low, high


def bands_of(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """lang, low, high. Labels that contradict each other count for neither side; costs are counted in bins, a bounded number for each language."""
    loose = rows.filter("n_words >= 50").groupBy("lang").agg(F.percentile_approx("cost", [0.1, 0.5, 0.9], 10_000).alias("q"))
    loose = durable(loose.selectExpr("lang", "q[1] middle", f"q[1] - greatest({BAND} * (q[1] - q[0]), {FLOOR}) low", f"q[1] + greatest({BAND} * (q[2] - q[1]), {FLOOR}) high"))
    if labels is None:
        return loose.drop("middle")
    told = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    passed = rows.filter(f"not {FAILED}").select("doc_id", "lang", "cost").join(told, "doc_id").join(F.broadcast(loose.select("lang", "middle")), "lang")
    bins = durable(passed.groupBy("lang", "middle", F.round(F.col("cost") / BIN).cast("long").alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("clean"), F.count_if(F.col("quality") == 0).alias("junk"))).collect()
    by, shifted = {}, Counter()
    for r in bins:
        by.setdefault(r.lang, []).append((r.bin * BIN, r.clean, r.junk))
        shifted[round((r.bin * BIN - r.middle) / BIN), 0] += r.clean
        shifted[round((r.bin * BIN - r.middle) / BIN), 1] += r.junk
    pooled = best_band([(k * BIN, shifted[k, 0], shifted[k, 1]) for k in {k for k, _ in shifted}]) if shifted else (-math.inf, math.inf)
    fitted = []
    for r in loose.collect():
        own = by.get(r.lang, [])
        both = sum(x[1] for x in own) and sum(x[2] for x in own)
        low, high = best_band(own) if both else (r.middle + pooled[0], r.middle + pooled[1])
        fitted.append((r.lang, max(low, r.low), min(high, r.high)))
    return rows.sparkSession.createDataFrame(fitted, "lang string, low double, high double")


def judge(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """`labels`: doc_id, quality (1 clean, 0 junk); without them the bands are the wide ones about the median."""
    rows = durable(scored(docs))
    rows = rows.join(F.broadcast(bands_of(rows, labels)), "lang", "left")
    inside = F.coalesce(F.col("cost").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(FAILED).alias("base_failed"), (~F.expr(FAILED) & inside).alias("kept"), "cost")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")
