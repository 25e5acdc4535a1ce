"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from importlib import metadata
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomfold.llm import bpe, chat, classifier, common, lattice, licenses, minhash, ngrams, packing, secrets, transducer
from loomfold.llm.common import encoder

SHAPE = "doc_id long, text string, lang string, node string, score double, spans string, n long"
KEY = "password = 'abcdefgh12345'"
TEXTS = [None, "", " \n ", "one", "it's  the 2nd <|endoftext|> day\n\n don't", f"a {KEY} b AKIAABCDEFGHIJKL \U0001f600 {'0a' * 20} password: token: abcdefgh1", "x" * 5000, "word " * 3000,
         "".join(f"w{i} " for i in range(400)), "".join(f"w{i} " for i in range(402)), "".join(f"w{i} " for i in range(402))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", "n", 0.5, "s", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "a b c", "en", None, None, None, None)], SHAPE)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(docs, none, library):
    pieces = packing.pack(docs.dropDuplicates(["doc_id"])).collect()
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        at = 0
        for start, length, crc in mine:
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_packing_repeats_padding_and_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("word" for _ in range(int(rng.integers(1, 1500))))) for i in range(120)]
    rows += rows[:10] * 2
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    per = Counter()
    for p in pieces:
        per[p.doc_id] += p.length
    one = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(per[i] == one[i] * (3 if i < 10 else 1) for i in range(120))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, [p.tier, p.step_group, 0])[2] += p.length
    padding = sum(1 << (n - 1).bit_length() for _, _, n in sequences.values()) - sum(n for _, _, n in sequences.values())
    assert padding == 0 and all(n <= tier or n & (n - 1) == 0 for tier, _, n in sequences.values())
    groups = {}
    for _, group, n in sequences.values():
        groups.setdefault(group, []).append(n * n)
    full = [sum(x) for x in groups.values() if len(x) == max(map(len, groups.values()))]
    assert max(full) <= 1.5 * min(full)


def test_secrets(docs, none):
    got = secrets.digests(docs).collect()
    assert len(got) == docs.count()
    text = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "a b c"}
    for r in got:
        spans = []
        for order, (kind, pattern, group, least) in enumerate(secrets.BASE):
            spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text[r.doc_id]) if len(m[group]) >= least]
        written = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and secrets.digests(none).count() == 0
    by = {r.doc_id: r.text for r in masked.collect()}
    assert by[0] is None and "abcdefgh12345" not in by[5] and len(by[5]) == len(TEXTS[5]) and by[4] == TEXTS[4]


def test_secrets_of_every_encoding(spark):
    draw = np.random.default_rng(11).choice
    low, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = {"HEX": (low.upper(), 32, 0.9), "uuid": (low, 32, 0.9), "hex": (low, 24, 0.85), "base32": (upper + "234567", 32, 0.75), "base62": (upper + upper.lower() + low[:10], 24, 0.85)}
    rows = [(k, "".join(draw(list(letters), n))) for k, (letters, n, _) in kinds.items() for _ in range(100)]
    rows = [(k, "-".join((t[:8], t[8:12], t[12:16], t[16:20], t[20:])) if k == "uuid" else t) for k, t in rows if re.search("[0-9]", t)]
    rows += [("text", t) for t in ("chapter-section-release-2024", "SUMMARY_NETWORK_UPDATE_42", "2024-01-12-garden-market", "202401120000123456789", "PersonHistoryLanguage7", "=" * 20 + "1")]
    got = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    for k, (_, _, least) in kinds.items():
        own = [got[i] == f"random:0:{len(t)}" for i, (x, t) in enumerate(rows) if x == k]
        assert np.mean(own) >= least, k
    assert not any(got[i] for i, (k, _) in enumerate(rows) if k == "text")


def shingle_groups(texts):
    """Set sizes and least position of the component of each text, by brute force."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [len(x) for x in sets], root


def test_minhash(docs, none):
    got = {r.doc_id: r for r in minhash.link(docs).collect()}
    assert got[10].component_id == got[9].component_id == got[8].component_id == 8
    assert got[0].n_shingles == got[2].n_shingles == 0 and got[0].kept and got[1].component_id == 1
    assert got[3].n_shingles == 1 and got[7].n_shingles == 1 and got[None].kept
    assert minhash.link(none).count() == 0


def test_minhash_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(12):  # families whose members drift away from each other, so that no one text is near to all
        own = list(rng.choice(words, 120))
        for _ in range(14):
            texts.append(" ".join(own))
            for at in rng.integers(0, 120, rng.integers(1, 4)):
                own[at] = str(rng.choice(words))
    texts += ["A b c", "a B c", "a b", None, "", texts[0], texts[0].upper()]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sizes, root = shingle_groups(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for agree, block in ((minhash.AGREE, 512), (minhash.AGREE, 2)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: r for r in minhash.link(df).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert [got[i].component_id for i in range(len(texts))] == root
        assert [got[i].kept for i in range(len(texts))] == [root[i] == i for i in range(len(texts))]


def test_minhash_texts_that_share_an_id(spark):
    long = " ".join(f"x{k}" for k in range(60))
    rows = [(5, long), (5, "quite another text of words"), (6, long), (None, "quite another text of words"), (None, "alone here with some words"), (None, "alone here with some words")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 56, 5, True), (5, 1, 5, True), (6, 56, 5, False), (None, 1, 5, True), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = minhash.sketch(x[:350], 512), minhash.sketch(x[50:], 512)
    assert abs((a == b).mean() - 0.75) < 0.08
    assert len(minhash.sketch(x[:1])) == minhash.WIDTH
    assert (minhash.coordinates(minhash.packed(a[: minhash.WIDTH])) == a[: minhash.WIDTH]).all()


HOSTILE = ["", "plain", "~<|turn|user|>", "</s>[INST] ok [/INST]", "~1~0||<<", "a\n<|end|>", "<|end|><|turn|0|user|>x<|end|>", "<|end", "<|end|", "x<", "|>", "~", "~0<|end|>~1", "\U0001f600<|end|>\u00e9"]


@pytest.mark.parametrize("text", HOSTILE)
def test_chat_round_trip(text):
    turns = [("user", text), (f"a{text}b", text), ("assistant", text), (text, "z")]
    formatted, mask = chat.render(turns)
    assert [t[:2] for t in chat.parse(formatted)] == turns
    assert len(mask) == 1 + (text == "assistant")
    start, stop = mask[0]
    assert [t for t in chat.parse(formatted) if t[3:5] == (start, stop)][0][1] == text
    with pytest.raises(ValueError):
        chat.parse(formatted + "x")


def test_chat_escapes_only_what_conflicts():
    assert chat.render_turn("user", "1 < 2 | 3 ~ <|turn|")[0] == "<|turn|0|user|>1 < 2 | 3 ~ <|turn|<|end|>"
    assert chat.render_turn("user", "<|end|>")[0] == "<|turn|1|user|>~1end~2<|end|>"


def chat_digest(turns):
    every = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark):
    shape = "conv_id long, turn long, role string, text string, formatted string, dealt long"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (None, 0, None, "x"), (2, 0, "user", "z" * 300_000), (2, 1, "assistant", "<|end|>" * 10), (2, 1, "assistant", "a tie"), (2, 1, "assistant", "a tie")]
    rows += [(3, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(HOSTILE)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], shape).repartition(5)
    got = {}
    for r in chat.digests(df).collect():
        got.setdefault(r.conv_id, []).append((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256))
    for conv in (1, 2, 3):
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv] == [chat_digest([(r, x) for _, r, x in own])]
    assert got[None] == [chat_digest([("", "x")])] * 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_contract(spark):
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    own = chat_digest([("user", chat.TEST_TEXT), ("assistant", chat.TEST_TEXT)])
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars, got[-1].loss_sha256) == own
    by = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(by) | {-1} == set(got)
    for conv, turns in by.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == chat_digest([x[1:] for x in sorted(turns)])


def cosine_links(rows):
    """vec_id positions by (other positions with cosine 0.93 or more of the same label), by brute force."""
    out = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and v and w and len(v) == len(w) and np.isfinite(v).all() and np.isfinite(w).all() and any(v) and any(w):
                if np.dot(v, w) >= 0.93 * np.linalg.norm(v) * np.linalg.norm(w):
                    out[i].add(j)
                    out[j].add(i)
    return out


def test_lattice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    near = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:3], base[:1] + 0.02 * rng.standard_normal((150, 16))])
    rows = [(i, v.tolist(), 1 + (i % 40) % 2 if i < 63 else 1) for i, v in enumerate(near)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, near[0].tolist(), None), (304, [], 1), (305, near[0][:8].tolist(), 1), (None, near[5].tolist(), 2), (7, near[30].tolist(), 1), (9, near[9].tolist(), 2)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, embedding array<double>, label int, node int, body string")
    true = cosine_links([(i, v, a) for i, v, a in rows])
    for block in (lattice.BLOCK, 16):  # blocks split the large group
        monkeypatch.setattr(lattice, "BLOCK", block)
        got = lattice.link(df).collect()
        assert len(got) == len(rows)
        mine = sum(r.n_links for r in got)
        every = sum(map(len, true))
        assert 0.97 * every <= mine <= every
        by = {}
        for r in got:
            by.setdefault(r.vec_id, []).append(r)
        assert all(len(by[i]) == 1 and by[i][0].n_links == 0 and by[i][0].kept and by[i][0].component_id == i for i in range(300, 306))
        for i in range(63, 213):  # the large group, with the vector that it copies
            assert by[i][0].n_links <= len(true[i]) and by[i][0].component_id == 0 and not by[i][0].kept
        assert by[None][0].component_id == 5 and by[None][0].kept and len(by[9]) == 2 and all(r.n_links >= 1 and r.kept for r in by[9])
    assert lattice.link(df.limit(0)).count() == 0


def test_lattice_counts_pairs_once(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3, 64))[rng.integers(0, 3, 400)] + 0.02 * rng.standard_normal((400, 64))
    rows = [(i, [float(np.float32(x)) for x in w], 1) for i, w in enumerate(v)]
    got = {r.vec_id: r for r in lattice.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    true = cosine_links(rows)
    assert all(got[i].n_links <= len(true[i]) for i in range(400)) and sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, true))
    assert len({r.component_id for r in got.values()}) == 3 and sum(r.kept for r in got.values()) == 3


def test_e8_nearest():
    x = np.random.default_rng(5).standard_normal((200, 8)) * 2
    p = lattice.e8(x)
    own = ((x - p) ** 2).sum(1)
    for v in lattice.STEPS:
        assert (own <= ((x - p - v) ** 2).sum(1) + 1e-9).all()
    assert len(lattice.STEPS) == 240


def test_rules(docs, none):
    got = {r.doc_id: r for r in ngrams.judge(docs).collect()}
    assert got[0].base_failed and not got[0].kept and got[7].n_repeat_words == 3000 and got[7].base_failed
    assert got[8].n_words == 400 and not got[8].base_failed
    assert ngrams.base_rules("a\na\n\nb # c") == (5, 5, 1, 1, 0)
    assert ngrams.judge(none).count() == 0


def test_bands_reject_labelled_junk(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("aeiounrst"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(40)] + [" ".join("".join(rng.choice(list("aeiounrstxyz"), 5)) for _ in range(120)) for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(44)] + [(5, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in ngrams.judge(docs, labels).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 46))


def test_best_band():
    assert ngrams.best_band([(1.0, 0, 3), (2.0, 5, 0), (3.0, 1, 1), (4.0, 2, 0), (5.0, 0, 1)]) == (1.5, 4.5)
    assert ngrams.best_band([(1.0, 4, 0), (2.0, 5, 0), (3.0, 1, 2)]) == (-np.inf, 2.5)


def brute_cost(texts, text):
    """Mean cost of a text under the model of `texts`, by the formula, on dictionaries."""
    levels = {4: Counter(x[i : i + 4] for x in texts for i in range(len(x) - 3))}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 50_000
        level = levels[n]
        n1, n2, n3, n4 = (max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.1, 0.2, 0.3], [0.9, 1.8, 2.7])]
        after = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        c = level[gram]
        return min(1, (c - cut[min(c, 3)] + sum(cut[min(x, 3)] for x in after) * p(gram[1:])) / sum(after))

    return np.mean([-np.log(max(p(text[max(0, i - 3) : i + 1]), 1e-12)) for i in range(1, len(text))])


def test_model_is_exact_by_both_ways(spark, monkeypatch):
    texts = ["abracadabra abra", "a cadabra", "x", "ab", "\U0001f600 abra \u4e00\u4e01", "abracadabra abra"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(10, "", "en"), (11, None, "en")], "doc_id long, text string, lang string")
    marked = ["\x02" + t for t in texts]
    for limit in (ngrams.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(ngrams, "BROADCAST_GRAMS", limit)
        got = {r.doc_id: r.cost for r in ngrams.scored(docs).collect()}
        assert all(abs(got[i] - brute_cost(marked, t)) < 1e-5 for i, t in enumerate(marked))
        assert got[10] == got[11] == 0


def test_every_ngram_has_its_own_count(spark):
    # more distinct n-grams than the 2^21 slots that orders once had
    points = np.random.default_rng(2).integers(0x4E00, 0x9FA0, (600, 4000)).astype(np.uint32)
    docs = spark.createDataFrame([(i, bytes(p).decode("utf-32-le"), "zh") for i, p in enumerate(points)], "doc_id long, text string, lang string")
    points = np.insert(points, 0, 2, 1)
    assert ngrams.windows(docs).filter("c is not null").count() == len(np.unique(np.lib.stride_tricks.sliding_window_view(points, 4, 1).reshape(-1, 4), axis=0)) > 1 << 21


def test_licenses(docs, spark):
    text = "Copyright (c) 2020 A\n" + licenses.LICENSES["MIT"].upper().replace(",", " ;")
    got = licenses.scan(spark.createDataFrame([(1, text), (2, None), (3, "mit")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {1: "MIT", 2: None, 3: None}


def test_license_rows(docs, none, spark):
    body = licenses.LICENSES["MIT"]
    shape = "doc_id long, text string, license string, digest string, body string"
    rows = [(1, body), (1, body), (2, ""), (3, None), (4, " \n"), (None, body), (5, body + " x" * 100_000), (6, "x" * 300_000)]
    got = licenses.scan(spark.createDataFrame([(*r, "l", "d", "b") for r in rows], shape)).collect()
    assert sorted(((r.doc_id, r.license) for r in got), key=str) == sorted([(1, "MIT"), (1, "MIT"), (2, None), (3, None), (4, None), (None, "MIT"), (5, None), (6, None)], key=str)
    assert licenses.scan(none).count() == 0
    every = [(i, f"{title}\n\nCopyright (c) 2021 Some Body\n\n{(licenses.TEXTS / f'{name}.txt').read_text()}", name) for i, (name, title) in enumerate([("MIT-0", "MIT No Attribution"), ("0BSD", "BSD Zero Clause License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003")])]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame([x[:2] for x in every], "doc_id long, text string")).collect()}
    assert got == {i: name for i, _, name in every}


def test_license_files(spark):
    mit, isc = licenses.LICENSES["MIT"], licenses.LICENSES["ISC"]
    cases = [(f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{mit}", "MIT"), (f"The MIT License (MIT)\n\nCopyright (c) Acme Inc. 2025 to present\n\n{mit}", "MIT"), (f"Copyright 2018-2026 Acme\n{mit}", "MIT"),
             (f"MIT License Copyright (c) 2020 Jane Doe {mit}", "MIT"), (f"ISC License\n\nCopyright Jane Doe <jane@example.org>\n\n{isc}", "ISC"), (f"(c) 2020 A. All rights reserved. {isc}", "ISC"),
             (mit.replace("The above copyright", "The above\ncopyright"), "MIT"), (f"Copyright (c) 2020 A. {mit} And no more.", None), (mit[:-200], None)]
    folder = metadata.distribution("pyspark").locate_file("")
    for name, pattern in {"MIT": "tiktoken*/**/LICENSE", "BSD-3-Clause": "psutil*/**/LICENSE", "BSD-2-Clause": "pygments*/**/LICENSE", "Apache-2.0": "requests*/**/LICENSE"}.items():
        cases += [(f.read_text(), name) for f in Path(folder).glob(pattern)]
    for name, file in {"GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "BSD-3-Clause": "BSD", "Apache-2.0": "Apache-2.0"}.items():
        cases += [(f.read_text(), name) for f in Path("/usr/share/common-licenses").glob(file)]
    cases += [(cases[-1][0].partition("APPENDIX")[0], "Apache-2.0")] if cases[-1][1] == "Apache-2.0" else []
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert got == {i: name for i, (_, name) in enumerate(cases)}


def test_token_counts(docs, none, library):
    for r in transducer.count_tokens(docs).collect():
        t = "a b c" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.n_bytes == len(t.encode())
        assert r.n_tokens == len(library.encode(t, add_special_tokens=False).ids)
    assert transducer.count_tokens(none).count() == 0


def test_bpe(docs, none):
    enc = encoder()
    for r in bpe.digests(docs).collect():
        t = "a b c" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.digests(none).count() == 0


def test_transducer_agrees_with_the_merges(library):
    machine = transducer.machine()
    rng = np.random.default_rng(6)
    tokens = [t for t in machine.words if len(machine.words[t]) < 9]
    for a, b in rng.choice(tokens, (3000, 2)).tolist():
        assert machine.agree(a, b) == (bpe.merge(machine.words[a] + machine.words[b], machine.ranks) == [a, b])
    texts = ["".join(rng.choice(list("aeintrshl  \n'0123\u00e9\u00df\u4e2d\u6587\U0001f600_-=\t"), int(rng.integers(0, 300)))) for _ in range(200)] + [" " * 300 + "a", "a" * 999, "=-" * 400, "\u3000 a", "it's we'll I'd"]
    for limit in (transducer.STATES, 50):  # a small table is emptied again and again
        transducer.STATES, before = limit, transducer.STATES
        counter = transducer.Counter()
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        transducer.STATES = before


def test_classifier_learns_and_ignores_other_columns(spark):
    from invented_words import clean_texts, junk_texts

    texts = clean_texts(80) + junk_texts(80)
    rows = [(i, t, "en" if i < 80 else "fr", f"s{i}", i, 0.1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, held_out long, score double")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.classify(df, labels).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [got[i].held_out for i in range(160)] == [i in held for i in range(160)] and len(held) > 20
    assert np.mean([got[i].predicted == (i < 80) for i in held]) >= 0.95 and all(got[i].predicted == (got[i].score >= 0.7) for i in got)
    # labels of held-out rows change nothing, nor do other columns and repeated rows
    other = spark.createDataFrame([(i, int(i < 80) if i not in held else int(i >= 80), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in classifier.classify(df.withColumnRenamed("lang", "l").repartition(7).union(df.withColumnRenamed("lang", "l").limit(3)), other).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-12 for i in got)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    y = np.array([1.0 if (x < 20).mean() > 0.5 else -1.0 for x in rows])
    w, ratio = classifier.fit_svm(rows, y)
    share = {1.0: (y < 0).mean(), -1.0: (y > 0).mean()}
    scaled = np.zeros((60, 40))
    for i, x in enumerate(rows):
        v = ratio[x] / max(1.0, np.linalg.norm(ratio[x]))
        scaled[i, x] = v

    def loss(u):
        return 0.5 * u @ u + sum(classifier.PENALTY * 20 * share[t] * max(0, 1 - t * (v @ u[:-1] + u[-1])) for v, t in zip(scaled, y, strict=True))

    best = np.append(w[:40], w[-1])
    for _ in range(400):  # no direction goes down by much
        assert loss(best + 0.05 * rng.standard_normal(41)) >= loss(best) - 0.02


def test_classifier(docs, spark, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(none, labels).count() == 0


def test_tasks_take_batches_in_slices():
    batch = pa.RecordBatch.from_pydict({"text": ["x"] * 5000})
    seen = []
    rows = list(common.lean(lambda batches: (b for b in batches if seen.append(b.num_rows) is None))([batch]))
    assert max(seen) <= common.SLICE and sum(r.num_rows for r in rows) == 5000


def test_windows_are_counted_in_bounded_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 5000))) for _ in range(120)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 60, "text": texts})]
    tracemalloc.start()
    got = Counter()
    for b in ngrams.counted(batches):
        for lang, n in zip(b["lang"].to_pylist(), b["c"].to_pylist(), strict=True):
            got[lang] += n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {lang: got[lang] for lang in ("en", "de")} == {lang: sum(len(ngrams.codes(t)) - 3 for t in texts[k::2]) for k, lang in enumerate(("en", "de"))}
    assert peak < 50 << 20
