"""Spelling variants, collocations and packing by concatenation, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkfold.llm import collocations, concatenation, queries, spelling
from tests.compare import assert_same, tables

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, lang string, text string, word string, n int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


# Spelling variants


def counted(rows, occurrences):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= occurrences}


def expected_variants(rows, occurrences=5):
    n = counted(rows, occurrences)
    out, forms = {}, {}
    for w in n:
        near = [x for x in n if abs(len(x) - len(w)) <= 1 and distance(x, w) == 1]
        form = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = form if form and n[form] >= 5 * n[w] else None
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n[w], out[w], n[forms[w]] if forms[w] else None))
    return rows


def got_variants(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return set(map(tuple, rows))


@pytest.mark.parametrize("seed", range(4))
def test_near_pairs(seed):
    r = random.Random(seed)
    for t in range(60):
        words = sorted({"".join(r.choices("ab" if t % 2 else "abcé", k=r.randint(0, 7))) for _ in range(r.randint(1, 40))})
        asking = words if t % 3 else r.sample(words, len(words) // 2)
        a, b = spelling.near_pairs(words, asking)
        found = [(asking[i], words[k]) for i, k in zip(a, b, strict=True)]
        assert sorted(found) == sorted((x, y) for x in asking for y in words if distance(x, y) == 1)


def spelt(n=400, seed=3):
    """Texts whose words have many neighbours, with a prefix that a third of them share."""
    r = random.Random(seed)
    stems = ["abcabc", "bcabca", "Überall", "internation", "ÀÉÿabc÷"]
    words = []
    for _ in range(120):
        w = list(r.choice(stems))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice("abcXé")
        words.append("".join(w))
    weights = [r.choice([1, 1, 6, 36, 216]) for _ in words]
    texts = [r.choice([" ", "-", "9", "日"]).join(r.choices(words, weights, k=r.randint(0, 60))) for _ in range(n)]
    return [None, "", "\x00", *texts, "abcabc " * 3000, "lantern " * 500 + "lanterns " * 60 + "lanternss " * 6]


@pytest.mark.parametrize("block", [4, 20_000])
def test_variants(spark, block):
    rows = [(i, None, t, "w", 1) for i, t in enumerate(spelt())] + [(None, None, "abcabd " * 40, "w", 1)] * 2
    df = spelling.variants(spark.createDataFrame(rows, DOCS), block=block)
    want = expected_variants([(r[0], r[2]) for r in rows])
    assert got_variants(df) == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got_variants(queries.op11_spelling_variants(spark, SF)) == expected_variants(map(tuple, docs))


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, None, "w", 1), (2, None, "short a", "w", 1)], DOCS)).count() == 0


def test_damaged_runs_are_words(spark):
    text = "withdrawal " * 5
    hit = next(i for i in range(10_000) if zlib.crc32(f"{i}:withdrawal".encode()) % 199 == 0)
    rows = got_variants(spelling.variants(spark.createDataFrame([(hit, None, text, "w", 1), (hit + 1, None, text * 5, "w", 1)], DOCS)))
    at = zlib.crc32(f"{hit}:withdrawal".encode()) % 10
    damaged = "withdrawal"[:at] + "withdrawal"[at + 1 :]
    assert rows == {("withdrawal", None, "withdrawal", 25, 1, None), (damaged, "withdrawal", "withdrawal", 5, 1, 25)}


# Collocations


def expected_collocations(rows, least, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        inside = [v for (x, y), v in f.items() if x == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y)))]
        if any(100 * v >= 80 * a for v in inside):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def phrased(seed=5, n=150):
    r = random.Random(seed)
    words = ["a", "b", "A", "été", "É", "日本", "x\x00y", "\xa0", "of", "b"]
    marks = [" ", "  ", "\t", " ", " ", ".", ", ", "\n", "\r\n", "\x0b", "; ", "!?", " | "]
    made = ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [None, "", " \t", "...", *made, "a b " * 3000, "of " * 500]


def collocation_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("size", [50, 8 << 20])
def test_collocations(spark, monkeypatch, size):
    monkeypatch.setattr(collocations, "SLICE", size)
    rows = [(i, ["en", "de", None, "und"][i % 4], t, "w", 1) for i, t in enumerate(phrased())] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found, _ = collocations.frequent_phrases(docs, 30)
    assert {r.n_words for r in found.collect()} == {1, 2, 3, 4}
    got = collocation_rows(collocations.collocations(docs))
    assert got == expected_collocations([(r[1], r[2]) for r in rows], 30)
    assert collocation_rows(collocations.collocations(docs, top=3)) == [r for r in got if r[1] <= 3]


@pytest.mark.parametrize("hashes", ["one", "few"])
def test_equal_fingerprints_are_told_apart(spark, hashes):
    """With hashes that say nothing, the texts alone decide."""

    class Weak(collocations.Slice):
        def prints(self, at, n):
            return super().prints(at, n) & np.uint64(0 if hashes == "one" else 7 << 61)

    own, collocations.Slice = collocations.Slice, Weak
    try:
        r = random.Random(1)
        words = [r.choices("abcd", k=40) for _ in range(30)]
        slice_ = Weak(["en"], [30 * 41], pa.array(["a", "b", "c", "d"]), pa.py_buffer(np.array([c for w in words for c in [*(ord(x) - 96 for x in w), 0]], "<u2").tobytes()))
        for n in range(1, 5):
            stands, times = slice_.phrases(slice_.starts(n), n)
            got = {tuple(slice_.codes[s : s + n].tolist()): int(k) for s, k in zip(stands, times, strict=True)}
            assert len(got) == len(stands)
            assert got == collections.Counter(tuple(ord(x) - 96 for x in w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    finally:
        collocations.Slice = own


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "w", 1), (None, "en", "", "w", 1)], DOCS)).count() == 0


def test_large_counts_are_exact(spark):
    big = 9_000_000_000_000_000_001
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 4)], "lang string, phrase string, n_words int, f bigint")
    assert [r.score for r in collocations.scored(found).collect()] == [2_000_000 * (big - 4) // (2 * big)]
    assert collocations.maximal(collocations.scored(found)).count() == 1


def test_collocations_same_as_sql(spark):
    assert_same(queries.op12_phrase_collocations(spark, SF), tables(SF), queries.OP12_SQL)


# Concatenate and cut


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.BYTE_BPE)


def texts():
    r = random.Random(4)
    return [None, "", "one", *(" ".join(r.choices(["it", "don't", "was", "été", "日本", "\n"], k=r.randint(0, 900))) for _ in range(60)), "word " * 9000]


@pytest.mark.parametrize("size", [1, 7, 64, 1024])
def test_pieces(spark, library, size):
    rows = [(i, "en", t, "w", 1) for i, t in enumerate(texts())] + [(None, "en", "no id", "w", 1), (3, "en", texts()[3], "w", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = concatenation.pieces(docs, queries.BYTE_BPE, size).collect()
    ids = {r[0]: [*library.encode(r[2] or "", add_special_tokens=False).ids, 0] for r in rows}
    total = sum(len(ids[r[0]]) for r in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.length > 0
        assert zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    times = collections.Counter(r[0] for r in rows)
    for doc_id, own in ids.items():
        at = [a + i for a, n in by_doc[doc_id] for i in range(n)]
        assert sorted(at) == sorted(list(range(len(own))) * times[doc_id])
    lengths = []
    for own in by_sequence.values():
        place = 0
        for offset, n in sorted(own):
            assert offset == place
            place += n
        lengths.append(place)
    rest = total % size
    assert sorted(lengths) == sorted([size] * (total // size) + [1 << i for i in range(10) if rest >> i & 1])
    sequences = {r.sequence_id: r.ids for r in concatenation.sequences(docs, queries.BYTE_BPE, size).collect()}
    assert {k: len(v) for k, v in sequences.items()} == {k: sum(n for _, n in v) for k, v in by_sequence.items()}
    for p in got:
        assert sequences[p.sequence_id][p.offset : p.offset + p.length] == ids[p.doc_id][p.start : p.start + p.length]


def test_part_starts(spark, monkeypatch):
    monkeypatch.setattr(concatenation, "BLOCK", 3)
    totals = [(i * 2, i % 5) for i in range(20)]
    got = {r.part: r.base for r in concatenation.part_starts(spark.createDataFrame(totals, "part int, n bigint")).collect()}
    assert got == {p: sum(n for q, n in totals if q < p) for p, _ in totals}


def test_pieces_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert concatenation.pieces(docs, queries.BYTE_BPE).count() == 0
    assert concatenation.sequences(docs, queries.BYTE_BPE).count() == 0


def test_pieces_of_documents(spark):
    got = queries.op13_concatenation_packing(spark, SF)
    n = got.groupBy("sequence_id").sum("length").collect()
    short = [r[1] for r in n if r[1] != 1024]
    assert sorted(short) == sorted(set(short)) and all(x & (x - 1) == 0 for x in short)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
