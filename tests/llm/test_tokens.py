"""Tokens: BPE and packing against the tokenizers library, chat formatting as an exact round trip."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkfold.llm import bpe, chat, packing, queries, tokens
from tests.compare import assert_same, tables

SF = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "\n", "\t", "a", "the", "don't", "'s", " It", "é", "ß", "日本", "1", "23", "!!", "...", "<|endoftext|>", "<|", "　", "\xa0", "\x85", "\x1c", "​", "\x00", "😀", "aaaaaaaaaaaa", "\r\n", " \n", "x" * 70, "ab" * 90, "%%%"]


def texts(n=400, seed=1):
    r = random.Random(seed)
    return [None, "", *("".join(r.choices(PARTS, k=r.randint(0, 12))) for _ in range(n)), "q" * 5000, "word " * 4000]


def frame(spark, values):
    rows = [(i, t, 7) for i, t in enumerate(values)] + [(None, "null id", 7), (3, values[3], 7)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, ids int")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.BYTE_BPE)


def test_bpe(spark, library):
    rows, docs = frame(spark, texts())
    want = library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)
    decoded = library.decode_batch([x.ids for x in want], skip_special_tokens=False)
    got = bpe.decode(bpe.encode(docs, queries.BYTE_BPE), queries.BYTE_BPE).collect()
    assert sorted(str((r.doc_id, r.ids, r.text)) for r in got) == sorted(str((i, x.ids, d)) for (i, _, _), x, d in zip(rows, want, decoded, strict=True))


def test_bpe_digests(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op10_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("most", [0, 3, 50, 400_000])
def test_remembered_chunks(monkeypatch, library, most):
    """Ids are the library's, whatever a task has met before and has forgotten."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "REMEMBERED", most)
    encode, special = tokens.library_encoder(queries.BYTE_BPE)
    for seed in range(4):
        values = [t or "" for t in texts(60, seed)] + ["word " * 50, " a the  It"]
        ids, bounds = tokens.encode_texts(pa.array(values), encode, special)
        for text, a, b in zip(values, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_trees_agree():
    vocabulary = bpe.Vocabulary(queries.BYTE_BPE)
    r = random.Random(5)
    words = [bytes(r.choices(b"abcdehlorstn", k=r.randint(1, 64))) for _ in range(300)]
    ids, bounds = bpe.merge_words(words, vocabulary)
    for i, w in enumerate(words):
        one = bpe.merge_long(vocabulary.of_byte[np.frombuffer(w, np.uint8)].tolist(), vocabulary) if len(w) > 1 else [int(vocabulary.of_byte[w[0]])]
        assert ids[bounds[i] : bounds[i + 1]].tolist() == one


def test_plan_is_a_packing():
    r = random.Random(2)
    for _ in range(300):
        size = r.choice([10, 20, 64, 1024])
        counts = collections.Counter(r.randint(1, size) for _ in range(r.randint(0, 60)))
        plan = packing.plan(counts, size)
        used = collections.Counter()
        for lengths, n in plan:
            assert sum(lengths) <= size and n > 0
            used.update({x: k * n for x, k in collections.Counter(lengths).items()})
        assert used == counts
        assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(packing._Left(counts, size), size)) + 1


def optimum(lengths, size):
    """Fewest sequences, by exhaustive search."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= lengths[i]}.values():
            put(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, size - lengths[i]])

    put(0, [])
    return best


def test_reduction_keeps_an_optimum():
    r = random.Random(4)
    for _ in range(250):
        size = r.choice([10, 17, 30])
        lengths = sorted((r.randint(1, size) for _ in range(r.randint(1, 9))), reverse=True)
        left = packing._Left(collections.Counter(lengths), size)
        fixed = packing.reduce(left, size)
        rest = [x for x in range(size, 0, -1) for _ in range(left.counts[x])]
        assert sum(n for _, n in fixed) + optimum(rest, size) == optimum(lengths, size)


def test_reduction_goes_on_after_an_undecided_piece():
    """The 6 may go with 2 and 2, or with 3; the 5 after it is decided, as nothing but the other 5 fills it."""
    left = packing._Left({6: 1, 5: 2, 3: 1, 2: 2}, 10)
    fixed = packing.reduce(left, 10)
    assert ([5, 5], 1) in fixed
    assert left.counts[5] == 0


def test_packing(spark, library):
    rows, docs = frame(spark, texts(120) + ["word " * 3000])
    got = packing.pack(docs, queries.BYTE_BPE, ids=True).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids, pieces, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0, 0
        while at < len(ids):
            n = len(ids) % 1024 or 1024 if not at else 1024
            want[i, pieces, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, pieces = at + n, pieces + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(docs.limit(0), queries.BYTE_BPE).count() == 0


def test_escapes():
    template = chat.Template()
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choices(["<s>", "</s>", "[INST]", "[/INST]", "<", "\\", "s>", "[", "INST]", "/", "x"], k=r.randint(0, 8)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text and not any(m in escaped for m in template.marks)
    with pytest.raises(ValueError, match="mark"):
        chat.Template(begin="<a<b>")


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi <s> </s>", "z"), (1, 1, "assistant", "[INST] é\n", "z"), (1, 2, "assistant", None, "z"), (1, 2, None, "late", "z"), (2, 5, "assistant", "<|endoftext|>", "z"), (2, None, "system", "", "z"),
        (None, 0, "assistant", "x", "z"), (3, 0, "user", "same", "z"), (3, 0, "user", "same", "z"), (4, 0, "[/INST]", "<\\s>", "z"), (5, 0, "assistant", "long " * 5000, "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, mask string")
    formatted = chat.format_conversations(df, queries.BYTE_BPE)
    got = chat.read_back(formatted, queries.BYTE_BPE).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want, turn, last = [], 0, object()
    for conv, _, role, text, _ in sorted(rows, key=key):
        turn = turn + 1 if conv == last else 0
        last = conv
        want.append((conv, turn, role or "", text or "", (text or "") if role == "assistant" else ""))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    for r in formatted.collect():
        steps = np.diff([0, *r.mask, 0])
        assert (steps == 1).sum() <= 1 and len(r.ids) == len(r.mask) and all(i < 50257 for i, m in zip(r.ids, r.mask, strict=True) if m)


def test_chat_sql(spark):
    assert_same(queries.op1_chat_formatting(spark, SF), tables(SF), queries.OP1_SQL)
