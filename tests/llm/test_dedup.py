"""Exact, near and substring dedup against brute force, on rows with nulls, repeats, ties, long texts and clashing names."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from inkfold.llm import exact_dedup, queries, simhash, substring_dedup
from tests.compare import assert_same, tables

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Further columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, [2]) for i, t in rows], "doc_id bigint, text string, name string, level int, key array<int>")


def hard_rows(seed=1):
    r = random.Random(seed)
    words = ["a", "b", "été", "x" * 40, "日本", "A"]
    texts = [None, "", " ", "\t\n", "a", " a", "a ", "a  b", "a\tb", "a\x0b\x0cb", "a b", "é" * 5000, "é" * 5000, "é" * 4999, "b" * 6144, "b" * 6145]
    texts += [" ".join(r.choices(words, k=r.randint(1, 400))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:20])]
    return rows + [(3, "\t\n"), (4, "a"), (4, "other"), (None, "a b"), (None, "only"), (None, "only"), (-5, "a b")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block", [4, 2048])
def test_exact(spark, block):
    rows = hard_rows()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha, done = hashlib.sha256(t.encode()).hexdigest(), False
        for i in ids:
            kept = i == keep and not done
            done = done or kept
            want.append((i, keep, len(ids), kept, sha))
    got = [tuple(r) for r in exact_dedup.dedup(frame(spark, rows), block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_keeps_columns(spark):
    docs = frame(spark, hard_rows())
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t in hard_rows()})


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert exact_dedup.dedup(none).count() == simhash.near_dedup(none).count() == substring_dedup.substring_dedup(none).count() == 0


def brute_components(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_links_join_all_near_fingerprints(spark, bits):
    """Random ones, dense balls with far more members than are compared pairwise, and chains."""
    r = random.Random(bits)
    prints = {r.getrandbits(64) for _ in range(150)}
    for center in (0, r.getrandbits(64), (1 << 64) - 1):
        prints |= {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(220)}
        chain = center
        for _ in range(30):
            chain ^= 1 << r.randrange(64)
            prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = dict(map(tuple, simhash.roots(simhash.near_links(df, bits)).collect()))
    got, want = {}, {}
    for p, b in zip(signed, brute_components(prints, bits), strict=True):
        got.setdefault(roots.get(p, p), set()).add(p)
        want.setdefault(b, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_against_brute_force(spark):
    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, ""), (902, "Foo BAR"), (903, "foo bar"), (904, "ÉTÉ x y z"), (None, "foo bar")]
    prints = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    roots = brute_components(prints, 2)
    least = {}
    for root, (i, _) in zip(roots, rows, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    want = sorted(str((i, f"{p:016x}", least.get(root))) for (i, _), p, root in zip(rows, prints, roots, strict=True))
    got = simhash.near_dedup(frame(spark, rows)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(rows):
    """The smallest id that each id reaches through texts whose shingles have a Jaccard similarity of 0.8 or more, in whole numbers."""
    sets = [shingle_set(t) for _, t in rows]
    least = {i: i for i, _ in rows}
    pairs = []
    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                pairs.append((i, j))
    while True:
        before = dict(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return least


def edited(r, base, changes):
    words = base[:]
    for _ in range(changes):
        words[r.randrange(len(words))] = f"x{r.randrange(3000)}"
    return " ".join(words)


def test_similar_texts_are_found(spark):
    """Families of nearly equal texts as by brute force; texts that are less similar than 0.8 aren't linked."""
    r = random.Random(4)
    rows = [(900, None), (901, ""), (902, "Foo BAR"), (903, "foo bar"), (904, "a a a a a a a a"), (905, "a a a a a b")]
    for family in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(300)]
        rows += [(family * 10 + copy, edited(r, base, copy)) for copy in range(5)]
        rows += [(family * 10 + 5 + copy, edited(r, base, 12 + copy)) for copy in range(3)]
    want = brute_similar(rows)
    got = {x.doc_id: x.component_id for x in simhash.similar_dedup(frame(spark, rows)).collect()}
    assert got == want and got[901] == 900 and got[903] == 902 and got[905] == 905 and sum(i != low for i, low in got.items()) >= 48
    docs = frame(spark, [*rows, (None, rows[-1][1]), (0, rows[6][1])])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted([*set(want.values()), 0])


def test_similar_texts_in_hot_variants(spark):
    """A group with far more texts than are compared pairwise, beside others; no text is linked that brute force doesn't link."""
    r = random.Random(5)
    base = [f"w{n}" for n in range(200)]
    rows = [(i, edited(r, base, r.randrange(6))) for i in range(300)] + [(1000 + i, edited(r, base[::-1], 40)) for i in range(30)]
    want = brute_similar(rows)
    got = {x.doc_id: x.component_id for x in simhash.similar_dedup(frame(spark, rows)).collect()}
    assert all(want[low] == want[i] for i, low in got.items())
    gone, found = sum(i != low for i, low in want.items()), sum(i != low for i, low in got.items())
    assert gone >= 250 and found >= 0.98 * gone


def test_candidates_that_a_forest_leaves_out(spark):
    """Rows of one variant in three: the ends are candidates, but a forest has only their links with the nearer one between."""
    import numpy as np
    import pyarrow as pa

    fps = np.array([[0, 0], [(1 << 10) - 1, 0], [(1 << 20) - 1, 0]], np.int64)
    own = lambda label: pa.RecordBatch.from_arrays([pa.array([7] * 3, pa.int32()), pa.array([50] * 3, pa.int32()), pa.array(label, pa.int64()), *map(pa.array, fps.T)], names=["key", "size", "label", "f0", "f1"])
    pairs = lambda label: sorted(sorted((tuple(x["a"]), tuple(x["b"]))) for b in simhash._across(iter([own(label)])) for x in b.to_pylist())
    low, mid, high = map(tuple, fps.tolist())
    forest = [x for b in simhash._wide_links(iter([own([0] * 3).drop_columns(["label"])])) for x in b.to_pylist()]
    assert len(forest) == 2 and [low, high] not in [sorted((tuple(x["a"]), tuple(x["b"]))) for x in forest]
    assert pairs([0, 0, 0]) == [[low, mid], [low, high], [mid, high]] and pairs([0, 4, 0]) == pairs([0, 0, 0])
    assert pairs([4, 4, 0]) == [[low, high], [mid, high]] and pairs([4, 4, 4]) == []
    # The nearer one is another text: the ends are linked by the sweep alone.
    node = lambda f: list(f)
    sets = spark.createDataFrame([(node(low), [*range(100)]), (node(mid), [*range(500, 600)]), (node(high), [*range(95)])], "node array<bigint>, shingles array<bigint>")
    prints = spark.createDataFrame([(*map(int, f), 100, 0, 0, 0, 0) for f in (low, mid, high)], "f0 bigint, f1 bigint, size int, f2 bigint, f3 bigint, f4 bigint, f5 bigint")
    chosen = spark.createDataFrame([(x["a"], x["b"], x["apart"]) for x in forest], "a array<bigint>, b array<bigint>, apart int")
    links = simhash._verified(chosen, sets)
    assert links.count() == 0
    assert [tuple(r) for r in simhash._meeting(simhash._swept(prints, links), sets).collect()] == [(node(high), node(low))]


def exact_links(docs):
    """All pairs (later, earlier) of distinct sets of shingles at 0.8 or more: such pairs share one of their rarest shingles."""
    import collections

    sets, seen, times = {}, set(), collections.Counter()
    for doc_id, text in sorted(docs):
        own = frozenset(shingle_set(text))
        if own not in seen:
            seen.add(own)
            sets[doc_id] = own
            times.update(own)
    index, links = collections.defaultdict(list), []
    for doc_id, own in sets.items():
        rare = sorted(own, key=lambda x: (times[x], x))[: len(own) - -(-4 * len(own) // 5) + 1]
        for other in {e for x in rare for e in index[x]}:
            if 5 * len(own & sets[other]) >= 4 * len(own | sets[other]):
                links.append((doc_id, other))
        for x in rare:
            index[x].append(doc_id)
    return links


def test_recall_of_similar_texts(spark):
    """Over all documents of the largest table: at least 0.95 of the links and of the later texts, and no text joined that the links don't join."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.similar_dedup(docs).select("doc_id", "component_id").collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    links = exact_links(texts)
    assert len(links) >= 40
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    later = {a for a, _ in links}
    assert sum(got[a] != a for a in later) >= 0.95 * len(later)
    linked = later | {b for _, b in links}
    by_set = {}
    for doc_id, text in sorted(texts):
        first = by_set.setdefault(frozenset(shingle_set(text)), doc_id)
        assert first in linked or got[doc_id] == first


@pytest.mark.parametrize("texts", [3, 1000])
def test_clusters_join_all_similar_sets(spark, texts):
    """A chain of candidates in blocks of 3 or in one: sets are joined as by brute force, whether they are candidates or not, and no others."""
    r = random.Random(6)
    sets = [sorted(r.sample(range(60), 40)) for _ in range(15)]
    sets += [sorted({*s[:37], 100 + i}) for i, s in enumerate(sets[:10])] + [sorted(s[i % 3 :]) for i, s in enumerate(sets[:12])] + [[], [7]]
    n = len(sets)
    pairs = spark.createDataFrame([([i + 1, 0], [i, 0]) for i in range(n - 1)], "a array<bigint>, b array<bigint>")
    rows = spark.createDataFrame([([i, 0], s) for i, s in enumerate(sets)], "node array<bigint>, shingles array<bigint>")
    got = [(x["a"][0], x["b"][0]) for x in simhash._clustered(pairs, rows, texts=texts).collect()]
    similar = [(i, j) for i in range(n) for j in range(i) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})]

    def joined(links):
        least = list(range(n))
        for _ in range(n):
            for i, j in links:
                least[i] = least[j] = min(least[i], least[j])
        return least

    assert joined(got) == joined(similar) != list(range(n))
    assert all((max(x), min(x)) in similar for x in got) and len(got) <= 3 * n


def test_contracted_roots(spark):
    r = random.Random(7)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(260)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert sorted(simhash._contracted_roots(df).collect()) == sorted(simhash.roots(df).collect())


def test_similar_makes_no_rows_of_pairs(spark, monkeypatch):
    """Verification by pairs, in rounds or a sweep, isn't used."""
    for name in ("_verified", "_swept", "_meeting"):
        monkeypatch.setattr(simhash, name, None)
    base = [f"w{n}" for n in range(100)]
    rows = [(i, " ".join([*base[:i], "x", *base[i:]])) for i in range(0, 100, 9)]
    assert {x.component_id for x in simhash.similar_dedup(frame(spark, rows)).collect()} == {0}


def test_similar_empty(spark):
    assert simhash.similar_dedup(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_nearest_is_a_least_forest(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    a, b, apart = r.integers(0, 30, 60), r.integers(0, 30, 60), r.integers(0, 9, 60)
    tree, cost, links = list(range(30)), 0, 0
    for w, x, y in sorted(zip(apart.tolist(), a.tolist(), b.tolist(), strict=True)):
        if tree[x] != tree[y]:
            old, new = tree[x], tree[y]
            tree = [new if t == old else t for t in tree]
            cost, links = cost + w, links + 1
    at = simhash._nearest(a, b, apart, 30)
    assert len(at) == links and apart[at].sum() == cost


def brute_cut(rows, window):
    """Distinct (doc_id, text) rows in order; every row gets its own result."""
    order = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in order:
        words, gone = t.encode().split(), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i, t] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return sorted(str((i, *out[2**63 - 1 if i is None else i, t or ""])) for i, t in rows)


@pytest.mark.parametrize(("window", "anchor", "hot", "held", "hot_rows"), [(20, 8, 256, 1 << 18, 256), (20, 8, 2, 1 << 18, 2), (5, 2, 1, 3, 2), (6, 6, 256, 2, 3), (3, 1, 4, 5, 1), (3, 1, 4, 5, 999)])
def test_substrings(spark, window, anchor, hot, held, hot_rows):
    """Few words make many repeats within and across documents; low limits send anchors to the split of hot ones."""
    r = random.Random(window + hot)
    passages = [[f"w{r.randrange(60)}" for _ in range(r.randint(15, 70))] for _ in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            words += p[r.randrange(5) : len(p) - r.randrange(5)] if r.random() < 0.6 else [f"w{r.randrange(60)}" for _ in range(r.randint(1, 30))]
        rows.append((i, " ".join(words)))
    rows += [(70, "x y " * 300), (71, "x y " * 100), (72, "z " * 90), (73, None), (74, ""), (75, " \t "), (5, rows[5][1]), (None, rows[6][1]), (None, "y x " * 40), (-1, rows[7][1])]

    got = substring_dedup.substring_dedup(frame(spark, rows), window, anchor=anchor, hot=hot, held_rows=held, hot_rows=hot_rows).collect()
    assert sorted(str(tuple(x)) for x in got) == brute_cut(rows, window)


def test_substrings_keep_columns(spark):
    docs = frame(spark, [(1, "a  b"), (2, " ".join(map(str, range(30)))), (3, "q " + " ".join(map(str, range(30))))])
    got = {r.doc_id: r for r in substring_dedup.cut_documents(docs).collect()}
    assert substring_dedup.cut_documents(docs).columns == docs.columns
    assert got[1].text == "a  b" and got[3].text == "q" and got[3].key == [2]


def test_suffix_automaton():
    r = random.Random(3)
    shard, texts = substring_dedup.SuffixAutomaton(), []
    for _ in range(60):
        words = [r.choice("abc").encode() for _ in range(r.randint(0, 25))]
        lengths = shard.statistics(words)
        for i, n in enumerate(lengths):
            best = max(k for k in range(i + 2) if k == 0 or any(words[i + 1 - k : i + 1] == t[j : j + k] for t in texts for j in range(len(t) - k + 1)))
            assert n == best
        shard.add(words)
        texts.append(words)


def test_sql(spark):
    con = tables(SF)
    assert_same(queries.op2_exact_dedup(spark, SF), con, queries.OP2_SQL)
    assert_same(queries.op7_substring_dedup(spark, SF), con, queries.OP7_SQL)
