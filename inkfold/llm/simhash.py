"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits that differ in at most k bits: cut into k // 2 + 1 segments, at least one segment differs by at
most one bit. Each segment is indexed under its variants with one bit left out, so that two such segments share a
variant; rows meet by an equality of variants and are verified on the whole fingerprint. For even k the last segment
needs no variants: if all the others differ by two bits, it is equal.

The index holds distinct fingerprints, so copies never meet pairwise. What shares a variant is linked by a spanning
forest, not by all its pairs: a variant adds fewer links than it has rows, however dense a group is.

Fingerprints of 64 bits find copies with small changes. For a similarity of 0.8, similar_dedup takes several fingerprints
of independent hashes, each in three segments, indexes each segment under variants without two neighbouring bits, and
verifies them by the Jaccard similarity of the texts' shingles. Each variant gives a forest of its candidates; what all forests
join is a cluster, in which every candidate has both its ends. A cluster's sets of shingles meet in blocks of bounded size, so
that all its pairs are compared, but none is a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, partitions, slices, texts_of, tune
from inkfold.operators.connected import roots

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: For texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints that are indexed, and the first of them, by which candidates are compared.
PRINTS = 6
COMPARED_PRINTS = 2
#: Candidates differ in at most so many of the 128 bits compared; of a similarity of 0.8, 19 are expected, 36 exceeded by 1 in 30,000.
CANDIDATE_BITS = 36
#: Rounds of verification pair by pair: all but the last take each text's nearest candidate and that one's hub, the last all that are left and all their hubs.
ROUNDS = 4
#: Steps by which components are told apart between rounds; the whole components come from the links in the end.
LABEL_STEPS = 3
#: A block of a cluster has about so many texts and shingles at most; a task holds two blocks.
BLOCK_TEXTS = 2048
BLOCK_SHINGLES = 1 << 20
#: Beyond so many fingerprints under one variant, rows are no longer compared in step; links are the same.
COMPARED = 64
#: Up to so many sets of differing bits, neighbours are looked up by them; beyond, components are grown row by row.
LOOKED_UP = 1000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def _counted(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        lanes = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8)
        counts += np.unpackbits(lanes).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprint(hashes: np.ndarray, number: int = 0) -> int:
    """A bit is set if it's set in over half the hashes; signed. Further fingerprints are of the hashes mixed with their number."""
    if number:
        with np.errstate(over="ignore"):
            hashes = hashes + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            hashes = hashes ^ (hashes >> np.uint64(31))
    return _counted(hashes)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, prints: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fps): each row's fingerprints; nulls and texts without words have 0. distinct: repeats of a shingle don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in texts_of(batch).to_pylist():
                hashes = shingle_hashes(text, shingle_words)
                hashes = np.unique(hashes) if distinct else hashes
                found.append([fingerprint(hashes, n) for n in range(prints)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "fps"])

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fps array<bigint>")


def segments(max_bits: int) -> list[tuple[int, int, list[int]]]:
    """(lowest bit, width, bits to leave out) of each segment; -1: none is left out."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    exact_last = max_bits % 2 == 0 and n > 1
    return [(a, b - a, [-1] if exact_last and b == 64 else list(range(a, b))) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys(max_bits: int) -> list[tuple[int, int]]:
    """(bit left out or -1, the other bits of the segment) of each variant."""
    return [(bit, ((1 << width) - 1) << low) for low, width, bits in segments(max_bits) for bit in bits]


def _variants(max_bits: int):
    keys = _keys(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([m & ~(1 << bit) if bit >= 0 else m for bit, m in keys], np.uint64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            rest = (fp[:, None] & masks[None, :]).ravel().view(np.int64)
            kind = np.tile(np.arange(len(keys), dtype=np.int16), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(rest), pa.array(np.repeat(fp.view(np.int64), len(keys)))], names=["kind", "rest", "fp"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each node's root: the smallest node that the links a, b reach."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def _near(fp: np.ndarray, free: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in the sorted fp that differ by at most max_bits of the free bits, each from its lower side."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    a, b = [], []
    for n in range(1, max_bits + 1):
        for some in combinations(bits, n):
            other = fp ^ np.uint64(sum(some))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            hit = np.flatnonzero((fp[at] == other) & (other > fp))
            a.append(hit)
            b.append(at[hit])
    return np.concatenate(a), np.concatenate(b)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows differ; a row has one fingerprint or several."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(1, dtype=np.int16)


def _grown(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: a component grows from its first row; what has joined isn't compared with what comes later."""
    pool, a, b = np.arange(len(fp)), [], []
    while len(pool):
        front, pool = [int(pool[0])], pool[1:]
        while front and len(pool):
            at = front.pop()
            near = _apart(fp[pool], fp[at]) <= max_bits
            if near.any():
                own = pool[near]
                a.append(own)
                b.append(np.full(len(own), at))
                front += own.tolist()
                pool = pool[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _links(max_bits: int):
    keys = _keys(max_bits)

    def linked(kind: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Rows of whole variants, sorted: a link from each fingerprint to its root within the variant."""
        starts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (rest[1:] != rest[:-1])]))
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        left = np.repeat(np.where(sizes <= COMPARED, starts + sizes, 0), sizes)  # where a row's variant ends
        for step in range(1, min(COMPARED, int(sizes.max()))):
            at = np.flatnonzero(np.arange(step, step + len(fp)) < left)
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
            a.append(hit)
            b.append(hit + step)
        for at, size in zip(starts[sizes > COMPARED].tolist(), sizes[sizes > COMPARED].tolist(), strict=True):
            bit, mask = keys[kind[at]]
            free = (1 << 64) - 1 & ~(mask & ~(1 << bit) if bit >= 0 else mask)
            own = fp[at : at + size]
            if sum(math.comb(free.bit_count(), n) for n in range(1, max_bits + 1)) > LOOKED_UP:
                x, y = _grown(own, max_bits)
                a.append(at + x)
                b.append(at + y)
                continue
            order = np.argsort(own)
            x, y = _near(own[order], free, max_bits)
            a.append(at + order[x])
            b.append(at + order[y])
        root = _forest(np.concatenate(a), np.concatenate(b), len(fp))
        away = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[away].view(np.int64)), pa.array(fp[root[away]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, rest, fp in _whole_variants(batches, ["kind", "rest"]):
            yield linked(kind, rest, fp.view(np.uint64))

    return run


def _whole_variants(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows in pieces that end where a variant ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        own = [cols[batch.schema.get_field_index(k)] for k in keys]
        if held:
            before = [held[-1][batch.schema.get_field_index(k)][-1] for k in keys]
        else:
            before = [k[0] for k in own]
        change = np.flatnonzero(np.logical_or.reduce([np.concatenate([[b], k[:-1]]) != k for b, k in zip(before, own, strict=True)]))
        if len(change):
            cut = int(change[-1])
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)]
            held, cols = [], [c[cut:] for c in cols]
        held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """prints(fp), distinct. Links (a, b) that join all fingerprints which differ by at most max_bits, and no others.

    Each link is a chain of verified pairs within one variant. The fingerprints under one variant, 8 bytes each, are held
    in a task's memory together.
    """
    n = partitions(prints.sparkSession)
    kept = prints.select("fp").mapInArrow(_variants(max_bits), "kind smallint, rest bigint, fp bigint")
    dealt = kept.repartition(n, "kind", "rest").sortWithinPartitions("kind", "rest")
    return dealt.mapInArrow(_links(max_bits), "a bigint, b bigint")


def near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of docs: doc_id, fp (signed fingerprint), component_id.

    Texts with A-Z in lower case are cut into words `[^\\x20\\x09-\\x0D]+` and shingles, repeats included; a text of fewer
    words is one shingle; without words, or null, it has fingerprint 0 and is linked like any other. Rows are linked
    where fingerprints differ in at most max_bits bits; component_id is the smallest doc_id reachable, null only where
    all of them are null. Repeated rows and ids stay rows. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle_words).select("doc_id", F.col("fps")[0].alias("fp")))
    return _components(rows, near_links(rows.select("fp").distinct(), max_bits), "fp")


def _components(rows: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """rows with component_id: the smallest doc_id of the rows whose nodes the links join."""
    nodes = rows.groupBy(node).agg(F.min("doc_id").alias("least"))
    placed = nodes.join(roots(links).withColumnRenamed("node", node), node, "left").select(node, "least", F.coalesce("root", node).alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select(node, "component_id")
    return rows.join(classes, node).select("doc_id", node, "component_id")


def _wide_keys() -> list[tuple[int, int, int]]:
    """(number of the fingerprint, lowest bit, mask above it) of each variant: a third of a fingerprint without two neighbouring bits."""
    cuts = [64 * i // 3 for i in range(4)]
    return [(n, a, (1 << b - a) - 1 & ~(3 << at)) for n in range(PRINTS) for a, b in zip(cuts, cuts[1:], strict=False) for at in range(0, b - a, 2)]


def _wide_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = _wide_keys()
    for batch in batches:
        fps = np.stack([batch.column(f"f{n}").to_numpy() for n in range(PRINTS)], 1)
        bits = fps.view(np.uint64)
        key = np.stack([(bits[:, n] >> np.uint64(low) & np.uint64(mask)).astype(np.int32) | i << 22 for i, (n, low, mask) in enumerate(keys)], 1)
        own = ["size", *(["label"] if "label" in batch.schema.names else [])]
        each = [np.repeat(x, len(keys)) for x in (*(batch.column(c).to_numpy() for c in own), *fps[:, :COMPARED_PRINTS].T)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (key.ravel().astype(np.int32), *each))), names=["key", *own, *(f"f{n}" for n in range(COMPARED_PRINTS))])


def _nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, n: int) -> np.ndarray:
    """Places of those of the links a, b that form a spanning forest of the least sum of distances: in each round, each tree takes its shortest link."""
    order = np.lexsort((b, a, apart))
    a, b, tree, taken = a[order], b[order], np.arange(n), []
    left = np.arange(len(a))
    while len(left):
        x, y = tree[a[left]], tree[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        best = np.full(n, len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        own = np.unique(best[best < len(a)])
        taken.append(own)
        tree = _forest(tree[a[own]], tree[b[own]], n)[tree]
    return order[np.concatenate(taken)] if taken else left


def _candidates(bits: np.ndarray, sizes: np.ndarray, one: np.ndarray | int, others: np.ndarray) -> np.ndarray:
    """Distances of rows; beyond CANDIDATE_BITS also where the sizes of the sets alone rule a link out."""
    apart = _apart(bits[one], bits[others]) if isinstance(one, np.ndarray) else np.bitwise_count(bits[others] ^ bits[one]).sum(1, dtype=np.int16)
    small, large = np.minimum(sizes[one], sizes[others]), np.maximum(sizes[one], sizes[others])
    return np.where(100 * small >= int(SIMILARITY * 100) * large, apart, CANDIDATE_BITS + 1)


def _tree(bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the least sum of distances: row by row, the nearest to those that have joined."""
    left = np.arange(1, len(bits))
    apart, parent = _candidates(bits, sizes, 0, left), np.zeros(len(left), np.int64)
    a, b = [], []
    while len(left):
        i = int(np.argmin(apart))
        at = int(left[i])
        if apart[i] <= CANDIDATE_BITS:
            a.append(at)
            b.append(int(parent[i]))
        left, apart, parent = np.delete(left, i), np.delete(apart, i), np.delete(parent, i)
        now = _candidates(bits, sizes, at, left)
        nearer = now < apart
        apart, parent = np.where(nearer, now, apart), np.where(nearer, at, parent)
    return np.array(a, np.int64), np.array(b, np.int64)


def _wide_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates under each variant: a spanning forest by the shortest distances, so that a pair which isn't linked has a path of nearer ones."""
    for key, sizes, *cols in _whole_variants(batches, ["key"]):
        fps = np.stack(cols, 1)
        bits = fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(starts, len(key)))
        left = np.repeat(np.where(count <= COMPARED, starts + count, 0), count)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = np.arange(len(key))
        for step in range(1, COMPARED):
            at = at[at + step < left[at]]
            if not len(at):
                break
            hit = at[_candidates(bits, sizes, at, at + step) <= CANDIDATE_BITS]
            a.append(hit)
            b.append(hit + step)
        for start, n in zip(starts[count > COMPARED].tolist(), count[count > COMPARED].tolist(), strict=True):
            x, y = _tree(bits[start : start + n], sizes[start : start + n])
            a.append(start + x)
            b.append(start + y)
        a, b = np.concatenate(a), np.concatenate(b)
        apart = _apart(bits[a], bits[b])
        own = _nearest(a, b, apart, len(key))
        ends = [pa.FixedSizeListArray.from_arrays(pa.array(fps[x[own]].ravel()), COMPARED_PRINTS).cast(pa.list_(pa.int64())) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([*ends, pa.array(apart[own].astype(np.int32))], names=["a", "b", "apart"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates under each variant that lie in two components. label: the number of a row's component, 0 for one of its own."""
    for key, sizes, label, *cols in _whole_variants(batches, ["key"]):
        fps = np.stack(cols, 1)
        bits = fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(starts, len(key)))

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            ends = [pa.FixedSizeListArray.from_arrays(pa.array(fps[x].ravel()), COMPARED_PRINTS).cast(pa.list_(pa.int64())) for x in (a, b)]  # noqa: B023
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        def met(one: np.ndarray | int, others: np.ndarray) -> np.ndarray:
            two = (label[one] != label[others]) | (label[others] == 0)  # noqa: B023
            return two & (_candidates(bits, sizes, one, others) <= CANDIDATE_BITS)  # noqa: B023

        left = np.repeat(np.where(count <= COMPARED, starts + count, 0), count)
        at = np.arange(len(key))
        for step in range(1, COMPARED):
            at = at[at + step < left[at]]
            if not len(at):
                break
            hit = at[met(at, at + step)]
            if len(hit):
                yield pairs(hit, hit + step)
        for start, n in zip(starts[count > COMPARED].tolist(), count[count > COMPARED].tolist(), strict=True):
            own = label[start : start + n]
            if own[0] and (own == own[0]).all():
                continue
            for one in range(start, start + n - 1):
                rest = np.arange(one + 1, start + n)
                rest = rest[(label[rest] != label[one]) | (label[rest] == 0)]
                hit = rest[met(one, rest)]
                if len(hit):
                    yield pairs(np.full(len(hit), one), hit)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows group by group, each held as a whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        own = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if lo == hi:
                continue
            now = tuple(own[lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _similar(shingles: np.ndarray, sizes: np.ndarray, one_side: np.ndarray, other_side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the sets that are similar, one of each side; what has joined isn't compared again."""
    codes = np.unique(shingles, return_inverse=True)[1]
    starts, tree = np.cumsum(sizes) - sizes, np.arange(len(sizes))
    held = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    percent = int(SIMILARITY * 100)
    a, b = [], []
    for one in one_side.tolist():
        small, large = np.minimum(sizes[other_side], sizes[one]), np.maximum(sizes[other_side], sizes[one])
        others = other_side[(tree[other_side] != tree[one]) & (100 * small >= percent * large) & (small > 0)]
        if not len(others):
            continue
        ends = np.cumsum(sizes[others])
        before = ends - sizes[others]
        own = codes[starts[one] : starts[one] + sizes[one]]
        held[own] = True
        n = np.add.reduceat(held[codes[np.arange(ends[-1]) + np.repeat(starts[others] - before, sizes[others])]], before, dtype=np.int64)
        held[own] = False
        # n / (|a| + |b| - n) >= 0.8 in whole numbers
        hit = others[100 * n >= percent * (sizes[one] + sizes[others] - n)]
        if len(hit):
            joined, first = np.unique(tree[hit], return_index=True)
            a += [one] * len(first)
            b += hit[first].tolist()
            tree[np.isin(tree, joined)] = tree[one]
    return np.array(a, np.int64), np.array(b, np.int64)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, ["cluster", "i", "j"]):
        lists = group.column("shingles").combine_chunks()
        nodes = group.column("node").combine_chunks()
        block, within = group.column("block").to_numpy(), group.column("i")[0] == group.column("j")[0]
        every = np.arange(len(block))
        one_side = every if within else np.flatnonzero(block == group.column("i")[0].as_py())
        other_side = every if within else np.flatnonzero(block != group.column("i")[0].as_py())
        a, b = _similar(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), one_side, other_side)
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [np.unique(shingle_hashes(t, SIMILAR_WORDS)) for t in texts_of(batch).to_pylist()]
        prints = pa.array([[fingerprint(h, n) for n in range(COMPARED_PRINTS)] for h in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([prints, pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["node", "shingles"])


def _set_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found, sizes = [], []
        for text in texts_of(batch).to_pylist():
            hashes = np.unique(shingle_hashes(text, SIMILAR_WORDS))
            found.append([fingerprint(hashes, n) for n in range(PRINTS)])
            sizes.append(len(hashes))
        prints = np.array(found, np.int64).reshape(-1, PRINTS)
        node = pa.FixedSizeListArray.from_arrays(pa.array(prints[:, :COMPARED_PRINTS].ravel()), COMPARED_PRINTS).cast(pa.list_(pa.int64()))
        cols = [batch.column("doc_id"), node, pa.array(sizes, pa.int32()), *(pa.array(x) for x in prints.T)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "size", *(f"f{n}" for n in range(PRINTS))])


def similar_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all rows, where a node stands for texts with the same first fingerprints; and the links (a, b) of nodes."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = "size int, " + ", ".join(f"f{n} bigint" for n in range(PRINTS))
    rows = materialize(texts.mapInArrow(_set_prints, f"doc_id bigint, node array<bigint>, {own}"))
    names = [f"f{n}" for n in range(COMPARED_PRINTS)]
    prints = rows.groupBy(*names).agg(F.min(F.struct("size", *(f"f{n}" for n in range(COMPARED_PRINTS, PRINTS)))).alias("x")).select(*names, "x.*")
    kept = prints.mapInArrow(_wide_variants, "key int, size int, " + ", ".join(f"{n} bigint" for n in names))
    dealt = kept.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", *names)
    pairs = dealt.mapInArrow(_wide_links, "a array<bigint>, b array<bigint>, apart int")
    pairs = materialize(pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.min("apart").alias("apart")))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # Of the rows of one node one stands for all; only texts of candidates are read again.
    stands = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("__id")).select("__id").distinct()
    again = texts.join(stands, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = materialize(again.mapInArrow(_sets, "node array<bigint>, shingles array<bigint>").groupBy("node").agg(F.min("shingles").alias("shingles")))
    return rows.select("doc_id", "node"), materialize(_clustered(pairs, sets))


def _contracted_roots(pairs: DataFrame) -> DataFrame:
    """(node, root) like roots, for far more links than nodes: trees of each node and its least neighbour come first, the other links join these."""
    least = pairs.select("a", "b").union(pairs.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
    trees = roots(least)
    a, b = (trees.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    rest = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    far = roots(rest.where("a <> b"))
    moved = trees.join(far.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    return moved.select("node", F.coalesce("last", "root").alias("root")).union(far)


def _clustered(pairs: DataFrame, sets: DataFrame, texts: int = BLOCK_TEXTS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) that join all similar sets within each cluster of nodes that the pairs join.

    A cluster is cut into blocks, each of which meets each in one group: a set is a row for each block of its cluster, most
    often one, never a row for each pair. All pairs of a cluster are compared, whether they are candidates or not.
    """
    placed = materialize(_contracted_roots(pairs))
    # Clusters whose hashes are equal are compared as one.
    clusters = placed.union(placed.select("root", "root").distinct()).select("node", F.xxhash64("root").alias("cluster"))
    own = materialize(sets.join(clusters, "node"))
    many = F.ceil(F.greatest(F.count("*") / texts, F.sum(F.size("shingles")) / shingles))
    large = own.groupBy("cluster").agg(many.alias("blocks")).where("blocks > 1")
    cut = own.join(large, "cluster", "left").fillna(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    met = cut.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = met.select("cluster", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"), "block", "node", "shingles")
    key = ["cluster", "i", "j"]
    dealt = dealt.repartition(partitions(sets.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_block_links, "a array<bigint>, b array<bigint>")


# Pairs one by one, in rounds by forests and then in a sweep. Rows grow with the pairs of a dense group, so that operators don't use it; tests
# compare clusters with it.


def _swept(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): each pair of prints that shares a variant and is near enough, but isn't joined by links.

    A forest has a path of nearer pairs for each that it leaves out, but these needn't be similar enough when it is. What is
    dealt out again is the fingerprints with a number for the component; ends of components alone make pairs.
    """
    names = [f"f{n}" for n in range(COMPARED_PRINTS)]
    placed = materialize(roots(links))
    number = materialize(placed.select("root").distinct().withColumn("label", F.monotonically_increasing_id() + 1))
    labels = placed.join(number, "root").select("node", "label").union(number.select(F.col("root").alias("node"), "label"))
    own = prints.withColumn("node", F.array(*names)).join(labels, "node", "left").drop("node").fillna(0, ["label"])
    kept = own.mapInArrow(_wide_variants, "key int, size int, label bigint, " + ", ".join(f"{n} bigint" for n in names))
    dealt = kept.repartition(partitions(prints.sparkSession), "key").sortWithinPartitions("key", *names)
    found = dealt.mapInArrow(_across, "a array<bigint>, b array<bigint>")
    return materialize(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _meeting(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets of shingles are similar."""
    sides = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("n", F.size(F.array_intersect("a_set", "b_set")))
    # n / (|a| + |b| - n) >= 0.8 in whole numbers
    return both.where(F.col("n") * 100 >= int(SIMILARITY * 100) * (F.size("a_set") + F.size("b_set") - F.col("n"))).select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """(a, label): the least node within some steps. Equal labels mean one component; a component of a node and its neighbours has one label.

    A step takes the label of the label, then the least label of the node and its neighbours.
    """
    both = links.union(links.select("b", "a"))
    own = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    around = both.union(own.select("a", F.col("a").alias("b")))
    for _ in range(LABEL_STEPS):
        further = own.select(F.col("a").alias("label"), F.col("label").alias("further"))
        jumped = own.join(further, "label").select(F.col("a").alias("b"), F.col("further").alias("label"))
        own = around.join(jumped, "b").groupBy("a").agg(F.min("label").alias("label"))
    return own


def _hubs(links: DataFrame) -> DataFrame:
    """(a, hub): of the nodes linked with a, or a itself, the one with the most links."""
    both = links.union(links.select("b", "a"))
    many = both.groupBy("a").agg(F.count("*").alias("n"))
    most = F.max(F.struct(F.col("n"), F.col("b").alias("hub")))
    near = both.union(many.select("a", F.col("a").alias("b"))).join(many.withColumnRenamed("a", "b"), "b")
    return near.groupBy("a").agg(most["hub"].alias("hub"))


_TRIED = "struct<apart:int,other:array<bigint>>"


def _placed(open_: DataFrame, links: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """Candidates whose ends links don't join within a few steps, with the label and the hub of each end's component, and what it has tried."""
    if links is None or tried is None:
        none = {"label": "array<bigint>", "hub": "array<bigint>", "tried": _TRIED}
        return open_.select("*", *(F.lit(None).cast(t).alias(f"{c}_{n}") for c in "ab" for n, t in none.items()))
    of = materialize(_labels(links).join(_hubs(links), "a").join(tried.withColumnRenamed("node", "a"), "a", "full_outer"))
    own = [of.select(F.col("a").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in ("label", "hub", "tried"))) for c in "ab"]
    return materialize(open_.join(own[0], "a", "left").join(own[1], "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")))


def _chosen(placed: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b): each node's nearest candidate and the hub that it meets there; in the last round all, and each hub met. (node, tried): the nearest.

    A node takes its candidates in the order of their distances, so that those up to the last that it tried are tried, or joined.
    """
    ways = [placed.select(F.col(x).alias("node"), F.col(y).alias("other"), F.col(f"{y}_hub").alias("hub"), "apart", F.col(f"{x}_tried").alias("tried")) for x, y in ("ab", "ba")]
    further = F.col("tried").isNull() | (F.struct("apart", "other") > F.col("tried"))
    near = F.min(F.struct("apart", "other", "hub")).alias("n")
    best = ways[0].union(ways[1]).where(further).groupBy("node", *["hub"] * last).agg(near)
    best = best if last else materialize(best)
    hubs = best.select("node", F.col("n.hub").alias("other")).where("other != node")
    left = placed
    for x, y in ("ab", "ba"):
        left = left.where(F.col(f"{x}_tried").isNull() | (F.struct("apart", F.col(y).alias("other")) > F.col(f"{x}_tried")))
    found = (left.select(F.col("a").alias("node"), F.col("b").alias("other")) if last else best.select("node", "n.other")).union(hubs)
    return found.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), best.select("node", F.struct("n.apart", "n.other").alias("tried"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, apart) that join what their sets of shingles link.

    A round verifies each node's nearest pair that it hasn't tried; pairs that links already join within a few steps are left
    out of the next. The last round takes all that are left, so every pair is verified or lies within a component. Where a
    node meets another component, the hub of the node that it meets is a candidate, too: copies of one text may be less
    similar to each other than to that text. In the last round these are the hubs of all nodes that it meets.
    """
    links, tried, open_ = None, None, pairs
    for n in range(ROUNDS):
        open_ = _placed(open_, links, tried)
        now, nearest = _chosen(open_, n + 1 == ROUNDS)
        found = _meeting(materialize(now), sets)
        links = materialize(found if links is None else links.union(found), instead_of=links)
        if n + 1 < ROUNDS:
            tried = nearest if tried is None else tried.union(nearest).groupBy("node").agg(F.max("tried").alias("tried"))
            open_ = open_.select("a", "b", "apart")
    return links


def similar_dedup(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, node (two signed fingerprints), component_id.

    Texts are linked if the Jaccard similarity of their five-word shingles (of the words of near_dedup; XXH64 stands for a
    shingle) is 0.8 or more. Candidates share a variant and differ in at most CANDIDATE_BITS of 128 bits, so that some links
    aren't seen; of the candidates none is left out, and no link is less similar. Texts with the same 128 bits are copies, texts without words and nulls too.
    component_id, repeated rows, nulls and empty tables are as in near_dedup.
    """
    rows, links = similar_links(docs)
    return _components(rows, links, "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs whose doc_id is the smallest of its similar ones; rows that share that doc_id all stay."""
    found = similar_dedup(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_semi")
