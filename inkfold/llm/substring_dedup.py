"""Substring dedup with suffix automata of reference shards.

A window is `window` consecutive words. Hashes tell what can repeat, and where to look: of the word n-grams in a window the
one with the least hash is its anchor, so equal windows have equal anchors at equal places. The windows of one anchor
occurrence are its context, and occurrences are dealt out by anchor. An anchor that occurs once is done with. The first of
equal contexts is a reference, the others follow it; different contexts of an anchor are references for each other, in
document order. An anchor with more than `HOT` different contexts is split by the hashes of its windows.

Words alone decide what goes. References are put together in blocks of their document, and blocks in shards: suffix automata
of bounded size, through which the words of all followers stream. Their matching statistics give the maximal spans of
windows that are known; only those are removed. The shard of the references with the most followers is broadcast to all
tasks, its size checked, so that a hot passage's followers are matched where they are. Other shards together grow with
the data, so each goes only where its followers are dealt out to.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, partitions, slices, texts_of, tune, words_of

WINDOW = 20
#: Words of an anchor.
ANCHOR = 8
#: An anchor with more different contexts is split by window.
HOT = 256
#: Rows of one anchor held at a time; beyond, it counts as hot.
HELD_ROWS = 1 << 18
#: Words of a reference shard, but for its last key.
SHARD_WORDS = 20_000
#: Windows of a document that are one block of references.
BLOCK = 1024
#: The broadcast shard has the references of at most so many keys, of at least so many rows each, and at most so many words.
HOT_KEYS, HOT_ROWS, BROADCAST_WORDS = 64, 256, 60_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPAN = pa.struct([("doc", pa.int64()), ("tag", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])
_SPAN_SQL = "struct<doc:bigint,tag:bigint,lo:bigint,n:bigint>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(codes: np.ndarray, words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in words.cast(pa.binary()).to_pylist()], np.uint64)[codes]


class _Hashed:
    """Hashes of any run of words."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE_INVERSE)]), dtype=np.uint64)
            self.sum = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1], dtype=np.uint64)])

    def of(self, lo: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sum[lo + n] - self.sum[lo]) * self.back[lo])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value of each `width` consecutive ones."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, bounds, words = words_of(texts_of(batch))
            starts = len(codes) - window + 1
            if starts <= 0:
                continue
            hashed = _Hashed(_word_hashes(codes, words))
            gram = hashed.of(np.arange(len(codes) - anchor + 1), anchor)
            least = _least(gram, window - anchor + 1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            s = np.flatnonzero(row[:starts] == row[window - 1 : window - 1 + starts])
            if not len(s):
                continue
            head = np.flatnonzero(np.concatenate([[True], (least[s][1:] != least[s][:-1]) | (s[1:] != s[:-1] + 1)]))
            lo, n = s[head], np.diff(np.append(head, len(s)))
            at = least[lo]
            context = _mixed(hashed.of(lo, n + window - 1) + ((at - lo) * 64 + n).astype(np.uint64) * _BASE)
            doc, tag = (batch.column(c).to_numpy()[row[lo]] for c in ("doc", "tag"))
            key, context, lo = gram[at].view(np.int64), context.view(np.int64), lo - bounds[row[lo]]
            order = np.lexsort((lo, tag, doc, context, key))
            key, context, doc, tag, lo, n = (x[order] for x in (key, context, doc, tag, lo, n))
            new_group = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])])
            same_row = np.concatenate([[False], (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])]) & ~new_group
            again = same_row & np.concatenate([[False], lo[1:] == lo[:-1]])
            group = np.cumsum(new_group) - 1
            # The rest of a group are copies of its first; in one document adjacent ones are one span.
            rest = np.flatnonzero(~new_group & ~again)
            joins = np.zeros(len(rest), bool)
            joins[1:] = same_row[rest[1:]] & (group[rest[1:]] == group[rest[:-1]]) & (lo[rest[1:]] <= lo[rest[:-1]] + n[rest[:-1]]) & (rest[1:] == rest[:-1] + 1)
            begin = np.flatnonzero(~joins)
            last = rest[np.append(begin[1:], len(rest)) - 1] if len(rest) else rest
            rest = rest[begin]
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (doc[rest], tag[rest], lo[rest], lo[last] + n[last] - lo[rest])], fields=list(_SPAN))
            sizes = np.bincount(group[rest], minlength=group[-1] + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans)
            first = np.flatnonzero(new_group)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in (key, context, doc, tag, lo, n)), lists], names=["anchor", "context", "doc", "tag", "lo", "n", "more"])

    return run


_ANCHORS_SQL = f"anchor bigint, context bigint, doc bigint, tag bigint, lo bigint, n bigint, more array<{_SPAN_SQL}>"
_COLS = ("anchor", "context", "doc", "tag", "lo", "n")
#: Windows that others follow; that follow others; that are compared with the anchor's other contexts, or by their own hashes.
REF, FOLLOW, COLD, SPLIT = 0, 1, 2, 3
_FOUND = "doc bigint, tag bigint, lo bigint, n bigint, kind int, key bigint"


def _block_key(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(_mixed(doc.view(np.uint64) * _BASE + tag.view(np.uint64)) * _BASE + (lo // BLOCK).view(np.uint64)).view(np.int64)


def _found(cols: dict[str, np.ndarray], more: pa.Array, before: tuple, hot: int | None, most: int) -> tuple[pa.RecordBatch, tuple]:
    """Whole anchors, or parts of the hot one, sorted. before: of the part before, its last row and the first row of that context."""
    anchor, context = cols["anchor"], cols["context"]
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new_context = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
    same = ~new_context & np.concatenate([[False], np.logical_and.reduce([cols[c][1:] == cols[c][:-1] for c in ("doc", "tag", "lo")])])
    goes_on = bool(before) and (anchor[0], context[0]) == before[:2]
    if goes_on:
        new_context[0] = False
        same[0] = (cols["doc"][0], cols["tag"][0], cols["lo"][0]) == before[2:5]
    run = np.cumsum(new_anchor) - 1
    contexts = np.bincount(run, weights=new_context).astype(np.int64)[run]
    split = (contexts > most) | ((anchor == hot) if hot is not None else False)
    kind = np.where(new_context, np.where(split, SPLIT, np.where(contexts > 1, COLD, -1)), np.where(same, -1, FOLLOW))
    first = np.maximum.accumulate(np.where(new_context, np.arange(len(anchor)), -1))
    firsts = {c: np.where(first >= 0, cols[c][first], before[5 + i] if goes_on else 0) for i, c in enumerate(("doc", "tag", "lo", "n"))}
    key = np.where(kind == FOLLOW, _block_key(*(firsts[c] for c in ("doc", "tag", "lo"))), anchor)
    # Rows that a task had together with a first one.
    flat, of = more.flatten(), np.repeat(np.arange(len(anchor)), more.value_lengths().to_numpy(zero_copy_only=False))
    own = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag", "lo", "n")}
    own_key = _block_key(*(firsts[c][of] for c in ("doc", "tag", "lo")))
    followed = np.concatenate([np.flatnonzero(kind == FOLLOW), of])
    once = followed[np.unique(first[followed], return_index=True)[1]]
    ref_key = _block_key(*(firsts[c][once] for c in ("doc", "tag", "lo")))
    keep = np.flatnonzero(kind >= 0)
    outs = [pa.array(np.concatenate([cols[c][keep], own[c], firsts[c][once]])) for c in ("doc", "tag", "lo", "n")]
    kinds = np.concatenate([kind[keep], np.full(len(of), FOLLOW), np.full(len(once), REF)]).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([*outs, pa.array(kinds), pa.array(np.concatenate([key[keep], own_key, ref_key]))], names=["doc", "tag", "lo", "n", "kind", "key"])
    last = (*(int(cols[c][-1]) for c in ("anchor", "context", "doc", "tag", "lo")), *(int(firsts[c][-1]) for c in ("doc", "tag", "lo", "n")))
    return batch, last


def _taken(table: pa.Table) -> tuple[dict[str, np.ndarray], pa.Array]:
    return {c: table.column(c).to_numpy() for c in _COLS}, table.column("more").combine_chunks()


def _repeated(most: int, held_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor, context, doc, tag, lo."""
        held: list[pa.RecordBatch] = []
        rows, before, hot = 0, (), None

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < min(50_000, held_rows):
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut == 0 and rows >= held_rows:
                cut, now = rows, int(anchor[-1])
                cols, more = _taken(table)
                out, before = _found(cols, more, before, now, most)
                yield out
                hot = now
            elif cut:
                cols, more = _taken(table.slice(0, cut))
                yield _found(cols, more, before, hot, most)[0]
                before = ()
                hot = None if hot is not None and int(anchor[-1]) != hot else hot
            held = table.slice(cut).to_batches()
            rows -= cut
        if rows:
            cols, more = _taken(pa.Table.from_batches(held))
            yield _found(cols, more, before, hot, most)[0]

    return run


_WORDS = "kind int, key bigint, doc bigint, tag bigint, lo bigint, words binary"


def _united(places: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(kind, key, lo, n), sorted: adjacent and overlapping runs of windows of one kind and key become one."""
    at = None
    for kind, key, lo, n in places:
        if at and at[:2] == (kind, key) and lo <= at[2] + at[3]:
            at = (kind, key, at[2], max(at[3], lo + n - at[2]))
            continue
        if at:
            yield at
        at = (kind, key, lo, n)
    if at:
        yield at


def _contexts(window: int):
    """The words of references and followers: one row for each run of windows, or for each window of a hot anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, tag, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text", "places")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                rows = sorted((x["kind"], x["key"], x["lo"], x["n"]) for x in places)
                for kind, key, lo, n in (*_united([x for x in rows if x[0] in (REF, FOLLOW)]), *(x for x in rows if x[0] == COLD)):
                    out.append((kind, key, doc, tag, lo, b" ".join(words[lo : lo + n + window - 1])))
                for _, _, lo, n in (x for x in rows if x[0] == SPLIT):
                    for at in range(lo, lo + n):
                        part = b" ".join(words[at : at + window])
                        out.append((SPLIT, xxhash.xxh64_intdigest(part, 7) - (1 << 63), doc, tag, at, part))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int32(), *(pa.int64(),) * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "key", "doc", "tag", "lo", "words"])

    return run


class SuffixAutomaton:
    """A suffix automaton of word sequences that are added one after another."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _clone(self, at: int, of: int, word: bytes) -> int:
        copy = len(self.next)
        self.next.append(self.next[of].copy())
        self.link.append(self.link[of])
        self.length.append(self.length[at] + 1)
        self.link[of] = copy
        while at >= 0 and self.next[at].get(word) == of:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, known, word)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            known = nxt[at][word]
            link[new] = known if length[known] == length[at] + 1 else self._clone(at, known, word)
        return new

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest known sequence that ends with it."""
        nxt, link, length = self.next, self.link, self.length
        at, have, out = 0, 0, []
        for word in words:
            while at and word not in nxt[at]:
                at = link[at]
                have = length[at]
            to = nxt[at].get(word)
            if to is None:
                at, have = 0, 0
            else:
                at, have = to, have + 1
            out.append(have)
        return out


def _spans(lengths: list[int], window: int) -> Iterator[tuple[int, int]]:
    """(first window, number) of the maximal runs of known windows, by the matching statistics of the words."""
    begin = None
    for at, n in enumerate(lengths[window - 1 :]):
        if n >= window and begin is None:
            begin = at
        elif n < window and begin is not None:
            yield begin, at - begin
            begin = None
    if begin is not None:
        yield begin, len(lengths) - window + 1 - begin


_KNOWN = "doc bigint, tag bigint, lo bigint, n bigint"


def _matched(window: int):
    """Rows come sorted: references and followers by key, kind and place; then what is compared with each other, by key and place.

    Emits the windows that are known, as maximal spans. What isn't wholly known becomes known for what comes later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, key, before = SuffixAutomaton(), 0, None, None
        for batch in batches:
            out: list[tuple] = []
            for kind, now, doc, tag, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "doc", "tag", "lo", "words")), strict=True):
                mutual = kind >= COLD
                if (mutual, now) != key:
                    # References of both sorts never share a shard: those of followers aren't first occurrences of each window.
                    if size >= SHARD_WORDS or (key and key[0] != mutual):
                        shard, size = SuffixAutomaton(), 0
                    key, before = (mutual, now), None
                if before == (kind, doc, tag, lo):
                    continue
                before, words = (kind, doc, tag, lo), raw.split(b" ")
                if kind != REF:
                    known = list(_spans(shard.statistics(words), window))
                    out += [(doc, tag, lo + at, n) for at, n in known]
                    if sum(n for _, n in known) == len(words) - window + 1:
                        continue
                shard.add(words)
                size += len(words)
            yield _known_rows(out)

    return run


def _known_rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "tag", "lo", "n"])


def _automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of the task in one shard, pickled."""
    shard = SuffixAutomaton()
    for batch in batches:
        for raw in batch.column("words").to_pylist():
            shard.add(raw.split(b" "))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(shard, pickle.HIGHEST_PROTOCOL)], pa.binary())], names=["shard"])


def _streamed(window: int, shared: Broadcast):
    """Followers of hot references, matched where they are. Emits known spans; what isn't wholly known comes out as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            shard = shard or pickle.loads(shared.value)
            out, left = [], []
            for i, (doc, tag, lo, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "lo", "words")), strict=True)):
                words = raw.split(b" ")
                known = list(_spans(shard.statistics(words), window))
                if sum(n for _, n in known) == len(words) - window + 1:
                    out += [(None, None, doc, tag, lo + at, None, n) for at, n in known]
                else:
                    left.append(i)
            rest = batch.take(pa.array(left, pa.int64()))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            names, kinds = ["kind", "key", "doc", "tag", "lo", "words", "n"], (pa.int32(), *(pa.int64(),) * 4, pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names[:-1]), pa.nulls(rest.num_rows, pa.int64())], names=names)

    return run


def _hot(words: DataFrame, hot_rows: int) -> tuple[DataFrame, list[int]]:
    """(the references of the hot keys, the keys). At most HOT_KEYS keys and BROADCAST_WORDS words, whatever the size of the data."""
    followers = words.where(F.col("kind").isin(FOLLOW, SPLIT)).groupBy("key").agg(F.count("*").alias("rows"), F.max("kind").alias("kind"))
    most = followers.where(F.col("rows") >= hot_rows).orderBy(F.desc("rows"), "key").limit(HOT_KEYS)
    named = F.broadcast(most.select("key", F.col("kind").alias("hot_kind")))  # HOT_KEYS rows
    own = words.join(named, "key")
    refs = own.where((F.col("kind") == REF) & (F.col("hot_kind") == FOLLOW)).select("key", "doc", "tag", "lo", "words")
    first = own.where((F.col("kind") == SPLIT) & (F.col("hot_kind") == SPLIT)).groupBy("key").agg(F.min(F.struct("doc", "tag", "lo", "words")).alias("f")).select("key", "f.*")
    both = refs.unionByName(first)
    sizes = both.groupBy("key").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("size")).join(named, "key").select("key", "size").collect()
    keys, total = [], 0
    for row in sorted(sizes, key=lambda r: (r["size"], r["key"])):
        total += row["size"]
        if total <= BROADCAST_WORDS:
            keys.append(row["key"])
    return both.where(F.col("key").isin(keys)), keys


def _by_broadcast(words: DataFrame, window: int, hot_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """(known spans of the followers of hot references, the words that are left to be dealt out)."""
    refs, keys = _hot(words, hot_rows)
    if not keys:
        return None, words
    (row,) = refs.select("words").repartition(1).mapInArrow(_automaton, "shard binary").collect()
    shared = words.sparkSession.sparkContext.broadcast(bytes(row["shard"]))
    here = F.col("key").isin(keys)
    first = F.broadcast(refs.select("key", "doc", "tag", "lo").distinct())  # at most HOT_KEYS keys' references
    streamed = words.where(here & F.col("kind").isin(FOLLOW, SPLIT)).join(first, ["key", "doc", "tag", "lo"], "left_anti")
    found = materialize(streamed.select("kind", "key", "doc", "tag", "lo", "words").mapInArrow(_streamed(window, shared), f"{_WORDS}, n bigint"))
    rest = words.where(~here | ~F.col("kind").isin(FOLLOW, SPLIT)).unionByName(words.where(here).join(first, ["key", "doc", "tag", "lo"], "left_semi").where(f"kind = {SPLIT}"))
    left = rest.unionByName(found.where("n IS NULL").drop("n"))
    return found.where("n IS NOT NULL").select("doc", "tag", "lo", "n"), left


def _cut(window: int, texts: bool):
    """Drop the words under the spans. texts: also what is left; a text that loses nothing stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, gone, hashes, left = [], [], [], []
            for text, spans in zip(texts_of(batch).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                kept, at = [], 0
                for lo, n in sorted((x["lo"], x["n"]) for x in spans or ()):
                    kept += words[at:lo] if lo > at else []
                    at = max(at, lo + n + window - 1)
                kept += words[at:]
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                hashes.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    left.append(joined.decode("utf-8", "surrogatepass") if gone[-1] else text)
            own = [c for c in batch.schema.names if c not in ("spans", "text", "doc", "tag")]
            out = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())}
            out |= {"kept_text": pa.array(left, pa.string())} if texts else {}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *out.values()], names=[*own, *out])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False, anchor: int = ANCHOR, carry: tuple[str, ...] = (), hot: int = HOT, held_rows: int = HELD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Remove each word under a window whose words also start earlier: at a smaller doc_id, or before in the same row.

    A row for each row of docs: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space and, if
    texts, kept_text: a text that loses nothing stays as it is. Windows are judged on the input. Null texts have no words.
    A null doc_id counts as the largest. Rows that agree in doc_id and text are one document and get one result; rows
    with one doc_id and different texts are ordered by a hash of the text. The columns of docs named in carry come out in the
    struct `row`, others are ignored; an empty table gives no rows.
    """
    if not 1 <= anchor <= window or window > 48 + anchor:
        raise ValueError("anchor must be between window - 48 and window")
    spark = docs.sparkSession
    tune(spark)
    n = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *kept)
    rows = rows.select(*rows.columns, F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("tag"))
    anchors = rows.select("doc", "tag", "text").mapInArrow(_anchors(window, anchor), _ANCHORS_SQL)
    dealt = anchors.repartition(n, "anchor").sortWithinPartitions("anchor", "context", "doc", "tag", "lo")
    found = materialize(dealt.mapInArrow(_repeated(hot, held_rows), _FOUND))

    by_doc = rows.repartition(n, "doc", "tag")
    places = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n", "kind", "key")).alias("places"))
    joined = by_doc.join(places.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "places")
    words = materialize(joined.mapInArrow(_contexts(window), _WORDS))
    known, left = _by_broadcast(words, window, hot_rows)
    shards = left.repartition(n, "key").sortWithinPartitions(F.col("kind") >= COLD, "key", "kind", "doc", "tag", "lo")
    spans = shards.mapInArrow(_matched(window), _KNOWN)
    spans = spans if known is None else spans.unionByName(known)
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    out = by_doc.join(spans.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", *["row"] * bool(carry), "text", "spans")
    row = f"row {rows.schema['row'].dataType.simpleString()}, " if carry else ""
    return out.mapInArrow(_cut(window, texts), f"doc_id bigint, {row}n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of docs with what substring_dedup leaves as text, and n_chars, if it's there, as its length.

    A text that loses words is its kept words joined by one space, possibly empty; a null text is empty.
    """
    others = tuple(c for c in docs.columns if c != "text")
    found = substring_dedup(docs, window, texts=True, carry=others)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return found.select(*(new.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema))
