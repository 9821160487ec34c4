"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold the rank of the pair that begins there, with its place as the lower bits; the root is
then the leftmost pair of the lowest rank. A merge changes three leaves, each a path to the root. It ends when the root
holds no pair. Many short words are worked on in step, a numpy row for each word's tree; a long word has a tree by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import slices, texts_of, tune
from inkfold.llm.tokens import TOKEN_SLICE, WHITE, Encoder, encode_texts, ragged

#: The pattern that cuts texts before the merges, a fixed value; its white space is spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NONE = np.int64(1) << 62
#: Pairs of the words that are worked on in step, at most.
IN_STEP = 64


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        raw = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.special}
        raw |= {i: token.encode() for token, i in self.special.items()}
        self.size = max(raw) + 1
        self.bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.size)), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(raw.get(i, b"")) for i in range(self.size)])])
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in data["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair; NONE if it doesn't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)


class SegmentTree:
    """Least value of a row of leaves under point updates."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.least = [int(NONE)] * self.width + leaves + [int(NONE)] * (self.width - len(leaves))
        for at in range(self.width - 1, 0, -1):
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    @property
    def root(self) -> int:
        return self.least[1]

    def put(self, leaf: int, value: int) -> None:
        least, at = self.least, leaf + self.width
        least[at] = value
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])


def merge_long(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    """One word of at least two ids."""
    n, ranks, size, merged = len(ids), vocabulary.ranks, vocabulary.size, vocabulary.merged
    ids, after, before = ids[:], list(range(1, n + 1)), list(range(-1, n - 1))

    def value(at: int) -> int:
        to = after[at]
        rank = ranks.get(ids[at] * size + ids[to]) if to < n else None
        return int(NONE) if rank is None else rank << 32 | at

    tree = SegmentTree([value(i) for i in range(n - 1)])
    while tree.root < NONE:
        at = tree.root & 0xFFFFFFFF
        gone = after[at]
        ids[at] = int(merged[tree.root >> 32])
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        if gone < n - 1:
            tree.put(gone, int(NONE))
        tree.put(at, value(at))
        if before[at] >= 0:
            tree.put(before[at], value(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


def merge_in_step(ids: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Words as rows of ids, lengths of them used. Returns the rows with merged ids in place and -1 for what is gone."""
    n, width = ids.shape
    ids, end = ids.copy(), lengths[:, None]
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    leaves = 1 << max(0, width - 2).bit_length()
    tree = np.full((n, 2 * leaves), NONE)
    place = np.arange(width - 1)
    rank = np.where(place + 1 < end, vocabulary.rank(ids[:, :-1], ids[:, 1:]), NONE)
    tree[:, leaves : leaves + width - 1] = np.where(rank < NONE, rank << 32 | place, NONE)
    at = leaves >> 1
    while at:
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        at >>= 1

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
        at = leaf + leaves
        tree[row, at] = value
        for _ in range(leaves.bit_length() - 1):
            at = at >> 1
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

    def value(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        to = after[row, at]
        inside = to < lengths[row]
        rank = vocabulary.rank(ids[row, at], ids[row, np.where(inside, to, 0)])
        return np.where(inside & (rank < NONE), rank << 32 | at, NONE)

    row = np.arange(n)
    while len(row := row[tree[row, 1] < NONE]):
        root = tree[row, 1]
        at = root & 0xFFFFFFFF
        gone = after[row, at]
        ids[row, at] = vocabulary.merged[root >> 32]
        ids[row, gone] = -1
        to = after[row, gone]
        after[row, at] = to
        some = to < lengths[row]
        before[row[some], to[some]] = at[some]
        some = gone < width - 1
        put(row[some], gone[some], NONE)
        put(row, at, value(row, at))
        back = before[row, at]
        some = back >= 0
        put(row[some], back[some], value(row[some], back[some]))
    return np.where(np.arange(width) < end, ids, -1)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, and bounds."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    raw = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their ids, their counts
    low = 1
    for width in (1, 2, 3, 5, 9, 17, 33, IN_STEP + 1):
        some = np.flatnonzero((lengths >= low) & (lengths <= width))
        low = width + 1
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            ids = raw[np.minimum(starts[own][:, None] + np.arange(width), len(raw) - 1)]
            if width > 1:
                ids = merge_in_step(ids, lengths[own], vocabulary)
            used = ids >= 0
            parts.append((own, ids[used], used.sum(1)))
    for at in np.flatnonzero(lengths >= low).tolist():
        ids = np.array(merge_long(raw[starts[at] : starts[at] + lengths[at]].tolist(), vocabulary), np.int64)
        parts.append((np.array([at]), ids, np.array([len(ids)])))
    counts = np.zeros(len(words), np.int64)
    for own, _, size in parts:
        counts[own] = size
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.int64)
    for own, ids, size in parts:
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(bounds[own], size) + inner] = ids
    return out, bounds


def encoder(vocabulary: Vocabulary) -> Encoder:
    cut = regex.compile(PATTERN)
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known: dict[str, int] = {}
        places, counts = [], []
        for text in texts:
            pieces = special.split(text) if special and special.search(text) else (text,)
            n = 0
            for piece in pieces:
                if piece in vocabulary.special:
                    places.append(-1 - vocabulary.special[piece])
                    n += 1
                    continue
                for word in cut.findall(piece):
                    places.append(known.setdefault(word, len(known)))
                    n += 1
            counts.append(n)
        ids, bounds = merge_words([w.encode("utf-8", "surrogatepass") for w in known], vocabulary)
        # special tokens are further rows of one id
        names = np.array(sorted(vocabulary.special.values()), np.int64)
        rows = np.array(places, np.int64)
        rows = np.where(rows < 0, len(known) + np.searchsorted(names, -1 - rows), rows)
        bounds = np.concatenate([bounds, bounds[-1] + 1 + np.arange(len(names))])
        flat, ends = ragged(np.concatenate([ids, names]), bounds, rows)
        return flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]

    return encode


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, as the tokenizers library gives them without adding special ones.

    path: a byte-level vocabulary in that library's format, there on every executor. The strings of its special tokens are
    recognised in texts. A null or empty text has no ids. Rows and null ids stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        own = encoder(vocabulary)
        for batch in slices(batches, "text", TOKEN_SLICE // 2):
            ids, bounds = encode_texts(texts_of(batch), own, tuple(vocabulary.special))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    return ragged(vocabulary.bytes, vocabulary.ends, ids)[0].tobytes()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, text: special tokens are written out, bytes that aren't UTF-8 are replaced. Null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            texts = [decode_ids(flat[a:b], vocabulary).decode("utf-8", "replace") for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    tune(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")
