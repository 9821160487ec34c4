"""Texts of a batch as distinct chunks, so that each chunk is tokenized once.

With the pattern of the byte-level vocabularies a token never spans the place before a space that another character than
white space follows. Texts are cut there; a text in which a space has no such character after it, or which holds a
special token, is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space, a fixed set.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE_RE2 = r"^([\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"

#: Chunks encoded as one string.
JOINED = 256
#: Chunks whose ids a task remembers; with more, it forgets them all.
REMEMBERED = 400_000

#: Bytes of text tokenized at a time: the more, the more often a chunk occurs in them.
TOKEN_SLICE = 16 << 20

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def chunks(texts: pa.Array, special: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks, the chunk at each place of all texts, and each text's bounds in that."""
    n = len(texts)
    lists = pc.split_pattern(texts, " ")
    parts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(len(codes), bool)
    first[np.cumsum(parts) - parts] = True
    loose = pc.match_substring_regex(coded.dictionary, _WHITE_RE2).to_numpy(zero_copy_only=False)[codes] & ~first
    for token in special:
        loose |= pc.match_substring(coded.dictionary, token).to_numpy(zero_copy_only=False)[codes]
    doc = np.repeat(np.arange(n), parts)
    whole = np.bincount(doc[loose], minlength=n) > 0
    keys, places = np.unique((codes * 2 + ~first)[~whole[doc]], return_inverse=True)
    found = [" " * int(k & 1) + x for k, x in zip(keys, coded.dictionary.take(pa.array(keys >> 1)).to_pylist(), strict=True)]
    counts = np.where(whole, 1, parts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.int64)
    out[np.repeat(~whole, counts)] = places
    alone = np.flatnonzero(whole)
    out[bounds[alone]] = len(found) + np.arange(len(alone))
    return found + texts.take(pa.array(alone)).to_pylist(), out, bounds


def ragged(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a list of lists, one after another, and where each ends."""
    size = np.diff(bounds)[rows]
    ends = np.cumsum(size)
    at = np.repeat(bounds[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], ends


def encode_texts(texts: pa.Array, encode: Encoder, special: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and each text's bounds in them."""
    found, places, bounds = chunks(texts, special)
    ids, ends = ragged(*encode(found), places)
    return ids, np.concatenate([[0], ends])[bounds]


def library_encoder(path: str, remembered_chunks: int | None = None) -> tuple[Encoder, tuple[str, ...]]:
    """The tokenizers library with a byte-level vocabulary in its format, truncation and padding off; and its added tokens.

    Chunks that begin with a space are encoded many to a string, as no token spans the place where one begins; the bytes
    of the tokens tell which are whose. The ids of so many chunks are remembered; None: REMEMBERED.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = {i: x.content for i, x in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab()
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        n_bytes[i] = len(added[i].encode()) if i in added else len(token)  # a letter stands for a byte
    begins = re.compile(f" [^{WHITE}]")

    def flat(strings: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    known: dict[str, int] = {}
    kept, kept_bounds = np.empty(0, np.int64), np.zeros(1, np.int64)

    def spaced_chunks(together: list[str]) -> tuple[np.ndarray, np.ndarray]:
        strings = ["".join(together[i : i + JOINED]) for i in range(0, len(together), JOINED)]
        ids = np.fromiter(chain.from_iterable(flat(strings)), np.int64)
        ends = np.cumsum(np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in together), np.int64, len(together)))
        return ids, np.searchsorted(np.cumsum(n_bytes[ids]), ends, side="right")

    def remembered(together: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal kept, kept_bounds
        new = [x for x in together if x not in known]
        if len(known) + len(new) > (REMEMBERED if remembered_chunks is None else remembered_chunks):
            known.clear()
            kept, kept_bounds, new = kept[:0], kept_bounds[:1], together
        if new:
            ids, cuts = spaced_chunks(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            kept, kept_bounds = np.concatenate([kept, ids]), np.concatenate([kept_bounds, kept_bounds[-1] + cuts])
        rows = np.fromiter(map(known.__getitem__, together), np.int64, len(together))
        return ragged(kept, kept_bounds, rows)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced = np.fromiter((begins.match(x) is not None for x in texts), bool, len(texts))
        ids, ends = remembered(list(compress(texts, spaced)))
        alone = flat(list(compress(texts, ~spaced)))
        sizes = np.zeros(len(texts), np.int64)
        sizes[spaced] = np.diff(ends, prepend=0)
        sizes[~spaced] = [len(x) for x in alone]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(bounds[-1], np.int64)
        own = np.repeat(spaced, sizes)
        out[own] = ids
        out[~own] = np.fromiter(chain.from_iterable(alone), np.int64)
        return out, bounds

    return encode, tuple(added.values())
