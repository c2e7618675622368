"""Exact, vectorised encoding with a published BPE vocabulary.

The vocabulary file drops white space and its pre-tokenizer never joins characters across white space, so the
ids of a text are the concatenated ids of its white-space separated chunks. Chunks are dictionary-encoded per
batch by Arrow, each distinct chunk is encoded once and memoised, and the ids of all rows come from one gather.

Chunks of printable ASCII and Latin-1 letters use a rank-ordered merge in ``tiktoken`` over the same vocabulary
(each pre-token ends in byte 0xFF, which UTF-8 never contains, standing for the end-of-word mark); every other
chunk, and every chunk that could hold a special token, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from refrain.llm.common import release

#: Distinct chunks memoised by a Python worker before the memo starts anew; affects speed only.
MEMO = 200_000
#: Chunks beyond this length are encoded but not memoised.
MEMO_CHARS = 40

_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ]+")


def _byte_alphabet() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from white-space free chunks to their ids as little-endian unsigned 32-bit bytes."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    byte = _byte_alphabet()
    char = {b: c for c, b in byte.items()}
    ranks = {bytes([b, 255]): b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
    ids = [vocab[char[b] + end] for b in range(256)] + [vocab[char[b]] for b in range(256)]
    for merge in spec["model"]["merges"]:
        token = "".join(merge if isinstance(merge, list) else merge.split(" "))
        bare = token.removesuffix(end)
        ranks[bytes(byte[c] for c in bare) + b"\xff" * (bare != token)] = len(ids)
        ids.append(vocab[token])
    fast = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    id_of = np.array(ids, "<u4")
    del spec, vocab, ranks, ids
    release()

    def encode(words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        flat: list[int] = []
        ends: list[int] = []
        which: list[int] = []
        other: list[int] = []
        for k, w in enumerate(words):
            if _SIMPLE.fullmatch(w) and "<|" not in w:
                for piece in _PRE.findall(w.lower()):
                    flat += fast(piece.encode() + b"\xff")
                which.append(k)
                ends.append(len(flat))
            else:
                other.append(k)
        if which:
            buf, at = id_of[np.array(flat, np.int64)].tobytes(), 0
            for k, e in zip(which, ends):
                out[k] = buf[4 * at : 4 * e]
                at = e
        if other:
            for k, e in zip(other, exact.encode_batch([words[k] for k in other], add_special_tokens=False)):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    return encode


@lru_cache(maxsize=2)
def _memo(path: str) -> dict[str, bytes]:
    return {}


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, concatenated (uint32), and row boundaries (n + 1 offsets). Null texts count as empty."""
    memo, encode = _memo(path), encoder(path)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    bounds = np.asarray(lists.offsets, np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    which = np.asarray(coded.indices)
    words = coded.dictionary.to_pylist()
    del lists, coded
    if len(memo) > MEMO:
        memo.clear()
    found = [memo.get(w) for w in words]
    missing = [k for k, x in enumerate(found) if x is None]
    for k, x in zip(missing, encode([words[k] for k in missing])):
        found[k] = x
        if len(words[k]) <= MEMO_CHARS:
            memo[words[k]] = x
    if not words:
        return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    pool = np.frombuffer(b"".join(found), "<u4")
    per = sizes[which]
    upto = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=upto[1:])
    ids = pool[np.repeat(starts[which] - upto[:-1], per) + np.arange(upto[-1])]
    return ids, upto[bounds]
