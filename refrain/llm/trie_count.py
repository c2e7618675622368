"""Operator 6: token counts under a unigram model, with dynamic programming shared over a trie of pre-tokens.

The model's pieces and scores are read from a published vocabulary file (path is a parameter; it ranks its
pieces, and a piece of rank r gets the Zipf log-probability -log(r + 2)). A pre-token is a white-space separated
run with the mark U+2581 in front; its segmentation is the best-scoring one, ties going to fewer tokens. A
character that no piece covers costs ``unknown`` more than the rarest piece and counts as its UTF-8 bytes
(byte fallback).

The distinct pre-tokens of a batch, in sorted order, are the leaves of a trie walked depth first: the best score
and count at every position are kept on a stack, so each shared prefix is computed once, and only the part below
the branch is new. Counts at terminals are memoised per worker and summed per document.

Cases: null, empty and blank texts count 0 tokens; repeated rows count alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from refrain.llm.common import chunks, doc_columns

MARK = "▁"
MEMO, MEMO_CHARS = 200_000, 40
RESULT = "doc_id long, n_tokens long, n_pretokens long"


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Piece -> log-probability, from the ranks of a sentencepiece file; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    ranked.sort(key=lambda k: (-sp.get_score(k), k))
    return {sp.id_to_piece(k): -math.log(r + 2) for r, k in enumerate(ranked)}


class Trie:
    """Counts for sorted pre-tokens; ``steps`` tells how many positions were computed."""

    def __init__(self, vocabulary: dict[str, float], unknown: float = 10.0):
        self.score = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) - unknown
        prefixes: set[str] = set()
        for p in vocabulary:
            prefixes.update(p[:k] for k in range(1, len(p) + 1))
        self.suffixes = {p[k:] for p in vocabulary for k in range(len(p))}
        self.steps = 0

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word."""
        score, suffixes, longest, unknown, out = self.score, self.suffixes, self.longest, self.unknown, {}
        best: list[float] = [0.0]
        count: list[int] = [0]
        last = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                top, n = best[end - 1] + unknown, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
                for begin in range(end - 1, max(-1, end - longest - 1), -1):
                    piece = word[begin:end]
                    if piece not in suffixes:  # nor can any longer one ending here be a piece
                        break
                    s = score.get(piece)
                    if s is not None:
                        s += best[begin]
                        if s > top or (s == top and count[begin] + 1 < n):
                            top, n = s, count[begin] + 1
                best.append(top)
                count.append(n)
            self.steps += len(word) - shared
            last = word
            out[word] = count[len(word)]
        return out


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Trie, dict[str, int]]:
    return Trie(pieces(path)), {}


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token counts of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = _worker(vocabulary)
        for batch in chunks(batches):
            lists = pc.utf8_split_whitespace(pc.fill_null(batch.column(1), ""))
            bounds = np.asarray(lists.offsets, np.int64)
            coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
            bounds = bounds - bounds[0]
            words = coded.dictionary.to_pylist()
            if len(memo) > MEMO:
                memo.clear()
            found = [memo.get(w, -1) if w else 0 for w in words]
            missing = [k for k, n in enumerate(found) if n < 0]
            new = trie.counts([MARK + words[k] for k in missing])
            for k in missing:
                w = words[k]
                found[k] = new[MARK + w]
                if len(w) <= MEMO_CHARS:
                    memo[w] = found[k]
            per = np.array(found, np.int64)[np.asarray(coded.indices)] if words else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(per)])
            solid = np.concatenate([[0], np.cumsum(per > 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto[bounds[1:]] - upto[bounds[:-1]]), pa.array(solid[bounds[1:]] - solid[bounds[:-1]])], names=["doc_id", "n_tokens", "n_pretokens"])

    return doc_columns(docs).mapInArrow(run, RESULT)
