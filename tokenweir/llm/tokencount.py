"""Token counts under a unigram model, scored once for each shared prefix of the distinct pre-tokens.

The vocabulary is a public piece list whose order gives each piece a Zipf log-probability. A pre-token is a word with the
word mark before it. The distinct new pre-tokens of a run of texts are walked in sorted order, which visits their trie
depth first: the best forward score and token count of every prefix stand on a stack that is cut back to the common prefix
of neighbours, so each trie node is scored once. The count at a terminal node is kept; a document's count is a sum.

Ties of score go to fewer tokens. A character of no piece falls back to its UTF-8 bytes, a token each. Defined cases: a
null or empty text has 0 pre-tokens and 0 tokens; a null doc_id, repeated rows and extra columns do no harm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_views
from .tokens import vocabulary_file

MARK = "▁"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEPT = 300_000
#: Longer pre-tokens are scored, but not kept.
_KEPT_CHARS = 200


class Unigram:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        harmonic = math.log(n) + 0.5772
        self.score = {sp.id_to_piece(i): -math.log(i + 1) - math.log(harmonic) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.byte = -math.log(n + 256) - math.log(harmonic)
        self.longest = max(map(len, self.score))
        self.counts: dict[str, int] = {}

    def terminal_counts(self, words: Iterable[str]) -> dict[str, int]:
        """The token count of each word's best segmentation."""
        out, before = {}, ""
        best, count = [0.0], [0]  # of each prefix on the path
        score, longest = self.score, self.longest
        for word in sorted(words):
            marked = MARK + word
            shared, most = 0, min(len(marked), len(before))
            while shared < most and marked[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                size = len(marked[end - 1].encode())
                top, n = best[end - 1] + size * self.byte, count[end - 1] + size
                for start in range(max(0, end - longest), end):
                    s = score.get(marked[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and count[start] + 1 < n:
                            top, n = s, count[start] + 1
                best.append(top)
                count.append(n)
            out[word] = count[-1]
            before = marked
        return out

    def count(self, words: list[str]) -> list[int]:
        new = set(words).difference(self.counts)
        if new:
            if len(self.counts) + len(new) > _KEPT:
                self.counts.clear()
                new = set(words)
            found = self.terminal_counts(new)
            self.counts.update(found)
            out = list(map(self.counts.__getitem__, words))
            for w in new:
                if len(w) > _KEPT_CHARS:
                    del self.counts[w]
            return out
        return list(map(self.counts.__getitem__, words))


_MODELS: dict[str, Unigram] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _MODELS:
            _MODELS[path] = Unigram(path)
        model = _MODELS[path]
        for batch in batches:
            texts = batch.column("text")
            for first, end, _, _ in text_views(texts):
                per_text = [_WORD.findall(t or "") for t in texts.slice(first, end - first).to_pylist()]
                n = np.fromiter(map(len, per_text), np.int64, len(per_text))
                counts = np.array([0, *model.count([w for x in per_text for w in x])], np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(n), pa.array(np.diff(np.cumsum(counts)[bounds]))], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each whole text; a narrow plan without exchange."""
    path = vocabulary or vocabulary_file("piece_bpe_32k.model")
    return docs.select("doc_id", "text").mapInArrow(_counted(path), "doc_id long, n_pretokens long, n_tokens long")


def op4_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
