r"""Token counts of whole texts by overlap resynchronisation.

A document of more than ``chunk`` characters is cut into chunks that overlap, and the
tokenizer encodes each of them with offsets. Two neighbours are spliced at a place where
both have a token that begins there, both agree on the tokens around it, and which is
proven stable: it follows a space, tab or line break and is an ASCII character. The
tokenizer drops white space, so no token lies across such a place; an ASCII character
begins a composition of its own, so the normaliser leaves what stands before it alone;
and its added tokens, which hold no white space and strip none, end before it (the
constructor checks this, and without it nothing counts as stable). What stands on one
side thus never changes the tokens of the other. Without such a place in the overlap the
overlap doubles, then the chunk grows, in the end to the whole rest of the document.

Shorter documents are encoded piece by piece, between white space, by the tokenizer
itself; recent pieces are kept in a bounded memory (``pieces``).

Defined results: null and empty text have 0 bytes and 0 tokens; whole texts count
however long; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from blockstrata.llm.common import id_text, map_rows, utf8
from blockstrata.llm.pieces import PieceMemory

#: Characters of a chunk and of an overlap at first, and tokens around a splice on which both encodings agree.
CHUNK, OVERLAP, AGREE = 8192, 512, 4
LIMIT = 2048


class Encoder:
    """Counts tokens of words, asking the tokenizer for those it has not met lately."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = PieceMemory(self._new, limit)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.provable = not any(t.lstrip or t.rstrip or t.content.split() != [t.content] for t in added)

    def _new(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of short texts, piece by piece between white space."""
        return self.memory.ids(texts)[1].tolist()

    def tokens(self, text: str, start: int, stop: int) -> tuple[list[int], list[int]]:
        """Where the tokens of one chunk begin in the text, and their ids."""
        got = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        return [start + a for a, _ in got.offsets], got.ids


def splice(text: str, ours: tuple[list[int], list[int]], theirs: tuple[list[int], list[int]], low: int) -> tuple[int, int, int] | None:
    """A stable place in the overlap of two encodings, the last but a few, and the numbers of its token in both; None if there is none."""
    (a, x), (b, y) = ours, theirs
    for i in range(len(a) - AGREE, -1, -1):
        at = a[i]
        if at <= low:
            break
        if text[at] < "\x80" and text[at - 1] in " \t\n\r":
            j = bisect_left(b, at)
            near = min(AGREE, j)
            if j < len(b) and b[j] == at and x[i - near : i + AGREE] == y[j - near : j + AGREE] and (not i or a[i - 1] < at) and (not j or b[j - 1] < at):
                return at, i, j
    return None


def count_tokens(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a whole text; a long one chunk by chunk."""
    n = len(text)
    if n <= chunk:
        return encoder.counts([text])[0]
    total, first, start, end, lap = 0, 0, 0, chunk, overlap
    ours = encoder.tokens(text, start, end)  # of which those from ``first`` on are not counted yet
    while end < n:
        low = max(end - lap, start)
        stop = min(n, low + max(chunk, 2 * lap))
        theirs = encoder.tokens(text, low, stop) if low > start else ours
        found = splice(text, ours, theirs, low) if low > start and encoder.provable else None
        if found and found[1] >= first:
            _, i, j = found
            total += i - first
            ours, first, start, end, lap = theirs, j, low, stop, overlap
        elif low > start:  # alignment failed: widen the overlap
            lap *= 2
        else:  # up to the whole chunk: then the chunk itself grows; what is counted stays so, it ends at a stable place
            end = min(n, end + (end - start))
            ours = encoder.tokens(text, start, end)
            lap = overlap
    return total + len(ours[0]) - first


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a worker process, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_documents(docs: DataFrame, vocabulary: Callable[[], str], limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    ``vocabulary`` gives the path of the tokenizer file on the worker that calls it.
    """

    def make():
        own = encoder(vocabulary())

        def run(ids, texts):
            texts = [utf8(t).decode() for t in texts]
            short = iter(own.counts([t for t in texts if len(t) <= chunk]))
            n = [next(short) if len(t) <= chunk else count_tokens(own, t, chunk, overlap) for t in texts]
            return {"doc_id": ids, "n_bytes": [len(utf8(t)) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, rows=500)
