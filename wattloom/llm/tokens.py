"""Tokenizers inside tasks: pieces of text that encode independently, and worker caches over them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np

# Both kinds of vocabulary end a pre-token before a space that is followed by a character that is not white
# space, and no special string holds a space, so a text may be cut there and the pieces encoded one by one.
# Python's \s holds all of Unicode's white space and four control characters more; where the two differ
# nothing is cut, which is always safe.
CUT = re.compile(r"(?= \S)")
NO_CUT = re.compile(r" (?!\S)")


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str):
    """The library's tokenizer of a vocabulary file of ``public_tokenizers``, or of a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))


def pieces(text: str) -> list[str]:
    # where every space may be cut, plain string methods do it in a fifth of the time
    return CUT.split(text) if "\0" in text or NO_CUT.search(text) else text.replace(" ", "\0 ").split("\0")


class PieceIds:
    """Ids of texts as little-endian unsigned 32-bit integers; remembers up to ``bound`` pieces."""

    def __init__(self, vocabulary: str, bound: int = 2_000_000):
        known = tokenizer(vocabulary)
        self.encode, self.fast, self.bound, self.known = known.encode, known.encode_batch_fast, bound, {}
        # a special string that ends whatever is around it, and its id; a normalizer would start anew after each
        plain = ((i, t.content) for i, t in known.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word))
        self.end = next(plain, None) if known.normalizer is None else None

    def _learn(self, pieces: set[str]) -> None:
        """Encodes new pieces. Those with a space in front only are encoded together, as one text, as that is
        where a text may be cut; with a special string after each, whose id then ends the piece's ids, or else ids
        go to the piece in which their first character lies."""
        end, text = self.end or (None, None)
        alone = [p for p in pieces if not (len(p) > 1 and p[0] == " " and p.count(" ") == 1) or text and text in p]
        for p in alone:
            self.known[p] = np.array(self.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
        joint = list(pieces.difference(alone))
        if joint and text:
            found = np.array(self.fast([text.join([*joint, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends, ids = np.flatnonzero(found == end).tolist(), found.tobytes()
            self.known.update((p, ids[4 * a : 4 * b]) for p, a, b in zip(joint, [0, *(b + 1 for b in ends)], ends))
        elif joint:
            found = self.encode("".join(joint), add_special_tokens=False)
            starts = np.fromiter(map(itemgetter(0), found.offsets), dtype=np.int64)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(starts, np.cumsum([len(p) for p in joint])).tolist()
            self.known.update((p, ids[4 * a : 4 * b]) for p, a, b in zip(joint, [0, *ends], ends))

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of a few texts, nothing added; a null text has none."""
        cut = [pieces(t) if t else [] for t in texts]
        needed = set().union(*cut)
        if len(self.known) >= self.bound:
            self.known.clear()
        new = needed.difference(self.known)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, ps)) for ps in cut]
        for p in new:
            if len(p) > 64:
                del self.known[p]
        return out

    def each(self, texts: list[str | None], chars: int = 500_000) -> Iterator[bytes]:
        """Ids of any number of texts, some of them at a time."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and size < chars:
                size += len(texts[j] or "")
                j += 1
            yield from self.of(texts[i:j])
            i = j


@lru_cache(maxsize=4)
def piece_ids(vocabulary: str, bound: int = 2_000_000) -> PieceIds:
    """One cache a worker process."""
    return PieceIds(vocabulary, bound)
