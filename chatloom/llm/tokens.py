"""Token ids of whole texts by a tokenizer file, in bounded memory.

A tokenizer that splits texts before it merges gives the same ids for a piece
wherever it stands. Texts are cut into such pieces, the distinct pieces are
encoded by the ``tokenizers`` library, and a worker remembers the ids of a bounded
number of pieces. Texts that hold the string of an added token (which the library cuts
out before anything else) are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: pieces remembered in each of two generations
REMEMBERED = 500_000
#: pieces that are encoded in one call
TOGETHER = 1024
#: longer pieces are encoded each time
LONGEST = 64

#: white space as tokenizer files mean it
_WS = "\t-\r \x85\xa0  -     　"
_SPACED = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


_BARE = re.compile(f"[^{_WS}]+")
#: white space to Python alone
_ODD = "\x1c\x1d\x1e\x1f"


def bare_words(text: str) -> list[str]:
    """Words without white space, for tokenizers that drop it."""
    return _BARE.findall(text) if any(c in text for c in _ODD) else text.split()


def spaced_words(text: str) -> list[str]:
    """Words with the space before them, and other white space, for tokenizers that keep it."""
    words = text.split()
    blanks, breaks = text.count(" "), text.count("\n")
    if words and len(words) == blanks + breaks + 1 and len(text) == sum(map(len, words)) + blanks + breaks and "\0" not in text:
        # one blank or line break between any two words
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return _SPACED.findall(text)


def new_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as unsigned 32-bit integers (little-endian, as Spark's hosts are)."""

    def __init__(self, path: str):
        self.remembered = REMEMBERED
        self.tokenizer = new_tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "a a", "a\na")]
        #: blanks leave no trace: words can stand alone
        self.split = bare_words if probe[1] == probe[0] * 2 and probe[2] == probe[1] else spaced_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces; the library's result objects are large, so few are held at a time."""
        out: dict[str, bytes] = {}
        for a in range(0, len(pieces), TOGETHER):
            some = pieces[a : a + TOGETHER]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[p] = array("I", e.ids).tobytes()
        return out

    def forget(self) -> None:
        """Free the remembered pieces: workers live on after a task."""
        self.young, self.old = {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [bool(t) and any(a in t for a in self.added) for t in texts]
        cut = [[] if w or not t else self.split(t) for t, w in zip(texts, whole, strict=True)]
        known, old = self.young, self.old
        new, extra = [], []
        for p in set().union(*cut):
            if p not in known:
                ids = old.get(p)
                if ids is not None:
                    known[p] = ids
                else:
                    (new if len(p) <= LONGEST else extra).append(p)
        known.update(self._learn(new))
        table = known
        if extra:
            table = known | self._learn(extra)
        out = [b"".join(map(table.__getitem__, c)) for c in cut]
        for i in (i for i, w in enumerate(whole) if w):
            out[i] = self._learn([texts[i]])[texts[i]]
        if len(known) > self.remembered:
            self.old, self.young = known, {}
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file, which remembers ``remembered`` pieces a generation."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]
