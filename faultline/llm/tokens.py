"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

Both vocabularies split a text at white space before they merge anything, so
the ids of a text are those of its words put together. A worker remembers the
ids of words it has met (up to a bound) and gives the library only new ones,
many at a time. Texts with special-token marks or with the two bytes used as
separators here go to the library whole.
"""

from __future__ import annotations

import os
import re
import string
from itertools import islice

import numpy as np

#: Words whose ids a worker remembers.
KNOWN_WORDS = 400_000

#: White space of Unicode (fixed values), as text and as a search in UTF-8 for all that is not ASCII.
SPACES = "\t-\r \x85\xa0  -     　"
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What such white space begins with, and ASCII white space as spaces.
WIDE_STARTS, AS_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"), bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: A run of white space leaves its last space to the word that follows.
UNIT = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Separators (texts that hold them are encoded whole), and ASCII punctuation.
MARK, CUT, PUNCTUATION = b"\1", b"\0", frozenset(string.punctuation.encode())
PUNCTUATION_BYTES = string.punctuation.encode()
#: The end of a word that punctuation may be cut off from: a Latin letter or digit.
LATIN_END = re.compile("[0-9A-Za-zÀ-ÖØ-öø-ÿ]$")


def unusual(text: bytes) -> bool:
    """Whether white space stands together or is other than ASCII."""
    if b"  " in text.translate(AS_SPACE):
        return True
    return not text.isascii() and any(x in text for x in WIDE_STARTS) and WIDE.search(text) is not None


class WordTokens:
    """``blobs(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.lower = lower  # the vocabulary drops white space and case, else it keeps both
        self.mark = self.direct(MARK.decode())
        assert len(self.mark) == 4
        self.known: dict[bytes, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def units(self, text: bytes) -> list[bytes]:
        """Keys of the parts of a text whose ids, put together, are those of the text.

        A key is the part itself or, where spaces count, the part without the
        space it starts with; parts without such a space have CUT before them.
        """
        if self.lower:
            return text.lower().split()
        if unusual(text):
            return [u[1:].encode() if u[0] == " " else CUT + u.encode() for u in UNIT.findall(text.decode())]
        out = text.split(b" ")
        out[0] = CUT + out[0]
        if out[0] == CUT:
            del out[0]
        return out

    def part(self, key: bytes) -> bytes:
        return key if self.lower else key[1:] if key[:1] == CUT else b" " + key

    def learn(self, keys: list[bytes]) -> None:
        """Ask the library for parts that are not known; a stem and its punctuation are asked for apart."""
        ask, joined, known, bare = {}, [], self.known, b"" if self.lower else CUT
        for w in keys:
            stem = w.rstrip(PUNCTUATION_BYTES) if w and w[-1] in PUNCTUATION else b""
            if stem and (stem[-1:].isalnum() or (stem[-1] > 127 and LATIN_END.search(stem.decode()))):
                rest = bare + w[len(stem):]
                joined.append((w, stem, rest))
                if stem not in known:
                    ask[stem] = None
                if rest not in known:
                    ask[rest] = None
            else:
                ask[w] = None
        if not self.lower:  # punctuation first, or white space last, would join the separator
            odd = [w for w in ask if not w[-1:].isalnum() or w[:1] == CUT]
            for w in [w for w in odd if not w or w == CUT or (w[:1] == CUT and not w[1:2].isalnum()) or not (w[-1:].isalnum() or w[-1] in PUNCTUATION)]:
                if not w or w[:1] == CUT or w.decode()[-1].isspace():
                    known[w] = self.direct(self.part(w).decode())
                    del ask[w]
        if ask:
            sep = b" " + MARK + b" " if self.lower else MARK
            text = sep.join([*map(self.part, ask), b""])
            ids = np.array(self.tok.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")
            end = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0])
            if len(end) != len(ask):
                raise RuntimeError("the tokenizer merged a separator")
            raw, start = ids.tobytes(), [0, *((end[:-1] + 1) * 4).tolist()]
            known.update(zip(ask, (raw[a:b] for a, b in zip(start, (end * 4).tolist()))))
        for w, stem, rest in joined:
            known[w] = known[stem] + known[rest]

    def blobs(self, texts: list) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        known, got, open_at, need = self.known, [], [], set()
        get = known.get
        for raw in texts:
            text = bytes(raw) if raw else b""
            if b"<|" in text or MARK in text or CUT in text:
                got.append([self.direct(text.decode())])
                open_at.append(())
                continue
            units = self.units(text) if text else []
            ids = list(map(get, units))
            missing = [(i, u) for i, (u, x) in enumerate(zip(units, ids)) if x is None] if None in ids else ()
            need.update([u for _, u in missing])
            got.append(ids)
            open_at.append(missing)
        before = len(known)
        if need:
            self.learn(list(need))
            for ids, missing in zip(got, open_at):
                for i, u in missing:
                    ids[i] = known[u]
        if len(known) > KNOWN_WORDS:  # forget the newest
            for w in list(islice(known, max(before, KNOWN_WORDS), None)):
                del known[w]
        return [b"".join(ids) for ids in got]


_loaded: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(name: str, lower: bool) -> WordTokens:
    """The worker's tokenizer, kept between tasks."""
    if (name, lower) not in _loaded:
        _loaded[name, lower] = WordTokens(name, lower)
    return _loaded[name, lower]
