"""Encoding of whole texts with a public tokenizer file, with a word cache.

``Encoder`` gives exactly the ids of ``Tokenizer.encode_batch`` without special
tokens. A text is cut where no token can cross (before a single space or line feed
between two visible characters, or at a space where white space is dropped), so that
each word is sent to the library once and later served from a bounded cache. A text
that holds an added token such as <|endoftext|> goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Unicode White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
CACHE_ENTRIES = 400_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: Letters that every normaliser and pattern of these files treats alike, then ASCII marks.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def _shown() -> dict[int, int]:
    """Byte-level files write each byte as a visible character; the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in visible), range(256, 512)))


_SHOWN = _shown()


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added, self.added_normal = [t.content for t in added], [t.content.lower() for t in added if t.normalized]
        self.limit = cache_entries
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        cutting = [x.get("type") for x in pre.get("pretokenizers", [])]
        self.dropped = steps == ["NFC", "Replace", "Lowercase"] and cutting == ["Split", "ByteLevel"]
        self.model = self.library.model
        self.marks: dict[str, bytes] = {}
        self.line_feed = self._piece("Ċ") if self.spaced else b""

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> bool:
        """Put words into the cache: simple ones by their letters and marks, others as texts.

        A word stands after a space, or after the line feed that it starts with.
        False if a word has white space at an edge, where tokens may cross.
        """
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
        words, odd, lead = self.words, [], "Ġ" if self.spaced else ""
        for w in new:
            if w.isascii() and w.isalpha():
                words[w] = self._piece(lead + (w.lower() if self.dropped else w))
                continue
            lined = self.spaced and w[:1] == "\n"
            if not (m := _SIMPLE.fullmatch(w, lined)):
                odd.append(w)
                continue
            letters, marks = m.groups()
            if self.dropped:
                letters = letters.lower()
            if lined:
                ids = self.line_feed + self._piece(letters.encode().decode("latin-1").translate(_SHOWN))
            elif (ids := words.get(letters)) is None:
                ids = words[letters] = self._piece(lead + letters.encode().decode("latin-1").translate(_SHOWN))
            if marks:
                if (more := self.marks.get(marks)) is None:
                    more = self._piece(marks)
                    if len(marks) < 8:
                        self.marks[marks] = more
                ids += more
            words[w] = ids
        if self.spaced:
            for w in odd:
                body = w.removeprefix("\n")
                if not body or body[0] in WHITE or body[-1] in WHITE:
                    return False
            words.update(zip(odd, self.plain([w if w[0] == "\n" else " " + w for w in odd]), strict=True))
        elif odd:
            words.update(zip(odd, self.plain(odd), strict=True))
        return True

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, words: list[str]) -> bytes | None:
        new = set(words).difference(self.words)
        if new and not self._learn(list(new)):
            return None
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:  # the cache was emptied for the new words
            self._learn(list(set(words).difference(self.words)))
            return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """ids of one whole text; a null text has none."""
        if not text:
            return b""
        if any(t in text for t in self.added) or (self.added_normal and any(t in text.lower() for t in self.added_normal)):
            return self.plain([text])[0]
        if self.spaced and text[0] not in WHITE:
            head, *rest = text.replace("\n", " \n").split(" ")
            if len(rest) <= self.limit // 4 and (ids := self._known(rest)) is not None:
                return self.plain([head])[0] + ids
        elif self.dropped:
            words = text.replace("\n", " ").split(" ")
            if len(words) <= self.limit // 4:
                return self._known(words)
        return self.plain([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
