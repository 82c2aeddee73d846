"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

import numpy as np

from panelspark.llm.words import chunks

#: a space between two characters that are not white space: the pre-tokenizer always cuts in front of it
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: closing marks after a letter or digit are a piece of their own
CLOSED = re.compile(r"(.*[^\W_])([!-/:-@\[-`{-~]+)", re.S)
CACHE_WORDS = 500_000
CACHE_BYTES = 64_000_000
ROW_WORDS = 256
ID = array("I", [0]).itemsize

_open: dict[str, Encoder] = {}


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Words(dict):
    """Ids by word. A word that is not there is taken from ``fresh``, or stands as an empty place in ``places``."""

    def __init__(self):
        self.fresh: dict[str, bytes] = {}
        self.places: dict[str, bytearray] = {}
        #: words met more than once since places were made
        self.again: set[str] = set()
        #: a word with white space at an end was met
        self.odd = False
        #: bytes of the words and ids here and in ``fresh``
        self.held, self.held_fresh = 0, 0

    def __missing__(self, word: str) -> bytes | bytearray:
        if (ids := self.fresh.get(word)) is not None:
            self.promote(word)
            return ids
        if (place := self.places.get(word)) is not None:
            self.again.add(word)
            return place
        core = word[1:] if word[:1] == "\n" else word
        if not core or core[0].isspace() or core[-1].isspace():
            self.odd = True
            return b""
        return self.places.setdefault(word, bytearray())

    def promote(self, word: str) -> None:
        self[word] = ids = self.fresh.pop(word)
        self.held += len(word) + len(ids)
        self.held_fresh -= len(word) + len(ids)

    def add(self, new: dict[str, bytes]) -> None:
        self.fresh.update(new)
        self.held_fresh += sum(map(len, new)) + sum(map(len, new.values()))


class Encoder:
    """Encodes texts to little-endian 32-bit ids with a byte-level tokenizer file.

    The pre-tokenizer of such a file never joins what stands on both sides of a lone space or line break, so a
    text is cut there and every word is encoded once, many at a time, and remembered. The memory holds ``cache_words``
    words or ``cache_bytes`` bytes in two halves: words met once, of which the earliest are forgotten when they are too
    many, and words met again, which take the place of the former when they are; results never depend on it. So the many
    words that never come back do not push out those that do. Texts with other white space
    next to a space are cut only where it is safe. A text that holds an added token, such as an end mark, goes to the
    library whole, so that the token becomes its own id.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        #: the library's own reading, for texts with an added token; the other never meets one
        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.cache_words, self.cache_bytes = cache_words, cache_bytes
        #: "word" stands for a space and the word, "\nword" for a line break and the word
        self.known = Words()
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for piece, i in vocabulary.items() if piece[0] == "Ġ"]] = True
        self.line = np.zeros_like(self.opens)
        self.line[self.ids_of("\n")] = True

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def many_words(self, words: list[str], lead: str, borders: np.ndarray) -> list[bytes]:
        """Ids of ``lead`` + word for each word, from encodings of many in a row."""
        if not words:
            return []
        rows = [lead + lead.join(words[i : i + ROW_WORDS]) for i in range(0, len(words), ROW_WORDS)]
        found = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        at = (np.flatnonzero(borders[ids]) * ID).tolist()
        assert len(at) == len(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]

    def learn(self, missing: Iterable[str]) -> dict[str, bytes]:
        """Remember the ids of words not known yet, none of which has white space at an end."""
        known, fresh = self.known, self.known.fresh
        spaced, lined, closed, bases = set(), set(), {}, {}
        for w in missing:
            if m := CLOSED.fullmatch(w):
                closed[w] = m.groups()
                w = m[1]
                if (ids := known.get(w) or fresh.get(w)) is not None:
                    bases[w] = ids
                    continue
            (lined if w[0] == "\n" else spaced).add(w)
        spaced, lined = list(spaced), list(lined)
        new = dict(zip(spaced, self.many_words(spaced, " ", self.opens)))
        new.update(zip(lined, self.many_words([w[1:] for w in lined], "\n", self.line)))
        for w, (base, marks) in closed.items():
            if marks not in self.marks:
                self.marks[marks] = as_bytes(self.ids_of(marks))
            new[w] = (new[base] if base in new else bases[base]) + self.marks[marks]
        known.add(new)
        return new

    def forget(self) -> None:
        """Hold the memory to its bounds."""
        known, old = self.known, self.known.fresh
        if len(known) > self.cache_words // 2 or known.held > self.cache_bytes // 2:
            self.known = Words()
            self.known.add(known)
        elif len(old) > self.cache_words // 2 or known.held_fresh > self.cache_bytes // 2:
            known.fresh, known.held_fresh = {}, 0
            known.add(dict(islice(old.items(), len(old) // 2, None)))
        else:
            return
        self.marks.clear()

    def by_pieces(self, text: str) -> bytes:
        """A text with unusual white space: only lone spaces between other characters are cut."""
        head, *rest = BORDER.split(text)
        found = self.tokenizer.encode_batch([head, *[" " + w for w in rest]], add_special_tokens=False)
        return b"".join(as_bytes(e.ids) for e in found)

    def some(self, texts: list[str]) -> list[bytes]:
        self.forget()
        known, split = self.known, []
        for t in texts:
            if self.added.search(t):
                split.append(None)
                continue
            words = ("\n" + t).replace("\n", " \n").split(" ")
            del words[0]
            known.odd = False
            got = list(map(known.__getitem__, words))
            split.append((got, known.odd))
        learned = self.learn(known.places)
        for w, place in known.places.items():
            place += learned[w]
        for w in known.again:
            known.promote(w)
        known.places, known.again, out = {}, set(), []
        for t, parts in zip(texts, split):
            if parts is None:
                out.append(as_bytes(self.whole.encode(t, add_special_tokens=False).ids))
            elif parts[1]:
                out.append(self.by_pieces(t) if t else b"")
            else:
                out.append(b"".join(parts[0])[ID:])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text; null counts as empty."""
        texts = ["" if t is None else t for t in texts]
        return [ids for lo, hi in chunks(texts, len, 1 << 17) for ids in self.some(texts[lo:hi])]


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
