"""Encoding of whole documents with a published tokenizer.

A BPE merges only within a pre-token, so the ids of a text are those of its parts, cut
between pre-tokens. A lone space stands before the word that it belongs to, a lone line
feed is a pre-token of its own, and trailing punctuation is apart from a word's letters.
Each distinct part needs the tokenizer once; parts are memoised per Python worker in a
young and an elder table of bounded size: when the young one is full it becomes the elder
one, so that parts that keep coming are kept. Words of letters, with or without punctuation
after them, have pre-tokens that are known; they go to the vocabulary's model many at a time,
spelled as its pre-tokenizer would, and other parts go through the whole tokenizer. Texts with other white space (runs,
tabs, line feeds beside spaces) are cut at spaces before visible characters alone.
``tests/llm`` holds the ids and character spans against the tokenizer's own.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Distinct parts that a worker keeps at most, in two generations; about 200 bytes each.
MEMO_LIMIT = 600_000
#: Longer parts are encoded but not kept.
MEMO_PART = 48

_BEFORE_VISIBLE = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r"[^\S \n]|[ \n][ \n]|\0")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that a string lowers otherwise than letter by letter, or to more than a letter.
_CASED = "\u03a3\u0130"
#: Bytes as byte-level vocabularies spell them: visible Latin characters stand for themselves, the others for those from 256 on. Marks stay.
_VISIBLE = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
_ALPHABET = np.where(_VISIBLE, np.arange(256), 255 + np.cumsum(~_VISIBLE)).astype("<u2")
_ALPHABET[[9, 10]] = 9, 10
_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """Place of one of the installed public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The worker's encoder of this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Strings of special tokens within a text are ordinary text. A part is kept under its
    own text if a space goes before it, and under NUL and its text if not.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Vocabularies with word ends drop white space and lower the case; the others attach a space to the next word.
        self.drops_space = bool(re.search(r'"end_of_word_suffix":\s*"</w>"', self.tokenizer.to_str()))
        # The same model for text whose pre-tokens are known: they stand between white space, in the alphabet of bytes.
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        if self.drops_space:
            self.word_end = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        else:
            self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """Keys of the parts, which encode independently of each other."""
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        if _may_be_odd(text) and _ODD_SPACE.search(text):
            if "\0" in text:
                return ["\0" + text]
            first, *rest = _BEFORE_VISIBLE.split(text)
            return ["\0" + first, *rest]
        return ("\0" + text.replace("\n", " \n \0")).split(" ")

    def _text(self, key: str) -> str:
        """A part as it stands in the text."""
        if self.drops_space or key == "\n":
            return key
        return key[1:] if key[:1] == "\0" else " " + key

    def _words(self, pieces: list[str], lead: str) -> list[bytes] | None:
        """Ids of words, encoded as one text. A tab parts a word from the punctuation after it. None if letters need more care."""
        text = lead + ("\n" + lead).join(pieces) + "\n"
        if self.drops_space and not text.isascii():
            if any(c in text for c in _CASED) or not unicodedata.is_normalized("NFC", text):
                return None
        raw = (text.lower() if self.drops_space else text).encode()
        codes = np.frombuffer(raw, np.uint8)
        spelled = _ALPHABET[codes].tobytes().decode("utf-16-le")
        ids = np.array(self.plain.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        marks = np.flatnonzero(codes < 32)  # line feeds and tabs
        last = np.flatnonzero(codes[marks] == 10)  # of these, the ends of words
        if self.drops_space:  # a pre-token ends at each mark
            ends = np.flatnonzero(self.word_end[ids])[last] + 1
        else:  # tokens cover all bytes but the marks
            ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), marks[last] - last) + 1
        stop, out = (4 * ends).tolist(), ids.tobytes()
        return [out[a:b] for a, b in zip([0, *stop], stop)]

    def _apart(self, keys: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([self._text(k) for k in keys], add_special_tokens=False)]

    def _learn(self, keys: Iterable[str]) -> dict[str, bytes]:
        """Ids of parts that aren't memoised: letters and what punctuation follows them together, others one by one."""
        found, others = {}, []
        groups: dict[str, tuple[list[str], list[str]]] = {" ": ([], []), "": ([], [])}
        spaced, bare = groups[" "], groups[""]
        for key in keys:
            if self.drops_space:
                own, body = bare, key
            elif key[:1] == "\0":
                own, body = bare, key[1:]
            else:
                own, body = spaced, key
            core = body.rstrip(_PUNCTUATION)
            if core.isalpha():
                own[0].append(key)
                own[1].append(body if len(core) == len(body) else core + "\t" + body[len(core) :])
            else:
                others.append(key)
        for lead, (some, pieces) in groups.items():
            if some:
                if (coded := self._words(pieces, lead)) is None:
                    others += some
                else:
                    found.update(zip(some, coded, strict=True))
        if others:
            found.update(zip(others, self._apart(others), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none), as bytes of unsigned 32-bit integers."""
        if len(self.memo) > MEMO_LIMIT // 2:
            self.elder, self.memo = self.memo, {}
        lists = [self.parts(x) if x else [] for x in texts]
        got = [list(map(self.memo.get, parts)) for parts in lists]
        holes = [[i for i, x in enumerate(values) if x is None] for values in got]
        if missing := {parts[i] for parts, at in zip(lists, holes, strict=True) for i in at}:
            found = {k: v for k in missing if (v := self.elder.get(k)) is not None}
            found.update(self._learn(missing.difference(found)))
            self.memo.update((k, v) for k, v in found.items() if len(k) <= MEMO_PART)
            for parts, values, at in zip(lists, got, holes, strict=True):
                for i in at:
                    values[i] = found[parts[i]]
        return [b"".join(values) for values in got]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end character of each token of a text that has these ids.

        Byte-level tokens cover the text without gaps, so their lengths in bytes tell their
        places. Tokens that share the bytes of a character both span it; a space belongs to
        the word after it.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        last = np.cumsum(self.token_bytes[ids])
        if len(raw) == len(text):
            return last - self.token_bytes[ids], last
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[last - self.token_bytes[ids]], char[last - 1] + 1


def _may_be_odd(text: str) -> bool:
    """A quick test for white space other than lone spaces and line feeds, and for NUL."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable()
