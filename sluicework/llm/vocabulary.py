"""Token ids of the public byte-level vocabulary, memoised by word.

No token of such a vocabulary holds a white-space character after another character, and the
pre-tokenizer never looks across that place either: a text may be cut after every run of
characters that aren't white space, and its pieces be encoded alone. ``PieceEncoder`` has each
new piece encoded by the tokenizers library and keeps the ids of those it has seen.
"""

from __future__ import annotations

import re
from array import array
from contextlib import suppress
from functools import lru_cache

from .common import WHITE_SPACE

PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Pieces that one worker keeps; further ones are encoded anew each time. About 200 bytes each.
KEPT = 700_000
#: ASCII marks that can end a word, without the apostrophe, which may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class Irregular(Exception):
    """A piece that was cut at a space beside other white space."""


class _Memo(dict):
    """Ids of the words seen so far; ``prefix`` is the space that stands before each, or nothing.

    A word of letters is one pre-token, so the library's merges alone are asked for it. The marks
    that end a word are a pre-token of their own, as is one line break between words.
    """

    def __init__(self, owner: PieceEncoder, prefix: str):
        self.owner, self.prefix, self.mark = owner, prefix, owner.show(prefix)
        self.tokenize = owner.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            shown = self.mark + (word if word.isascii() else self.owner.show(word))
            ids = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        else:
            core = word.rstrip(MARKS)
            if core.isalpha():
                known = core in self
                ids = self[core] + self.owner.end(word[len(core) :])
                if not known:  # most such words never come again
                    return ids
            else:
                ids = self.other(word)
        if len(self) < KEPT and len(word) < 64:
            self[word] = ids
        return ids

    def other(self, word: str) -> bytes:
        if not word or word[-1] in BLANKS or (self.prefix and word[0] in BLANKS):
            raise Irregular
        if "\n" in word:
            head, *tail = word.split("\n")
            if head and all(tail) and not any(x[0] in BLANKS or x[-1] in BLANKS for x in (head, *tail)):
                return self[head] + b"".join(self.owner.newline + self.owner.bare[x] for x in tail)
        return self.owner.whole(self.prefix + word)


class PieceEncoder:
    """``encode(text)``: what the tokenizers library gives for it, as little-endian 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.shown = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.spaced, self.bare, self.ends = _Memo(self, " "), _Memo(self, ""), {}
        self.get_spaced, self.get_bare = self.spaced.__getitem__, self.bare.__getitem__
        self.newline = self.whole("\n")

    def show(self, text: str) -> str:
        """The text's bytes as the vocabulary's printable characters."""
        return text.encode().decode("latin-1").translate(self.shown)

    def whole(self, piece: str) -> bytes:
        """By the whole library: special tokens, pre-tokenizer, merges."""
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def end(self, marks: str) -> bytes:
        if (ids := self.ends.get(marks)) is None:
            ids = self.whole(marks)
            if len(self.ends) < 10_000:
                self.ends[marks] = ids
        return ids

    def line(self, text: str) -> bytes:
        """Ids of what stands between two line breaks, with white space at neither end."""
        head, *words = text.split(" ")
        return self.get_bare(head) + b"".join(map(self.get_spaced, words))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        lines = text.split("\n") if "\n\n" not in text else [text]
        if all(lines) and not any(x[0] in BLANKS or x[-1] in BLANKS for x in lines):
            with suppress(Irregular):
                return self.newline.join(map(self.line, lines))
        out = []
        for piece in PIECE.findall(text):
            word = piece[1:]
            if piece[0] == " " and word and word[0] not in BLANKS:
                out.append(self.get_spaced(word))
            elif piece[0] in BLANKS:
                out.append(self.whole(piece))
            else:
                out.append(self.get_bare(piece))
        return b"".join(out)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    return PieceEncoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
