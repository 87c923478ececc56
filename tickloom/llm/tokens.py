"""Token ids of whole texts, by the tokenizers library, with a memo of the pieces between spaces.

A byte-level BPE never merges across a change from a non-space character to a space, so a text may
be cut in front of such spaces and each piece encoded by itself. Pieces repeat (Zipf), and the memo
answers most of them. Texts with runs of white space are cut only where the cut is safe.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Pieces that one worker remembers in one of two generations; about 300 MB for both when full.
MEMO_PIECES = 600_000
#: Marks that form one pre-token behind a word.
_MARKS = ".,;:!?|%$&*#"
#: White space that may stand before a space; the last is white space to some regex engines only.
_SPACES = tuple(
    chr(c)
    for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E)
)
_BEFORE_SPACE = tuple(c + " " for c in _SPACES)
_LOADED: dict[str, TextEncoder] = {}


class TextEncoder:
    """Encodes texts to little-endian id bytes; `dtype` is u2 when the vocabulary fits, else u4."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self._kind = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self._model = self.tokenizer.model
        self._shown = _Shown(self.tokenizer.pre_tokenizer)
        self._memo, self._starts = _Memo(self._after_space), _Memo(self._line_start)
        self._marks = _Memo(self._plain)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        if any(x in text for x in _BEFORE_SPACE):
            return b"".join(map(self._plain, _safe_pieces(words)))
        memo = self._memo
        return self._plain(words[0]) + b"".join([memo[w] for w in words[1:]])

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)

    def _plain(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids) if piece else b""

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self._kind, ids).tobytes()

    def _after_space(self, word: str) -> bytes:
        """Ids of a space and word. Line ends inside a word, each between other characters, are
        pre-tokens of their own."""
        if "\n" in word:
            first, *rest = word.split("\n")
            if first and all(rest) and not any(x[-1] in _SPACES or x[0] in _SPACES for x in (first, *rest)):
                return self._memo[first] + b"".join([self._marks["\n"] + self._starts[x] for x in rest])
        return self._word(" ", word)

    def _line_start(self, word: str) -> bytes:
        return self._word("", word)

    def _word(self, space: str, word: str) -> bytes:
        """A word of Latin letters is one pre-token (with the space), the marks behind it another:
        these go straight to the model."""
        body = word.rstrip(_MARKS)
        if body.isalpha() and (body.isascii() or max(body) < "ɐ"):
            found = [t.id for t in self._model.tokenize((space + body).translate(self._shown))]
            return self._bytes(found) + self._marks[word[len(body) :]]
        return self._plain(space + word)


class _Shown(dict):
    """Character to its byte-level spelling, as the pre-tokenizer gives it."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self._pre_tokenizer = pre_tokenizer

    def __missing__(self, char: int) -> str:
        shown = self[char] = "".join(s for s, _ in self._pre_tokenizer.pre_tokenize_str(chr(char)))
        return shown


class _Memo(dict):
    """Remembers results in two generations: what was used since the last change is kept."""

    def __init__(self, find):
        super().__init__()
        self._find, self._older = find, {}

    def __missing__(self, word: str) -> bytes:
        found = self._older.get(word)
        if found is None:
            found = self._find(word)
        if len(word) <= 64:
            if len(self) >= MEMO_PIECES:
                self._older = dict(self)
                self.clear()
            self[word] = found
        return found


def _safe_pieces(words: list[str]) -> list[str]:
    pieces: list[str] = []
    run = [words[0]]
    for word in words[1:]:
        last = run[-1]
        if last and last[-1] not in _SPACES:
            pieces.append(" ".join(run))
            run = ["", word]
        else:
            run.append(word)
    pieces.append(" ".join(run))
    return pieces


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
