"""Whole-text encoding by a public tokenizer, with a bounded memo of space-delimited pieces.

The tokenizers library encodes each distinct piece once; a text's ids are its
pieces' ids in order.  That equals the library's ids for the whole text when no
token can reach across the places where the text is cut, which ``ids`` decides;
every other text goes to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Pieces that a worker keeps at most (some 200 bytes each), unless a caller says otherwise, and the longest one kept (in characters); others are encoded each time they come.
MEMO_PIECES, MEMO_LENGTH = 150_000, 64
#: Two spaces in a row or a space beside another white space: the byte-level pattern looks past the cut there.
_CLOSE = re.compile(r"\s \s?|\s ")
#: Latin letters whose lower case is one letter (U+0130 has two), and marks but the apostrophe, which begins contractions.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f", "!-&(-/:-@\\[-`{-~"
#: Runs that are one token of either pattern: letters, marks, and single line ends before a letter.
_RUNS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|\n(?=[{_LETTERS}])")
_WORD = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from U+0100 on.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: b if b in _SELF else 256 + sum(x not in _SELF for x in range(b)) for b in range(256)}

_encoders: dict[str, Encoder] = {}


def encoder(path: str, pieces: int = MEMO_PIECES) -> Encoder:
    """The worker's encoder of the tokenizer file at path; its memo of so many pieces serves all the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].pieces = pieces
    return _encoders[path]


class Encoder:
    """ids(text) of the tokenizer file at path, as numpy uint32 arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.leading = "Split" not in repr(self.tok.pre_tokenizer)  # byte-level pieces keep the space before a word
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.pieces = MEMO_PIECES
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, text: str) -> bytes:
        """Ids of one token of the pattern, in the byte-level alphabet where it is not ASCII letters or marks."""
        if not text.isascii() or text[0] in " \n":
            text = text.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) >= 10_000:
                return self._run(text)
            self.marks[text] = b"" if text == "\n" and not self.leading else self._run(text)
        return self.marks[text]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece between spaces, that before it included."""
        if m := _WORD.fullmatch(piece):
            word, marks = m.groups()
            ids = self._run(" " + word if self.leading else word.lower())
            return ids + self._mark(marks) if marks else ids
        runs = _RUNS.findall(piece)
        if not runs or sum(map(len, runs)) != len(piece) or not runs[0][0].isalpha():
            return self.whole(" " + piece if self.leading else piece)
        ids = self._run(" " + runs[0] if self.leading else runs[0].lower())
        for x in runs[1:]:
            ids += self._run(x if self.leading else x.lower()) if x[0].isalpha() else self._mark(x)
        return ids

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(t in text for t in self.special) or (self.leading and (text[0] == " " or _CLOSE.search(text))):
            return np.frombuffer(self.whole(text), np.uint32)
        memo, get = self.memo, self.memo.get
        pieces = text.split(" ")
        out = [*map(get, pieces)]
        if None in out:
            for i in [i for i, x in enumerate(out) if x is None]:
                p = pieces[i]
                out[i] = x = get(p)
                if x is None:
                    out[i] = x = self._piece(p)
                    if len(memo) < self.pieces and len(p) <= MEMO_LENGTH:
                        memo[p] = x
        if self.leading:  # the first piece has no space before it
            out[0] = self.whole(pieces[0])
        return np.frombuffer(b"".join(out), np.uint32)
