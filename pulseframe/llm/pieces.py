"""A bounded table of the token ids of white-space separated pieces.

Texts are joined from the ids of their pieces, since the tokenizers served here
never merge across white space. Arrow cuts a batch at ASCII white space and
numbers its pieces, so that Python handles each distinct one once. Unseen pieces
are learned many at once, and in parts: closing marks apart from the word before
them, ASCII words in lower case, so that a word met in another form costs no
merges. Most of that is done on a batch's bytes before its pieces are numbered.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ASCII marks that never join a letter before them (an apostrophe may).
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def cut_marks(piece: str) -> tuple[str, str]:
    """``piece`` as a stem and its closing marks; the ids of both, joined, are
    those of ``piece``. No marks where the stem's last letter could change."""
    stem = piece.rstrip(MARKS)
    last = stem[-1:] if piece.isascii() else unicodedata.normalize("NFC", stem).lower()[-1:]
    return (stem, piece[len(stem):]) if last.isalpha() else (piece, "")


_UPPER, _LOWER, _MARK = 1, 2, 4  # classes of bytes
_CLASS = bytes(_UPPER if 65 <= c <= 90 else _LOWER if 97 <= c <= 122 else _MARK if chr(c) in MARKS else 0 for c in range(256))


def tamed(texts: pa.Array) -> pa.Array:
    """``texts`` (large strings) with ASCII and Latin-1 letters in lower case and
    a space between such a letter and a mark: their ids stay the same."""
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, len(texts) + 1)
    data = data.to_pybytes()[:offs[-1]] if data else b""
    if not data:
        return texts
    b, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_CLASS), np.uint8)
    upper, letter = kind == _UPPER, kind & (_UPPER | _LOWER) != 0
    last = np.flatnonzero(b[:-1] == 0xC3) + 1          # the last bytes of U+00C0 to U+00FF
    last = last[(b[last] != 0x97) & (b[last] != 0xB7)]  # no letters: multiplication and division signs
    upper[last], letter[last] = b[last] <= 0x9E, True
    # Combining marks (U+0300 and above) could join the capital, not its small letter.
    upper[:-1] &= b[1:] < 0xCC
    cut = np.flatnonzero(letter[:-1] & (kind[1:] == _MARK)) + 1
    made = np.full(len(b) + len(cut), 32, np.uint8)
    old = np.ones(len(made), bool)
    old[cut + np.arange(len(cut))] = False
    made[old] = b + (upper.view(np.uint8) << np.uint8(5))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offs + np.searchsorted(cut, offs)), pa.py_buffer(made))


class PieceTable:
    """Ids (as bytes) of at most ``limit`` pieces, beside those of the batch at
    hand; ``learn`` gives the ids of unseen strings."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], special: Callable[[str], bool], limit: int):
        self.learn, self.special, self.limit = learn, special, limit
        self.kept: dict[str, bytes] = {}
        self.again: set[str] = set()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        text, joined = pa.array(texts, pa.large_string()), " ".join(texts)
        if not (self.special(joined) or self.special(joined.lower())):
            text = tamed(text)
        lists = pc.ascii_split_whitespace(text)
        coded = lists.values.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = self.found(names)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        first, n = (np.cumsum(size) - size)[codes], size[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        cut = ends[lists.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cut, cut[1:])]

    def found(self, names: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.kept.get, names))
        new = [p for p, x in zip(names, found) if x is None]
        self.again.update(compress(names, found))
        if len(new) + len(self.kept) > self.limit:
            # Keep what later batches asked for again; most pieces occur once.
            self.kept = {p: self.kept[p] for p in self.again if p in self.kept} if 2 * len(self.again) < self.limit else {}
            self.again = set()
        self.kept[""] = b""  # before and after white space at a text's ends
        self.add([p for p in new if p])
        return [self.kept[p] if x is None else x for p, x in zip(names, found)]

    def add(self, new) -> None:
        kept, need, forms, text = self.kept, {}, [], " ".join(new)
        any_special = self.special(text) or self.special(text.lower())
        for p in new:
            q, marks = p.lower() if p.isascii() else p, ""
            # Special tokens are told by case: their names in another case are plain text.
            if any_special and (self.special(p) or self.special(q)):
                q = p
            elif not q.isalpha():
                q, marks = cut_marks(q)
            if marks or q != p:
                forms.append((p, q, marks))
                if marks and marks not in kept:
                    need[marks] = None
            if q not in kept:
                need[q] = None
        kept.update(zip(need, self.learn(list(need))))
        for p, q, marks in forms:
            kept[p] = kept[q] + kept[marks] if marks else kept[q]
