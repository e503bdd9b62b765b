"""Token ids of whole texts by the tokenizers library, in Arrow and numpy, with a bounded memo of words.

Both pre-tokenizers cut at white space, so a text's ids are the ids of its words in order. Words of a slice of texts are
split and numbered by Arrow; only the distinct ones meet Python, and only those that the memo lacks meet the tokenizer. A word of
letters is one pre-token and goes straight to the tokenizer's model, any other one through the whole tokenizer.
A run of ASCII marks after a letter or digit is a pre-token of its own in both vocabularies, so a word that ends in one is
two pieces. Texts that name a special token, hold control characters that mark pieces here, or (byte level) have white space
other than single spaces and line feeds inside, are encoded whole.

At byte level ``FIRST`` + word begins a text or a line, and any other word follows a space. ``MARK`` + marks are the marks at a
word's end, ``END`` ends a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 400_000
MEMO_CHARS = 16 * MEMO_WORDS
END_ID = 1
MARK, END, FIRST = "\1", "\2", "\3"
_MARKED = r"([\p{L}\p{N}])([!-&(-/:-@\[-^`{-~]+)$"
_SPACES = r"\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = {"byte": rf"<\||[\x00-\x03{_SPACES}]|[ \n][ \n]|^[ \n]|[ \n]$", "word": r"<\||[\x00-\x03İΣ]"}
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level vocabularies write printable bytes as themselves, the others as the code points from 256 on.
_BYTES = {b: b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b)) for b in range(256)}

_encoders: dict[str, "Encoder"] = {}


class _Pieces:
    """Piece -> its ids, which stand end to end in one array."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.begin, self.size, self.ids, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        first = len(self.slot)
        self.slot.update(zip(pieces, range(first, first + len(pieces))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        self.chars += sum(map(len, pieces))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, ends = _ragged(self.begin, self.size, slots)
        return self.ids[at], ends


def _ragged(begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the runs ``which``, one run after another, and where each run ends."""
    n = size[which]
    ends = np.cumsum(n)
    return np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), ends


class Encoder:
    """kind "byte": byte-level BPE, a space belongs to the word after it. kind "word": white space is dropped, letters are lower-cased."""

    def __init__(self, path: str, kind: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.end_id = Tokenizer.from_file(path), kind, end_id
        self.model = self.tokenizer.model
        self.memo = self._seeded()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _seeded(self) -> _Pieces:
        memo, feed = _Pieces(), self.whole("\n")
        memo.add(["", FIRST, END, MARK + "\n"], np.array([self.end_id, *feed], np.uint32), np.array([0, 0, 1, len(feed)], np.int64))
        return memo

    def _learn(self, pieces: list[str]) -> None:
        tokenize, lower, ids, ends = self.model.tokenize, self.kind == "word", [], []
        space, lead = ("", "") if lower else (" ", "Ġ")
        for piece in pieces:
            bare = piece[0] <= FIRST
            word = piece[1:] if bare else piece
            if not word.isalpha() or lower and not unicodedata.is_normalized("NFC", word):
                ids.extend(self.whole(word if bare else space + word))
            else:
                word = word.lower() if lower else word
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTES)
                ids.extend([t.id for t in tokenize(word if bare else lead + word)])
            ends.append(len(ids))
        self.memo.add(pieces, np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0))

    def _slots(self, pieces: list[str]) -> np.ndarray:
        if len(self.memo.slot) > MEMO_WORDS or self.memo.chars > MEMO_CHARS:  # what this slice needs stays
            old, self.memo = self.memo, self._seeded()
            stay = [w for w in pieces if w in old.slot and w not in self.memo.slot]
            ids, ends = old.gather(np.array([old.slot[w] for w in stay], np.int64))
            self.memo.add(stay, ids, np.diff(ends, prepend=0))
        slots = np.fromiter(map(self.memo.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = len(self.memo.slot) + np.arange(len(missing))
            self._learn([pieces[k] for k in missing.tolist()])
        return slots

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; the place where each text's ids begin, and the end)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD[self.kind])
        plain = pc.if_else(odd, "", texts)
        if self.kind == "byte":
            plain = pc.binary_join_element_wise(FIRST, pc.replace_substring(plain, "\n", " \n"), "")
        else:
            plain = pc.ascii_lower(pc.replace_substring(plain, "\n", " "))
        words = pc.split_pattern(pc.binary_join_element_wise(plain, END, " "), " ")
        coded = words.flatten().dictionary_encode()
        split = pc.replace_substring_regex(coded.dictionary, _MARKED, rf"\1 {MARK}\2")
        if self.kind == "byte":
            split = pc.replace_substring_regex(split, r"^\n", f"{MARK}\n {FIRST}")
        pieces = pc.split_pattern(split, " ")
        kinds = pieces.flatten().dictionary_encode()
        slots = self._slots(kinds.dictionary.to_pylist())[kinds.indices.to_numpy()]
        edge = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        at, word_ends = _ragged(edge[:-1], np.diff(edge), coded.indices.to_numpy())
        ids, piece_ends = self.memo.gather(slots[at])
        last = words.offsets.to_numpy().astype(np.int64)[1:] - words.offsets[0].as_py() - 1
        cuts = np.concatenate([[0], piece_ends[word_ends[last] - 1]])
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            parts = np.split(ids, cuts[1:-1])
            for k in whole.tolist():
                parts[k] = np.array([*self.whole(texts[k].as_py()), self.end_id], np.uint32)
            ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
        return ids, cuts


def encoder(path: str, kind: str) -> Encoder:
    """One per worker process, path and kind."""
    key = f"{kind}:{path}"
    if key not in _encoders:
        _encoders[key] = Encoder(path, kind)
    return _encoders[key]


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts of about ``size`` bytes."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = done = 0
    while begin < len(upto):
        end = min(len(upto), int(np.searchsorted(upto, done + size)) + 1)
        yield begin, end
        begin, done = end, int(upto[end - 1])


def encode_slices(texts: pa.Array, path: str, kind: str, size: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, ids, cuts) in order, in slices of about ``size`` bytes, so memory does not follow the batch."""
    encode = encoder(path, kind)
    for begin, end in slices(texts, size):
        yield begin, end, *encode(texts.slice(begin, end - begin))


def token_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
