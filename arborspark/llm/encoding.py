"""Token ids of whole texts: pieces are cut by Arrow, and the tokenizer's model encodes each new piece once.

Both vocabularies merge only inside the pieces that their pre-tokenizer cuts, so
the ids of a text are the ids of its pieces in order.  Texts made of characters
whose classes are the same in every Unicode version are cut here, a batch at a
time; any other text (odd spacing, other scripts, a special token) goes to the
tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_memory

#: Latin letters, digits and marks whose Unicode class has never changed, and whose lower case is among them.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_NUMBER = "0-9²³¹¼-¾"
_MARK = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷–-―‘-„•…€"
_ODD = f"[^ \\t\\n\\r{_LETTER}{_NUMBER}{_MARK}]|<\\|"
#: A space that no word follows: the pre-tokenizer then looks at more than one piece.
_SPACED = " (?:\\s|\\z)"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"

#: The pieces of each vocabulary's pre-tokenizer (white space before a piece of "words" has no ids).
_PIECES = {
    "bytes": f"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s\\x00{_LETTER}{_NUMBER}]+|[\\t\\n\\r]+",
    "words": f"\\s*(?:{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^\\s\\x00{_LETTER}{_NUMBER}]+)",
}

#: The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_AS_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BLOCK, _SLICE = 1 << 19, 4 << 20


class Encoder:
    """encode(texts) -> the number of ids of each text, and all ids (unsigned 32-bit) in a row.

    kind: "bytes" for byte_bpe files, "words" for lower-casing word_bpe files.
    memo: most pieces in one of the memo's two generations; a full young
    generation becomes the old one, from which pieces in use are taken over.
    """

    def __init__(self, path: str, kind: str, memo: int = 100_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.pattern, self.words, self.most, self.slice_bytes = _PIECES[kind], kind == "words", memo, _SLICE
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the memo's memory back, and a tokenizer's that is not kept; called where a task ends, for workers live on."""
        self.young, self.old = {}, {}
        if self not in _encoders.values():
            self.tokenizer = self.model = None
        release_memory()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.words:
            piece = piece.strip()
        if piece.isascii() and piece[1:].isalnum():
            piece = "Ġ" + piece[1:] if piece[0] == " " else piece
        else:
            piece = piece.encode().decode("latin-1").translate(_AS_BYTES)
        return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                p = pieces[i]
                ids = old.get(p)
                found[i] = young[p] = self._piece(p) if ids is None else ids
        if len(young) > self.most:
            self.old, self.young = young, {}
        return found

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of plain texts; the last of a text is empty or white space without ids."""
        if self.words:
            texts = pc.utf8_lower(texts)
        else:  # of a run of line ends before a word, the last is a piece of its own
            texts = pc.replace_substring_regex(texts, pattern="([\\t\\n\\r])([^\\s])", replacement="\x00\\1\x00\\2")
        return pc.split_pattern(pc.replace_substring_regex(texts, pattern=self.pattern, replacement="\\0\x00"), "\x00")

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Null is the empty text.  end_id, if given, follows the ids of every text."""
        parts, at = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))], 0
        until = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(texts):  # a few MB at a time
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + self.slice_bytes, "right")))
            parts.append(self._encode(pc.fill_null(texts[at:stop], ""), end_id))
            at = stop
            pa.default_memory_pool().release_unused()
        return np.concatenate([n for n, _ in parts]), np.concatenate([ids for _, ids in parts])

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD)
        if not self.words:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _SPACED))
        cut = self._cut(pc.if_else(odd, "", texts))
        bounds = cut.offsets.to_numpy().astype(np.int64)
        named = cut.flatten().dictionary_encode()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        values = self._pieces(named.dictionary.to_pylist())
        codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds -= bounds[0]
        codes[bounds[1:] - 1] = len(values)
        values.append(end)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            codes[bounds[i]] = len(values)
            values.append(self._whole(texts[int(i)].as_py()) + end)

        table = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        firsts = np.cumsum(sizes) - sizes
        until = np.concatenate([[0], np.cumsum(sizes[codes])])
        ids = np.empty(int(until[-1]), np.uint32)
        for at in range(0, len(codes), _BLOCK):
            part, stop = codes[at : at + _BLOCK], min(at + _BLOCK, len(codes))
            place = np.repeat(firsts[part] - until[at:stop], sizes[part]) + np.arange(until[at], until[stop])
            ids[until[at] : until[stop]] = table[place]
        return np.diff(until[bounds]), ids


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str, keep: bool = True) -> Encoder:
    """The Python worker's encoder: tasks share the tokenizer, or without `keep` it ends with the task."""
    if (path, kind) in _encoders:
        return _encoders[path, kind]
    made = Encoder(path, kind)
    release_memory()  # what reading the file took
    if keep:
        _encoders[path, kind] = made
    return made
