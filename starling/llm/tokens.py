"""Token ids of whole texts by a public byte-level BPE, with an exact cache of pieces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: id appended to each document (a fixed value of the file format).
END_ID = 0


def public(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level BPE splits a text without inner white space (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def visible() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(others)}


#: Marks that may follow a word and never start a contraction by themselves (fixed value).
TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Unsafe(Exception):
    """A piece that white space touches at an end; the text around it has to be encoded at once."""


class _Pieces(dict):
    """Ids, as bytes, of pieces with a prefix put before each."""

    def __init__(self, raw, prefix: str, most: int) -> None:
        super().__init__()
        self.raw, self.prefix, self.most = raw, prefix, most
        self.tails, self.lines = self, None

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():  # one pre-token
            ids = array("I", [t.id for t in self.tokenize(self.shown + piece)]).tobytes()
            if len(self) < self.most:
                self[piece] = ids
            return ids
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Unsafe
        if "\n" in piece and self.lines is not None:
            head, *lines = piece.split("\n")
            return self.line_feed.join([self[head], *map(self.lines.__getitem__, lines)])
        core = piece.rstrip(TAILS)
        if core != piece and core and core[-1].isalnum():  # a pre-token ends there
            ids = self[core] + self.tails[piece[len(core) :]]
        else:
            ids = self.raw(self.prefix + piece)
        if len(self) < self.most:  # the frequent ones come early
            self[piece] = ids
        return ids


class Encoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE does.

    Its pre-tokenizer splits at every single space or line feed between two characters that aren't white space: the
    space goes with what follows, the line feed stands alone. So pieces cut there encode on their own and are
    remembered, up to a bound. Texts where white space meets white space, or an end, and texts that hold the string of
    an added token, are encoded whole.
    """

    def __init__(self, path: str | None = None, most: int = 800_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public())
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.added = "|".join(map(re.escape, added)) or None
        self.model = self.tokenizer.model
        self.split = regex.compile(PATTERN).findall
        shown = visible()
        self.visible = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}
        self.heads, self.rest = _Pieces(self.piece, "", most // 3), _Pieces(self.piece, " ", most)
        for pieces in (self.heads, self.rest):
            pieces.tokenize, pieces.shown = self.model.tokenize, self.visible[0x20] if pieces.prefix else ""
            pieces.tails, pieces.lines, pieces.line_feed = self.heads, self.heads, self.raw("\n")

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of a short text without inner white space: the library's model on each pre-token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.raw(text)  # leave letters and digits of other scripts to the library's own tables
        parts = [text] if text.isalpha() or text[0] == " " and text[1:].isalpha() else self.split(text)
        return array("I", [t.id for part in parts for t in self.model.tokenize(part.translate(self.visible))]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.documents([text], end=False)[0]

    def safe(self, pieces: _Pieces, piece: str) -> bytes | None:
        try:
            return pieces[piece]
        except Unsafe:
            return None

    def special(self, column: pa.Array) -> np.ndarray | None:
        """Which texts hold the string of an added token; None if none does."""
        if self.added is None:
            return None
        found = pc.match_substring_regex(column, self.added).to_numpy(zero_copy_only=False)
        return found if found.any() else None

    def documents(self, texts: Iterable[str | None], end: bool = True) -> list[np.ndarray]:
        """The ids of each text (null: none), with the end id.

        Arrow splits the texts at spaces and numbers the different pieces; only these are looked up one by one.
        """
        column = pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")
        if not len(column):
            return []
        special = self.special(column)
        parts = pc.split_pattern(column, " ")
        coded = parts.flatten().dictionary_encode()
        codes, offsets = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = codes[offsets[:-1]]
        codes[offsets[:-1]] = len(pieces) + np.arange(len(column))  # no space stands before a text's first piece
        heads = [pieces[k] for k in first.tolist()]
        try:
            found, whole = [*map(self.rest.__getitem__, pieces), *map(self.heads.__getitem__, heads)], None
        except Unsafe:
            found = [self.safe(self.rest, x) for x in pieces]
            found += [b"" if not x and n == 1 else self.safe(self.heads, x) for x, n in zip(heads, np.diff(offsets).tolist(), strict=True)]
            whole = np.logical_or.reduceat(np.array([x is None for x in found])[codes], offsets[:-1])
            found = [x or b"" for x in found]
        if special is not None:
            whole = special if whole is None else whole | special
        table = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(length) - length
        n = length[codes]
        ends = np.cumsum(n)
        ids = table[np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1])]
        cuts = ends[offsets[1:] - 1]
        tail = np.array([END_ID] if end else [], "<u4")
        out = []
        for k, (a, b) in enumerate(zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)):
            own = np.frombuffer(self.raw(column[k].as_py()), "<u4") if whole is not None and whole[k] else ids[a:b]
            out.append(np.concatenate([own, tail]))
        return out


@cache
def shared(path: str | None = None) -> Encoder:
    """This process's encoder: a Python worker that runs many tasks loads it once and keeps the pieces it knows."""
    return Encoder(path)
