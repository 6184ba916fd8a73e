"""Token ids and counts with public tokenizers, cached by the pieces that a tokenizer never joins."""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from array import array

import regex

#: Chunks of text that a worker remembers (about 200 bytes each).
CACHE_CHUNKS = 1_200_000
_WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """ids() of the lower-casing word BPE file, 4 bytes an id.

    The file drops white space, so what lies between ASCII spaces is encoded on its own; a chunk is normalised and
    cut as the file says, and each piece is encoded once. Chunks with capital sigma, whose lower case depends on
    its neighbours in Python, and special strings go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = json.loads(self.whole.to_str())
        self.special = [t["content"] for t in parts["added_tokens"]]
        parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare, self.cut = Tokenizer.from_str(json.dumps(parts)), regex.compile(_WORD_PIECES)
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _pieces(self, chunk: str) -> tuple[str, ...] | list[str] | None:
        if "Σ" in chunk or "<|" in chunk and any(s in chunk for s in self.special):
            return None
        low = unicodedata.normalize("NFC", chunk).lower()
        if low.isalpha():
            return (low,)
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return (low[:-1], low[-1])
        return self.cut.findall(low)

    def _learn(self, words: list[bytes]) -> None:
        """Remember the chunks of one text."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > CACHE_CHUNKS // 2:
            self.pieces.clear()
        cut = {c: self._pieces(c.decode()) for c in set(words).difference(self.chunks)}
        new = list({p for pieces in cut.values() for p in pieces or () if p not in self.pieces})
        for piece, found in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.pieces[piece] = array("I", found.ids).tobytes()
        for chunk, pieces in cut.items():
            if pieces is None:
                self.chunks[chunk] = array("I", self.whole.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
            else:
                self.chunks[chunk] = b"".join(map(self.pieces.__getitem__, pieces))

    def ids(self, texts: list[bytes]):
        """The ids of each text, as bytes."""
        known = self.chunks.__getitem__
        for text in texts:
            words = text.split()
            try:
                yield b"".join(map(known, words))
            except KeyError:
                self._learn(words)
                yield b"".join(map(known, words))

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]


class ByteBpe:
    """counts() of a byte-level BPE given as ranks: the pattern's pieces are encoded once each."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.pieces: dict[str, int] = {}

    def counts(self, texts: list[bytes]) -> list[int]:
        out = []
        for text in texts:
            pieces = self.cut.findall(text.decode())
            if len(self.pieces) > CACHE_CHUNKS:
                self.pieces.clear()
            for new in {p for p in pieces if p not in self.pieces}:
                self.pieces[new] = len(self.encoding.encode_ordinary(new))
            out.append(sum(map(self.pieces.__getitem__, pieces)))
        return out


_LOADED: dict[str, WordBpe | ByteBpe] = {}


def loaded(path: str) -> WordBpe | ByteBpe:
    """The tokenizer of a file, once a worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path) if path.endswith(".tiktoken") else WordBpe(path)
    return _LOADED[path]
