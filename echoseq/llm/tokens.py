"""Token ids of whole texts by the tokenizers library, with a bounded cache of chunks.

Byte-level BPE never joins a character with white space that follows it, nor a letter with a comma
or full stop that follows it. So a text is cut there, each distinct chunk is encoded by the library
once per Python worker, and a text's ids are its chunks' ids in order. Texts with white space other than
space and newline, and texts that hold the string of an added token of the vocabulary, go to the library whole:
the library gives such a string its one id, wherever it stands.
"""

from __future__ import annotations

import re
from array import array

#: A chunk: white space, then letters up to a comma or full stop, or all up to the next white space.
CHUNK = re.compile(r"[ \n]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,])|[^ \n]+)|[ \n]+")
ODD_SPACE = re.compile(r"[^\S \n]")
CACHE_ENTRIES, CACHE_CHARS = 800_000, 48
END_ID = 0


class Chunks(dict):
    """Chunk to the bytes of its ids, little-endian unsigned 32-bit."""

    def __init__(self, path: str, entries: int):
        from tokenizers import Tokenizer

        self.entries = entries
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(self) < self.entries and len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a text with the end id, as little-endian unsigned 32-bit integers."""
        if not text:
            return END_ID.to_bytes(4, "little")
        if ODD_SPACE.search(text) or any(t in text for t in self.added):
            return self.encode(text) + END_ID.to_bytes(4, "little")
        return b"".join(map(self.__getitem__, CHUNK.findall(text))) + END_ID.to_bytes(4, "little")


_open: dict[tuple[str, int], Chunks] = {}


def chunks(path: str, entries: int = CACHE_ENTRIES) -> Chunks:
    """The worker's cache of at most `entries` chunks for the vocabulary file at path."""
    if (path, entries) not in _open:
        _open[path, entries] = Chunks(path, entries)
    return _open[path, entries]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
