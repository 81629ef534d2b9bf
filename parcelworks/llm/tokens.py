"""Pre-tokens and token ids of a public byte-level BPE tokenizer, with a cache by pre-token.

Byte-level BPE works on one pre-token at a time, so the ids of a text are the joined ids of its pre-tokens;
repeated pre-tokens are encoded once.  The tokenizer's file is a parameter and is read where a task runs.
"""

from __future__ import annotations

import re
import struct
from codecs import charmap_decode
from functools import lru_cache

#: Pre-tokens of a generation of one Python worker's cache; the last one and the one before are held.  It only saves time.
CACHED = 120_000

#: The public pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+` for texts without
#: _UNUSUAL characters.  The classes are written as ranges, which take half the time of \w and \d.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ƺ"
_OTHERS = r"\x00-\x08\x0e-\x1b!-/:-@\[-`{-~\xa1\xa7\xab\xb6\xb7\xbb\xbf\xd7\xf7‐-‧‰-‾€"
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_OTHERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Characters outside ASCII text, Latin letters and common punctuation; \x1c-\x1f are blanks for Python alone.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1\xa7\xab\xb6\xb7\xbb\xbf-ƺ‐-‧‰-‾€]")


def _shown() -> str:
    """Byte-level BPE names each byte by a printable character: itself, or the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return "".join(chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256))


_SHOWN = _shown()
#: Packs ids, by their number.
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(64)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers.

    ids() gives what the tokenizer's encode(text, add_special_tokens=False) gives, so a special token's string in a text
    is that token.  pretokens() and counts() know pre-tokens alone: to them such a string is ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        """The text cut into pre-tokens; joined they are the text."""
        if not _UNUSUAL.search(text):
            return _SPLIT.findall(text)
        spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def learn(self, pretokens) -> None:
        """Encode the pre-tokens that the cache lacks; what is used again passes from the older generation to the new one."""
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache
        cache, older, tokenize = self.cache, self.older, self.model.tokenize
        for p in set(pretokens).difference(cache):
            known = older.get(p)
            if known is None:
                ids = [t.id for t in tokenize(charmap_decode(p.encode(), "strict", _SHOWN)[0])]
                known = _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)
            cache[p] = known

    def forget(self) -> None:
        """Empty the cache: the worker goes on to other tasks."""
        self.cache, self.older = {}, {}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = self.pretokens(text)
        self.learn(parts)
        return b"".join(map(self.cache.__getitem__, parts))

    def counts(self, pretokens: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        self.learn(pretokens)
        cache = self.cache
        return [len(cache[p]) >> 2 for p in pretokens]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)
