"""Ids of byte-level BPE texts, by chunks that no pre-token crosses, each encoded once and kept."""

from __future__ import annotations

import base64
import re
from array import array

from ._common import CACHE_BYTES, Cache

#: How a byte-level BPE of this family cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of which every regex engine says the same: whether letter, number, white space or other.
PLAIN = re.compile(r"[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")
#: The places that are safe in any text.
SAFE = re.compile(r"(?<=[!-~\xc0-\xd6\xd8-\xf6\xf8-ɏ])(?= [!-~\xc0-\xd6\xd8-\xf6\xf8-ɏ])")


def chunks(text: str) -> list[str]:
    """Parts of text, in order, such that the pre-tokenizer never makes a pre-token across two of them.

    A space or newline between two visible characters starts a pre-token, and a lone newline is one.
    """
    runs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in ("", " ", "\n") or text[-1] in " \n"
    if runs or not PLAIN.fullmatch(text):
        return SAFE.split(text)
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f")


class ByteTokens(Cache):
    """chunk -> its ids as little-endian unsigned 32-bit bytes.

    Plain chunks go through the merge ranks of the same vocabulary, all others (and whatever may hold a special
    token) through the tokenizers library, which is the authority.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, budget: int = CACHE_BYTES):
        super().__init__(self.encoded, budget)
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encoded(self, chunk: str) -> bytes:
        if self.ranks is not None and "<|" not in chunk and PLAIN.fullmatch(chunk):
            ids = self.ranks.encode_ordinary(chunk)
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, chunks(text)))
