"""Public vocabularies: paths, tiktoken encodings, and a cached encoder whose ids equal those of the tokenizers library."""

from __future__ import annotations

import base64
import functools
import re

#: Entries of the encoder's cache of pieces; it is emptied when full.
CACHE = 400_000
#: The vocabulary's split pattern for texts in which Python's letter and digit classes agree with Unicode's L and N.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on which they disagree, or that Python counts as white space and Unicode doesn't.
ODD = re.compile(r"[\x1c-\x1f]|(?=[^\x00-\x7f])[^A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ϿЀ-ҁ‐-‧¡-©«-±´¶-¸»¿×÷€]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def tiktoken_encoding(path: str, special: tuple = ()):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


class CachedEncoder:
    """ids of a text as little-endian unsigned 32-bit bytes, for a byte-level BPE file of the tokenizers library.

    A piece of the split pattern is encoded once and then looked up. Texts with unusual characters or with the strings
    of special tokens go whole through the library itself.
    """

    def __init__(self, path: str, ranks_path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.encoding = tiktoken_encoding(ranks_path)
        self.cache = _Pieces(self.encoding)

    def __call__(self, text: str) -> bytes:
        import numpy as np

        if ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cache) > CACHE:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, PLAIN.findall(text)))


class _Pieces(dict):
    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        import numpy as np

        found = self[piece] = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        return found
