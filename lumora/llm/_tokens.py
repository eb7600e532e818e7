"""Token ids of whole texts, by the tokenizers library, with a bounded cache of words.

The tokenizer drops white space and treats what stands between white space by itself, so a text's ids are those of
its parts between spaces and line ends, in order. Parts that are Latin letters, with a full stop or comma at most,
go to the library's model directly; all others go through its whole pipeline.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

END_ID = 1
CACHE_WORDS = 400_000
GROUP_CHARS = 1 << 20
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)\Z")


class Words:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers; keeps the ids of the first words that it meets."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte-level alphabet: a byte from 0xA1 on, but 0xAD, is shown as its own code point, those from 0x7F to 0xA0 from 0x121 on
        shown = {b: b if b > 0xA0 and b != 0xAD else 0x121 + b - 0x7F if b <= 0xA0 else 0x143 for b in range(0x7F, 0x100)}
        self.letters = {c: "".join(chr(shown[b]) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.marks = {m: self._pack(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,"}
        self.cache: dict[str, bytes] = {"": b""}
        self.most = cache_words

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()  # four bytes an item on all platforms of Spark

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not in the cache, and of the lower-case letters in them."""
        out, rest = {}, []
        known, match, tokenize, pack, marks = self.cache.get, PLAIN.match, self.model.tokenize, self._pack, self.marks
        for w in words:
            m = match(w)
            if m is None:
                rest.append(w)
                continue
            low, mark = m.group(1).lower(), m.group(2)
            ids = known(low) or out.get(low)
            if ids is None:
                ids = out[low] = pack([t.id for t in tokenize(low if low.isascii() else low.translate(self.letters))])
            out[w] = ids + marks[mark] if mark else ids
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            out.update((w, pack(e.ids)) for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, without an end id."""
        out, start, cache = [], 0, self.cache
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[stop] or "")
                stop += 1
            words = [(t or "").replace("\n", " ").split(" ") for t in texts[start:stop]]
            new = self._learn(set().union(*words).difference(cache))
            full = len(cache) >= self.most
            cache.update(new)
            out += [b"".join(map(cache.__getitem__, w)) for w in words]
            if full:
                for w in new:
                    del cache[w]
            start = stop
        return out


@lru_cache(maxsize=1)
def shared_words(path: str) -> Words:
    """One for each Python worker, which Spark uses again for later tasks."""
    return Words(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
