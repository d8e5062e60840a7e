"""Token ids of whole texts, with a cache of the ids of each white-space separated chunk."""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

PUNCTUATION = ".,;:!?"
#: Characters that Python splits on and the vocabulary's rule does not, and the start of special tokens.
UNUSUAL = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Letters whose lower case is more than one letter or depends on the context.
CASES = ("Σ", "İ")
#: Full stops and commas that are not pieces of their own.
JOINED = re.compile(r"[.,](?:(?<=[^\w\s].)|(?=[^\w\s_])|(?<=_.)|(?=_))")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ByteForms(dict):
    """How the vocabulary writes each character's bytes; learned from its own pre-tokenizer."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, code: int) -> str:
        form = "".join(piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(chr(code)))
        self[code] = form
        return form


class ChunkIds(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes.

    Right for vocabularies whose pieces neither cross nor hold white space; that is
    checked once. The ids of a text are then those of its chunks, joined.
    """

    def __init__(self, path: str, most: int = 96_000_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.held = most, 0  # bytes, about
        self.forms = ByteForms(self.tokenizer.pre_tokenizer)
        if self.whole("on a \n tion.") != self.whole("on") + self.whole("a") + self.whole("tion."):
            raise ValueError("the vocabulary must drop white space")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        if self.held > self.most:
            self.clear()
            self.held = 0
        word = chunk if any(letter in chunk for letter in CASES) else chunk.lower()
        base = word.rstrip(PUNCTUATION)
        if base != chunk and base.isalpha():
            # letters and punctuation are pieces of their own
            found = self[base] + (self[word[len(base) :]] if len(base) < len(word) else b"")
        elif base == chunk and base.isalpha() and unicodedata.is_normalized("NFC", base):
            form = base if base.isascii() else base.translate(self.forms)
            ids = [token.id for token in self.tokenizer.model.tokenize(form)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = np.array(self.whole(chunk), "<u4").tobytes()
        self[chunk] = found
        self.held += 200 + len(chunk) + len(found)
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(part in text for part in UNUSUAL):
            return np.array(self.whole(text), "<u4")
        if (
            not JOINED.search(text)
            and unicodedata.is_normalized("NFC", text)
            and not any(letter in text for letter in CASES)
        ):
            text = text.lower().replace(".", " . ").replace(",", " , ")
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")

    def sentence_ends(self) -> np.ndarray:
        """For each id whether a sentence ends with it."""
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            ends[number] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        return ends
