"""Token ids of whole texts. The vocabulary file is a parameter; executors load it once for each Python worker."""

from __future__ import annotations

import zlib

import numpy as np

from catalume.llm.common import cached

#: How byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the rest from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
#: Up to this letter, lower-casing is one to one and text is in composed form.
LAST_PLAIN = "\u012f"

def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; maps white-space separated pieces of text to their ids.

    The vocabulary's normaliser and pre-tokeniser never join characters across white space, so a text's ids are those
    of its pieces in order. Each new piece is encoded by the library and remembered, up to ``limit``. A piece of
    Latin letters, with or without marks at its end, needs no pre-tokeniser: the library's model gets the lower-cased letters.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.letters, self.older, self.marks = Tokenizer.from_file(path), limit, {}, {}, {}
        self.model = self.tokenizer.model.tokenize
        self.written = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_letters(self, text: str) -> bytes:
        text = text.lower()
        if not (found := self.letters.get(text)):
            if not (found := self.older.get(text)):
                symbols = text if text.isascii() else text.encode().decode("latin-1").translate(SYMBOLS)
                found = b"".join([self.written[x.id] for x in self.model(symbols)])
            if len(self.letters) >= self.limit:  # two generations: what is still in use moves over
                self.older, self.letters = self.letters, {}
            self.letters[text] = found
        return found

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        core = text.rstrip("!#$%&*,.:;?")
        if len(text) < 100 and core.isalpha() and max(core) <= LAST_PLAIN:
            tail = text[len(core) :]
            if tail not in self.marks:
                if len(self.marks) >= 10_000:
                    self.marks.clear()
                self.marks[tail] = self.whole(tail) if tail else b""
            found = self.of_letters(core) + self.marks[tail]
        else:
            found = self.whole(text)
        if len(piece) < 100:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = found
        return found

    def encode(self, texts: list[bytes | None]):
        """Yields the id bytes of each text (null: none)."""
        for text in texts:
            yield b"".join(map(self.__getitem__, (text or b"").split()))


def encoder(path: str) -> Encoder:
    """The worker's encoder; its pieces are bounded in number and length (long pieces are not remembered)."""
    return cached(path, lambda: Encoder(path))


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
