"""Reading public tokenizers, and encoding many texts whose words recur."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Characters of text that are encoded at a time, and words whose ids a task remembers.
BLOCK_CHARS, WORDS = 1 << 21, 400_000
#: How byte-level vocabularies write the bytes: printable Latin-1 characters as themselves, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)} | {chr(b): b for b in _PLAIN}
CHARS = {b: c for c, b in BYTES.items()}
#: Characters of one kind in a row from which on a text is left to the library.
LONG_RUN = 256
#: Letters of which a word is one piece to a tokenizer, and stays as it is but for lower case, one letter for each.
_PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LETTERS = re.compile(f"[{_PLAIN_LETTERS}]+")
#: A word and the signs after it, which are a piece of their own; an apostrophe may go with the letters after it.
ENDING = re.compile(rf"([{_PLAIN_LETTERS}0-9]+)([!-&(-/:-@\[-`{{-~]+)")


def public(name: str) -> str:
    """Where the public tokenizers' file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file, as its library reads it, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def text_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of a list whose texts have some two million characters together, or one text that has more."""
    start = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > BLOCK_CHARS:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


class ByteEncoder:
    """The library's ids of whole texts for a byte-level vocabulary whose ids are the order of its merges.

    Such a vocabulary is a table of ranks, which the library for those encodes several times as fast, with equal ids.
    Texts in which a special token's text occurs, and texts with very long runs without or of white space, on which that
    library takes the square of the run's length, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.tokenizer = tokenizer(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(BYTES[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = re.compile("|".join([*map(re.escape, special), rf"\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}"]))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if self.slow.search(text):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                yield np.array(self.ranks.encode_ordinary(text), np.int32)


class WordEncoder:
    """The library's ids of whole texts, word by word, for a tokenizer that drops white space.

    It always cuts at a space or line feed, so a text's ids are its words' ids in a row, and words recur.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words; one of plain letters alone is one piece to the tokenizer's model, which is asked at once."""
        rest = []
        for w in words:
            if LETTERS.fullmatch(w):
                low = w.lower()
                piece = low if low.isascii() else low.encode().decode("latin-1").translate(CHARS)
                yield w, array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()
            else:
                rest.append(w)
        yield from zip(rest, self._ids(rest), strict=True)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for low, high in text_blocks(texts):
            split = [t.replace("\n", " ").split(" ") for t in texts[low:high]]
            there = {w for words in split for w in words}
            new = there.difference(self.known)
            if len(self.known) + len(new) > WORDS:
                self.known, new = {}, there
            ended = {w: m.groups() for w in new if (m := ENDING.fullmatch(w))}
            bare = {*new.difference(ended), *(part for parts in ended.values() for part in parts)}.difference(self.known)
            self.known.update(self._words(list(bare)))
            self.known.update((w, self.known[a] + self.known[b]) for w, (a, b) in ended.items())
            for words in split:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
