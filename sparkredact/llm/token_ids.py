"""Token ids by a public tokenizer file, with a bounded memo of word pieces.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so the ids
of the cuts, concatenated, are exactly the ids of the whole text.  Words repeat,
so each worker keeps the ids of the cuts it has met, up to ``limit`` of them.
"""

from __future__ import annotations

import array
import re

from sparkredact.llm.common import worker_memo

# White space as Unicode defines it; Python's own \s holds U+001C to U+001F too.
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# A plain word, up to white space or an ASCII character that is no letter: a cut on its own.
_PLAIN = f"[{_LETTER}]+(?=[{_SPACE}!-@\\[-`{{-~]|\\Z)"
# White space kept: a single blank belongs to the word after it.
_KEEPING = re.compile(f" ?{_PLAIN}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# White space dropped by the tokenizer.
_DROPPING = re.compile(f"{_PLAIN}|[^{_SPACE}]+")
_BEYOND_LATIN_1 = re.compile("[^\x00-\xff]")


def _byte_alphabet() -> dict[int, int]:
    """Byte to the printable character that stands for it in byte-level BPE."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class TokenIds(dict):
    """Memo from a cut to its ids, as little-endian unsigned 32-bit integers.

    Once it holds half its ``limit`` it starts anew and keeps those cuts aside, so cuts
    that recur stay while the many that are met once go.
    """

    def __init__(self, path: str, drops_space: bool, limit: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.tokenizer.model
        self.drops_space, self.limit = drops_space, limit
        self.older: dict[str, bytes] = {}
        self.cuts = (_DROPPING if drops_space else _KEEPING).findall
        self.alphabet = _byte_alphabet()

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= max(self.limit // 2, 1):
            self.older = dict(self)
            self.clear()
        found = self.older.get(cut)
        if found is None:
            found = self.encoded(cut)
        self[cut] = found
        return found

    def encoded(self, cut: str) -> bytes:
        word = cut[1:] if cut[0] == " " else cut
        if word.isalpha() and (cut.isascii() or not _BEYOND_LATIN_1.search(word)):
            symbols = cut.replace(" ", "\u0120") if cut.isascii() else cut.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(symbols)]
        else:
            ids = self.tokenizer.encode(cut, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        if self.drops_space and not _BEYOND_LATIN_1.search(text):
            text = text.lower()
        elif self.drops_space:
            # Beyond Latin-1 the tokenizer lower-cases, after composing.
            return b"".join(map(self.lowered, self.cuts(text)))
        return b"".join(map(self.__getitem__, self.cuts(text)))

    def lowered(self, cut: str) -> bytes:
        return self[cut if _BEYOND_LATIN_1.search(cut) else cut.lower()]


def token_ids(path: str, limit: int = 400_000) -> TokenIds:
    """One memo per worker, kept between the tasks that use this tokenizer file.

    Files whose normaliser lower-cases and whose pre-tokenizer drops white
    space (``word_bpe``) are told by their own JSON.
    """
    def read() -> TokenIds:
        import json

        with open(path, encoding="utf-8") as f:
            normaliser = json.load(f).get("normalizer")
        return TokenIds(path, drops_space=bool(normaliser), limit=limit)

    return worker_memo(("tokens", path, limit), read)
