"""Token ids with a public tokenizer, inside Spark tasks.

The tokenizer drops white space and never joins characters across it, so the ids of a text are
those of its words one after another. A task therefore asks the tokenizers library once for
each different word of a block and keeps the ids of the first ``CACHED`` words (frequent words
come early); later rare words are encoded again when they come. ASCII capitals are folded
before the lookup, as the tokenizer's own lower-casing does, unless a text holds ``<|``, which
may start a special token. A comma or full stop after an ASCII letter or digit is always a
piece of its own, so a word that ends so has the ids of its stem and then the mark's. Words of
Latin letters alone need no normalising but lower case and are one piece each: they go to the
tokenizer's model directly, which saves two thirds of a call (not if a probe shows that a
tokenizer treats them in another way).
``tests/llm`` compares this with encoding whole texts.
"""

from __future__ import annotations

import re

CACHED = 500_000
BLOCK_BYTES = 1 << 20
TOKENIZER = "word_bpe_49k.json"


LEARN_AT_ONCE = 10_000
MARKS = (b",", b".")
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
LETTERS_ONLY = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
STEM = re.compile(rb".*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[,.]", re.DOTALL)
PROBE = [b"word", "straße".encode(), "Élan".encode(), "çaÿø".encode(), b"don", b"anticonstitutionally"]


def load_tokenizer(name: str):
    """A file of the public vocabulary package by name, or any path that every node can open."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def task_encoder(tokenizer: str = TOKENIZER, end_id: int = 1) -> WordEncoder:
    """The encoder of this worker process. Spark reuses Python workers, but functions that are shipped
    by value have no module there to keep anything in; so the loaded tokenizer and the known words
    stay with the tokenizers library's own module for the worker's next tasks."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_task_encoders", {})
    if (tokenizer, end_id) not in kept:
        kept[tokenizer, end_id] = WordEncoder(tokenizer, end_id)
    return kept[tokenizer, end_id]


class WordEncoder:
    """``encode(texts)`` yields the ids of each text as little-endian unsigned 32-bit bytes, the end id appended."""

    def __init__(self, tokenizer: str = TOKENIZER, end_id: int = 1):
        import numpy as np

        self.tok, self.known = load_tokenizer(tokenizer), {}
        self.end = np.array([end_id], "<u4").tobytes()
        self.spelt = None
        by_text = self._learn([*MARKS, *PROBE])
        self.marks = {m: by_text[m] for m in MARKS}
        spelt = [self.tok.pre_tokenizer.pre_tokenize_str(c) if self.tok.pre_tokenizer else [] for c in LETTERS]
        if all(len(x) == 1 for x in spelt):
            self.spelt = {ord(c): x[0][0] for c, x in zip(LETTERS, spelt, strict=True)}
            if any(self._learn([w])[w] != by_text[w] for w in PROBE):
                self.spelt = None

    def _learn(self, words) -> dict[bytes, bytes]:
        """Ids of words, from the tokenizers library."""
        from array import array

        words, out = list(words), {}
        if self.spelt:
            pieces, spelt, letters = self.tok.model.tokenize, self.spelt, LETTERS_ONLY.fullmatch
            rest = []
            for w in words:
                if letters(t := w.decode()):
                    out[w] = array("I", [x.id for x in pieces(t.lower().translate(spelt))]).tobytes()
                else:
                    rest.append(w)
            words = rest
        for at in range(0, len(words), LEARN_AT_ONCE):
            some = words[at:at + LEARN_AT_ONCE]
            got = self.tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            out |= {w: array("I", e.ids).tobytes() for w, e in zip(some, got, strict=True)}
        return out

    def encode(self, texts):
        block, held = [], 0
        for text in texts:
            raw = (text or "").encode()
            block.append((raw if b"<|" in raw else raw.lower()).split())
            held += len(raw)
            if held >= BLOCK_BYTES:
                yield from self._block(block)
                block, held = [], 0
        yield from self._block(block)

    def _block(self, block):
        new = set().union(*block).difference(self.known)
        marked = [w for w in new if w[-1:] in self.marks and STEM.fullmatch(w)]
        learnt = self._learn(new.difference(marked).union(w[:-1] for w in marked).difference(self.known))
        self.known |= learnt
        self.known |= (ended := {w: self.known[w[:-1]] + self.marks[w[-1:]] for w in marked})
        get = self.known.__getitem__
        for words in block:
            yield b"".join(map(get, words)) + self.end
        if len(self.known) > CACHED:
            for w in (*learnt, *ended):
                del self.known[w]
