"""Encoding of whole texts with a public tokenizer, many texts at a time.

White space ends every word of both vocabularies, so a text is cut into words
(with the blanks before them where the vocabulary keeps blanks), each distinct
word is encoded once by the ``tokenizers`` library, and the ids are gathered
with numpy. Plain words are encoded together and told apart by the marks that
the vocabulary sets at one end of a word. Texts with the control characters
that Python and Unicode disagree about as white space are encoded in one piece.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

from kinvector.llm.common import worker_state

ODD = re.compile("[\x1c-\x1f]")
SIGNS = ",.;:!?&%$#*|()\"-"
PIECES = re.compile(r"\s*\S+|\s+")
#: What a text of single blanks and line ends doesn't hold: other white space (Unicode's), and the mark below.
RARE = ("  ", "\n\n", "\n ", " \n", "\0", "\t", "\r", "\x0b", "\x0c")
WIDE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
BARE = "\0"  # marks words that no blank precedes; others stand for a blank and the word


class Encoder:
    """Ids of texts; ``keeps_blanks`` for byte-level vocabularies, in which blanks are part of words.

    The table of words holds ``most_words`` at most; when it is full, words met
    once are forgotten first. That bounds memory and never changes ids.
    """

    def __init__(self, path: str, keeps_blanks: bool, most_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_blanks = keeps_blanks
        self.most_words = most_words
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark[[i for w, i in vocabulary.items() if (w[0] == "Ġ" if keeps_blanks else w.endswith("</w>"))]] = True
        self.met = np.zeros(0, np.int64)
        self.forget(0)

    def forget(self, seen: int):
        """Keep the words met more than ``seen`` times; none for 0."""
        keep = np.flatnonzero(self.met > seen) if seen else np.zeros(0, np.int64)
        words = list(self.index) if len(keep) else []
        self.index = {words[i]: k for k, i in enumerate(keep)}
        n = self.lengths[keep] if len(keep) else np.zeros(0, np.int64)
        starts = np.cumsum(n) - n
        self.values = self.values[np.repeat(self.starts[keep] - starts, n) + np.arange(n.sum())] if len(keep) else np.zeros(0, np.uint32)
        self.starts, self.lengths, self.met = starts, n, np.ones(len(keep), np.int64)

    def spelled(self, word: str) -> str:
        """The text that a word of the table stands for."""
        if not self.keeps_blanks:
            return word
        return word[1:] if word[:1] == BARE else " " + word

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has)."""
        got = self.tokenizer.encode_batch_fast([self.spelled(w) for w in words], add_special_tokens=False)
        ids = [x.ids for x in got]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)

    def sorted_out(self, words: set[str]) -> tuple[list[str], np.ndarray, list[str]]:
        """(plain words, how many marks the ids of each have, other words).

        Byte-level: a blank and no other before the word is its one mark.
        Else: letters end in a mark, and so does a run of signs after them.
        """
        if self.keeps_blanks:
            plain = [w for w in words if w[:1] > " " and not w[0].isspace()]
            return plain, np.ones(len(plain), np.int64), list(words.difference(plain))
        one = [w for w in words if w.isalpha()]
        rest = words.difference(one)
        two = [w for w in rest if w.rstrip(SIGNS).isalpha()]
        return one + two, np.repeat([1, 2], [len(one), len(two)]), list(rest.difference(two))

    def plain_ids(self, words: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = " " * self.keeps_blanks + " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.mark[ids])
        if len(at) != marks.sum():
            return self.ids_of(words)
        last = np.cumsum(marks) - 1
        return ids, np.diff(np.append(at, len(ids))) if self.keeps_blanks else np.diff(np.concatenate([[-1], at[last]]))

    def keep(self, words: list[str], values: np.ndarray, n: np.ndarray):
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.values = np.concatenate([self.values, values])
        self.met = np.concatenate([self.met, np.zeros(len(n), np.int64)])

    def look_up(self, words: list[str]) -> np.ndarray:
        """Places of the words in the table; new ones are encoded first."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        unknown = [words[i] for i in missing.tolist()]
        new = set(unknown)
        if len(self.index) + len(new) > self.most_words and self.index:
            for seen in (1, 3, 9, 0):
                self.forget(seen)
                if len(self.index) <= self.most_words // 2:
                    break
            missing, unknown = np.arange(len(words)), words
            new = set(words) - self.index.keys()
        plain, marks, other = self.sorted_out(new)
        for i in range(0, len(plain), 50_000):
            some = plain[i : i + 50_000]
            self.keep(some, *self.plain_ids(some, marks[i : i + 50_000]))
        for i in range(0, len(other), 50_000):
            self.keep(some := other[i : i + 50_000], *self.ids_of(some))
        at[missing] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        return at

    def words(self, text: str) -> list[str]:
        if ODD.search(text):
            return []
        if self.keeps_blanks and (any(x in text for x in RARE) or not text.isascii() and any(x in text for x in WIDE)):
            return [w[1:] if w[0] == " " and not w[1:2].isspace() and w[1:2] != BARE else BARE + w for w in PIECES.findall(text)]
        if self.keeps_blanks:  # single blanks between words and single line ends only
            out = []
            for line in text.split("\n"):
                words = line.split(" ")
                if words[0]:
                    words[0] = BARE + words[0]
                    out += words
                else:
                    out += words[1:]
                out.append(BARE + "\n")
            return out[:-1]
        return (text.lower() if text.isascii() else text).split()

    def encode(self, texts: list[str], end: int | None = 0) -> list[np.ndarray]:
        """Ids of each text as uint32, with the end id where there is one."""
        pieces = [self.words(t) for t in texts]
        words = [w for ws in pieces for w in ws]
        at = self.look_up(words)
        self.met += np.bincount(at, minlength=len(self.met))
        n = self.lengths[at]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.values[np.repeat(self.starts[at] - total[:-1], n) + np.arange(total[-1])]
        ends = total[np.cumsum([len(ws) for ws in pieces])] if pieces else []
        out, before, last = [], 0, np.array([] if end is None else [end], np.uint32)
        for t, e in zip(texts, ends):
            ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if ODD.search(t) else flat[before:e]
            out.append(np.concatenate([ids, last]))
            before = e
        return out


def encoder(path: str, keeps_blanks: bool, most_words: int = 600_000) -> Encoder:
    """This Python worker's encoder; it is kept from task to task, and only one is."""
    kept, key = worker_state(), (path, keeps_blanks, most_words)
    if key not in kept:
        for other in [k for k in kept if not isinstance(k, str)]:
            del kept[other]
        kept[key] = Encoder(path, keeps_blanks, most_words)
    return kept[key]
