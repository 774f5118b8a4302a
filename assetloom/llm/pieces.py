"""Words and their pieces: a table of bounded size that segments a word once."""

from __future__ import annotations

import numpy as np

SPACE = "\u2581"


class WordTable(dict):
    """Numbers of words, and the tokens of each number; forgets all of them when it has grown to ``most``.

    A word is segmented as it stands after a space. One that begins with a line end follows that instead."""

    def __init__(self, path: str | None, most: int = 250_000, longest: int = 64, model=None):
        import sentencepiece

        super().__init__()
        self.model = model or sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(self.model.get_piece_size())
        self.is_byte = np.array([self.model.is_byte(i) for i in pieces])
        self.opens = np.array([self.model.id_to_piece(i).startswith(SPACE) for i in pieces])
        self.most, self.longest = most, longest
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.n = self.used = 0
        self.start, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32)

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        at = self[word] = self.n + len(self.waiting) - 1
        return at

    def _segment(self, words: list[str]) -> None:
        """Words that hold the space sign are segmented alone; the others in runs, cut where a token opens a word."""
        ids = np.array(self.model.encode(" ".join(words), num_threads=1), np.int32)
        first = np.flatnonzero(self.opens[ids])
        if len(first) == len(words):
            lengths = np.diff(np.append(first, len(ids)))
        else:
            each = self.model.encode(words, num_threads=1)
            lengths, ids = np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], np.int32)
        n, m = len(words), len(ids)
        while len(self.start) < self.n + n:
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while len(self.flat) < self.used + m:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + m] = ids
        bare = np.array([w[:1] == "\n" for w in words], np.int64)
        self.start[self.n : self.n + n] = self.used + np.cumsum(lengths) - lengths + bare
        self.length[self.n : self.n + n] = lengths - bare
        self.n, self.used = self.n + n, self.used + m

    def numbers(self, words: list[str]) -> np.ndarray:
        if self.n > self.most:
            self.forget()
        out = np.array(list(map(self.__getitem__, words)), np.int64)
        waiting, self.waiting = self.waiting, []
        for k in range(0, len(waiting), 500):
            self._segment(waiting[k : k + 500])
        for w in waiting:
            if len(w) > self.longest:
                del self[w]
        return out

    def count(self, numbers: np.ndarray) -> int:
        """How many tokens those words have."""
        return int(self.length[numbers].sum())

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        length = self.length[numbers]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        return self.flat[np.repeat(self.start[numbers], length) + at]
