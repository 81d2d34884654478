"""Numbers per word, computed once per worker process and added up over whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from rowloom.llm.common import remember_only

#: Words that a worker remembers; others are computed again where they occur.
REMEMBERED = 400_000


class WordRows(dict):
    """Maps a word to a row of a table that grows; ``compute`` fills many new rows at once.

    Words are bytes, lower-cased A-Z, without white space.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], width: int):
        super().__init__()
        self.compute = compute
        self.table = np.zeros((1024, width), np.float64)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def rows(self, texts: list[bytes]) -> list[np.ndarray]:
        """Row numbers of the words of each text; valid until the next call."""
        if len(self) > REMEMBERED:
            self.clear()
        at = [np.array(list(map(self.__getitem__, t.lower().split())), np.int64) for t in texts]
        if self.new:
            if len(self) > len(self.table):
                grown = np.zeros((2 * len(self), self.table.shape[1]), np.float64)
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[len(self) - len(self.new) : len(self)] = self.compute(self.new)
            self.new = []
        return at


_ROWS: dict[str, WordRows] = {}


def word_rows(model_id: str, compute: Callable[[list[bytes]], np.ndarray], width: int) -> WordRows:
    """The table of one model in this worker process; a new model drops the tables of older ones of its kind."""
    remember_only("words", _ROWS.clear)
    if model_id not in _ROWS:
        kind = model_id.split(":")[0]
        for old in [k for k in _ROWS if k.split(":")[0] == kind]:
            del _ROWS[old]
        _ROWS[model_id] = WordRows(compute, width)
    return _ROWS[model_id]
