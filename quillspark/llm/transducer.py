"""A finite transducer run by parallel prefix scan.

The symbols of all texts of a batch form one sequence, cut into blocks of equal
length.  Each block is first turned into its state-transition function (all entry
states advance at once), the functions are composed by a prefix scan, and only
then, with every block's entry state known, the outputs are read off.  A document
of any length is so handled in blocks that do not wait for each other.
"""

from __future__ import annotations

import numpy as np


class Transducer:
    """``step[state, symbol]`` is the next state, ``emit[state, symbol]`` the output.

    ``pad`` is a symbol that leaves every state alone and emits 0.
    """

    def __init__(self, step: np.ndarray, emit: np.ndarray, pad: int) -> None:
        self.step, self.emit, self.pad = step.astype(np.int16), emit.astype(np.int8), pad

    def functions(self, blocks: np.ndarray) -> np.ndarray:
        """State-transition function of each block: (blocks, states)."""
        f = np.tile(np.arange(self.step.shape[0], dtype=np.int16), (len(blocks), 1))
        for symbols in blocks.T:
            f = self.step[f, symbols[:, None]]
        return f

    @staticmethod
    def scan(f: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition in log2(blocks) rounds."""
        f, reach = f.copy(), 1
        while reach < len(f):
            f[reach:] = np.take_along_axis(f[reach:], f[:-reach].astype(np.int64), axis=1)
            reach *= 2
        return f

    def run(self, symbols: np.ndarray, start: int = 0, block: int = 256) -> np.ndarray:
        """Output of every symbol."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int8)
        count = -(-n // block)
        padded = np.full(count * block, self.pad, np.int16)
        padded[:n] = symbols
        blocks = padded.reshape(count, block)
        entry = np.full(count, start, np.int16)
        if count > 1:
            entry[1:] = self.scan(self.functions(blocks))[:-1, start]
        out = np.empty((count, block), np.int8)
        for j, column in enumerate(blocks.T):
            out[:, j] = self.emit[entry, column]
            entry = self.step[entry, column]
        return out.reshape(-1)[:n]
