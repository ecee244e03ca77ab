"""Balanced parentheses of a trie in preorder, with range min-max blocks over the excess (numpy, one shard at a time)."""

from __future__ import annotations

import numpy as np

#: Positions of one range min-max block.
BLOCK = 32


class Parentheses:
    """``bits``: 1 opens a node, 0 closes it; node k (from 0, preorder) is the k-th 1.

    The excess at a position is the number of open nodes after it. Blocks of BLOCK positions keep the least excess in
    them, and a binary tree over the blocks the least of two, so that the first later position with a given excess is
    found by climbing and descending instead of scanning.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        n = len(bits)
        self.opens = np.flatnonzero(bits)
        self.rank = np.cumsum(bits, dtype=np.int64)
        excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        blocks = -(-n // BLOCK)
        width = 1 << max(blocks - 1, 0).bit_length()
        self.excess = np.full(width * BLOCK, np.iinfo(np.int64).max)
        self.excess[:n] = excess
        self.least = [self.excess.reshape(width, BLOCK).min(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
        pairs = np.zeros(n, np.int64)
        pairs[:-1] = bits[:-1] & (1 - bits[1:])
        self.pairs = np.concatenate([[0], np.cumsum(pairs)])

    def _scan(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First position from ``at`` to the end of its block with excess <= goal, or -1."""
        found, left = np.full(len(at), -1), np.arange(len(at))
        pos = at.copy()
        end = (at // BLOCK + 1) * BLOCK
        while len(left):
            left = left[pos[left] < end[left]]
            hit = self.excess[pos[left]] <= goal[left]
            found[left[hit]] = pos[left[hit]]
            left = left[~hit]
            pos[left] += 1
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The position that closes the node opened at each of ``opens``: the first later one with a lower excess."""
        goal = self.excess[opens] - 1
        at = opens + 1
        close = np.where(at % BLOCK == 0, -1, self._scan(at, goal))
        far = np.flatnonzero(close < 0)
        if not len(far):
            return close
        block, aim = -(-at[far] // BLOCK), goal[far]
        level = np.full(len(far), -1)
        todo = np.arange(len(far))
        for k, least in enumerate(self.least):  # climb until a node's range holds the excess sought
            for _ in range(2):
                hit = least[block[todo]] <= aim[todo]
                level[todo[hit]] = k
                todo = todo[~hit]
                even = block[todo] % 2 == 0
                block[todo[even]] += 1
                if not even.any():
                    break
            block[todo] = (block[todo] - 1) // 2 + 1
        for k in range(len(self.least) - 1, 0, -1):  # and descend to the first block
            down = np.flatnonzero(level == k)
            block[down] *= 2
            block[down] += self.least[k - 1][block[down]] > aim[down]
            level[down] = k - 1
        close[far] = self._scan(block * BLOCK, aim)
        return close

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """For every node in preorder: one past the last node of its subtree, and the childless nodes in it."""
        close = self.find_close(self.opens)
        return self.rank[close], self.pairs[close] - self.pairs[self.opens]
