"""Deep-shallow string sorting.

Multikey quicksort orders strings to a shallow depth, eight bytes a symbol: each round sorts the
groups that are still tied by their next symbol. Groups tied to that depth have long common
prefixes; a blind trie orders each. Inserting into it goes down by branching bytes alone, compares
the whole string once, with the leaf reached, and branches at the place where they differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 40


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if x == 0 else n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children", "leaf", "rows")

    def __init__(self, depth: int, leaf: bytes):
        self.depth, self.leaf = depth, leaf
        self.children: dict[int, _Node] = {}
        self.rows: list[int] = []


class BlindTrie:
    """Strings by insertion. A byte beyond a string's end counts as -1, less than any other."""

    def __init__(self):
        self.top: _Node | None = None

    def insert(self, s: bytes, row: int) -> None:
        n = len(s)
        if self.top is None:
            self.top = _Node(n, s)
            self.top.rows.append(row)
            return
        node = self.top
        while node.children:
            c = s[node.depth] if node.depth < n else -1
            child = node.children.get(c)
            if child is None:
                break
            node = child
        found = node.leaf
        lcp = common(s, found)
        if lcp == n == len(found) and not node.children:
            node.rows.append(row)
            return
        parent, node = None, self.top
        while node.children and node.depth <= lcp:
            if node.depth == lcp:
                break
            parent, node = node, node.children[s[node.depth] if node.depth < n else -1]
        new = _Node(n, s)
        new.rows.append(row)
        c = s[lcp] if lcp < n else -1
        if node.children and node.depth == lcp:
            node.children[c] = new
            return
        fork = _Node(lcp, s)
        old = node.leaf
        fork.children = {c: new, (old[lcp] if lcp < len(old) else -1): node}
        if parent is None:
            self.top = fork
        else:
            parent.children[s[parent.depth] if parent.depth < n else -1] = fork

    def ordered(self):
        """(rows of equal strings, common prefix with the string before) in order; the first has -1."""
        stack, pending = [(self.top, -1)], []
        while stack:
            node, lcp = stack.pop()
            if not node.children:
                pending.append((node.rows, lcp))
                continue
            kids = sorted(node.children)
            for i in range(len(kids) - 1, -1, -1):
                stack.append((node.children[kids[i]], lcp if i == 0 else node.depth))
        return pending


def sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and each one's common prefix with the string before (first: 0)."""
    n = len(strings)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    if n < 2:
        return order, lcp
    lengths = np.array([len(s) for s in strings])
    width = -(-shallow // 8) * 8
    flat = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    head = np.minimum(lengths, width)
    tied = np.zeros(n, np.int64)  # group of each place in the order
    for c in range(flat.shape[1]):
        # a place's length within this symbol breaks ties between padding and real zero bytes
        inside = np.clip(head - 8 * c, 0, 8)
        o = np.lexsort((inside[order], flat[order, c], tied))
        order, tied = order[o], tied[o]
        w, k = flat[order, c], inside[order]
        new = np.ones(n, bool)
        new[1:] = (tied[1:] != tied[:-1]) | (w[1:] != w[:-1]) | (k[1:] != k[:-1])
        fresh = np.flatnonzero(new[1:] & (tied[1:] == tied[:-1])) + 1
        if len(fresh):
            x = w[fresh] ^ w[fresh - 1]
            same = np.full(len(fresh), 8)
            for byte in range(7, -1, -1):
                same[(x >> np.uint64(8 * (7 - byte))) & np.uint64(0xFF) != 0] = byte
            lcp[fresh] = 8 * c + np.minimum(same, np.minimum(k[fresh], k[fresh - 1]))
        tied = np.cumsum(new) - 1
    edges = np.flatnonzero(np.append(True, tied[1:] != tied[:-1]))
    ends = np.append(edges[1:], n)
    for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
        if b - a == 1:
            continue
        rows = order[a:b].tolist()
        if b - a == 2:
            x, y = strings[rows[0]], strings[rows[1]]
            if y < x:
                order[a], order[a + 1] = rows[1], rows[0]
            lcp[a + 1] = common(x, y)
            continue
        trie = BlindTrie()
        for r in rows:
            trie.insert(strings[r], r)
        at = a
        for same, depth in trie.ordered():
            for i, r in enumerate(same):
                order[at] = r
                if at > a:
                    lcp[at] = depth if i == 0 else len(strings[r])
                at += 1
    return order, lcp
