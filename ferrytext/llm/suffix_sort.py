"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

SHALLOW = 24
WORD = 8


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to be equal."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most  # a[:low] == b[:low], a[:high] != b[:high]
    step = 32
    while low + step < high and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings with a common prefix of ``depth`` bytes, in order. A node is [depth, {byte: child}, leaf below it], a
    leaf is a list of indices of equal strings; the end of a string is the byte -1."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth, self.root = strings, depth, None

    def _byte(self, i: int, at: int) -> int:
        s = self.strings[i]
        return s[at] if at < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [None, None, [i]]
            return
        node = self.root
        while node[1] is not None:  # blind: only branching bytes are looked at
            node = node[1].get(self._byte(i, node[0]))  or next(iter(node[1].values()))
        twin = node[2][0]
        n = common_prefix(self.strings[i], self.strings[twin], self.depth)
        if n == len(self.strings[i]) == len(self.strings[twin]):
            node[2].append(i)
            return
        parent, key, node = None, None, self.root
        while node[1] is not None and node[0] < n:
            parent, key = node, self._byte(i, node[0])
            node = node[1].get(key)
            if node is None:
                break
        leaf = [None, None, [i]]
        if node is not None and node[1] is not None and node[0] == n:
            node[1][self._byte(i, n)] = leaf
        elif node is None:
            parent[1][key] = leaf
        else:
            branch = [n, {self._byte(twin, n): node, self._byte(i, n): leaf}, None]
            if parent is None:
                self.root = branch
            else:
                parent[1][key] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """Indices in order, and each one's common prefix with the one before (the first: 0)."""
        order: list[int] = []
        lcp: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if node[1] is None:
                order += node[2]
                lcp += [before] + [len(self.strings[node[2][0]])] * (len(node[2]) - 1)
            else:
                keys = sorted(node[1])
                stack += [(node[1][k], node[0] if j else before) for j, k in reversed(list(enumerate(keys)))]
        return order, lcp


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of ``strings``, whose first ``depth`` bytes are known to be equal, and the longest common prefix of each
    with the one before it in that order (the first: 0)."""
    order: list[int] = []
    lcp: list[int] = []
    limit = depth + shallow
    work = [(list(range(len(strings))), depth)]
    while work:
        group, at = work.pop()
        if len(group) == 1:
            found, inner = group, [0]
        elif at >= limit:
            trie = BlindTrie(strings, at)
            for i in group:
                trie.insert(i)
            found, inner = trie.walk()
        else:
            words = {i: (strings[i][at : at + WORD], min(WORD, max(0, len(strings[i]) - at))) for i in group}
            pivot = words[group[len(group) // 2]]
            less = [i for i in group if words[i] < pivot]
            same = [i for i in group if words[i] == pivot]
            more = [i for i in group if words[i] > pivot]
            if more:
                work.append((more, at))
            if same:
                # a string that ends inside the word is alone with its equals: the trie tells them apart no further
                work.append((same, at + WORD if pivot[1] == WORD else limit))
            if less:
                work.append((less, at))
            continue
        if order:
            inner[0] = common_prefix(strings[order[-1]], strings[found[0]], depth)
        order += found
        lcp += inner
    return order, lcp
