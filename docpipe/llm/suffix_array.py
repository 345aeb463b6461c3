"""Enhanced suffix array of a byte buffer and its tree of common-prefix intervals."""


def suffix_array(symbols):
    """(order, lcp) of the suffixes of an integer array.

    Prefix doubling: ranks by 6 symbols, then 12, 24, ... until all differ. The ranks of
    every round are kept, and give the common prefix of neighbours from the longest
    step down. lcp[i] belongs to order[i - 1] and order[i].
    """
    import numpy as np

    n = len(symbols)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    values, dense = np.unique(symbols, return_inverse=True)
    bits = max(1, int(len(values)).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(step):
        key <<= bits
        key[:max(0, n - j)] |= dense[j:] + 1
    steps, ranks = [], []
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        fresh[0] = 0
        ordered = key[order]
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        steps.append(step)
        ranks.append(rank.astype(np.int32) if n < 1 << 31 else rank)  # one array a round is kept
        if rank[order[-1]] == n - 1 or step >= n:
            break
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        step *= 2
    x, y = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, dtype=np.int64)
    for size, rank in zip(reversed(steps), reversed(ranks), strict=True):
        inside = (x + size <= n) & (y + size <= n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        x[same] += size
        y[same] += size
        shared[same] += size
    left = np.arange(n - 1)
    for _ in range(steps[0]):  # what is left is shorter than the first step
        left = left[(x[left] < n) & (y[left] < n)]
        left = left[symbols[x[left]] == symbols[y[left]]]
        if not len(left):
            break
        x[left] += 1
        y[left] += 1
        shared[left] += 1
    return order, np.concatenate([[0], shared])


def common_prefix_intervals(lcp, least):
    """(length, first, last) of every interval of the suffix array with a common prefix of
    `least` or more that is longer than its parent's, by one scan with a stack."""
    import numpy as np

    n = len(lcp)
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    for run in np.split(deep, cuts):
        values = lcp[run[0]:run[-1] + 1].tolist()
        stack = []  # (length, first)
        for at, value in enumerate([*values, 0], start=int(run[0])):
            first = at - 1
            while stack and stack[-1][0] > value:
                length, first = stack.pop()
                yield length, first, at - 1
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, first))
    assert deep[-1] < n


def maximal_repeats(symbols, least):
    """(length, positions) of every string of at least `least` symbols that occurs more than once
    and cannot be extended in all its places, on either side. Positions are all occurrences.

    Mark borders with symbols that occur nowhere else, so that nothing matches across them.
    """
    import numpy as np

    order, lcp = suffix_array(symbols)
    before = np.concatenate([[-1], symbols[:-1]])[order] if len(order) else order
    for length, first, last in common_prefix_intervals(lcp, least):
        extended = before[first:last + 1]
        if extended.min() != extended.max() or extended[0] == -1:
            yield length, order[first:last + 1]
