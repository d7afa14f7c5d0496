"""Brute force that the tests hold operators against."""

from collections import defaultdict


def words(text):
    return (text or "").encode().lower().split()


def near_duplicates(rows, width, percent):
    """doc_id -> (set size, least id that can be reached)."""
    sets, post, root = {}, defaultdict(list), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in rows:
        w = words(t)
        k = min(width, len(w))
        sets[i], root[i] = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()), i
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in post[x]:
                shared[j] += 1
            post[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
