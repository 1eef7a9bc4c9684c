"""Plain versions of the operators, over lists."""

import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k, percent):
    """Component of each row number by all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], [len(s) for s in sets]


def line_key(line):
    return line.strip(SPACE).translate(LOWER)


def kept_lines(texts, min_docs=10):
    """(lines, kept lines) of each text."""
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in split for k in {line_key(x) for x in ls} if k)
    return [(ls, [x for x in ls if n[line_key(x)] < min_docs]) for ls in split]


def contamination(texts, items, window=13):
    """(words, hit words, item ids) of each text."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for item, text in items:
        w = find(text)
        if item is None or not w:
            continue
        k = min(window, len(w))
        for i in range(len(w) - k + 1):
            wins[tuple(w[i : i + k])].add(str(item))
    sizes, out = {len(w) for w in wins}, []
    for t in texts:
        w, hit, found = find(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (names := wins.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


class Ppm:
    """Counts of byte contexts; method C, with or without exclusion."""

    def __init__(self, order):
        self.order, self.seen = order, defaultdict(Counter)

    def learn(self, data):
        """``data`` starts with ``order`` bytes of context."""
        for i in range(self.order, len(data)):
            for j in range(self.order + 1):
                self.seen[data[i - j : i]][data[i]] += 1

    def log2(self, data, exclude):
        return sum(self._one(data[i - self.order : i], data[i], exclude) for i in range(self.order, len(data))) / math.log(2)

    def _one(self, context, byte, exclude):
        out, gone = 0.0, set()
        for j in range(self.order, -1, -1):
            own = self.seen.get(context[self.order - j :])
            if own is None:
                continue
            left = {b: n for b, n in own.items() if b not in gone}
            if exclude and not left:
                continue
            total, kinds = sum(left.values()), len(left)
            if byte in left:
                return out + math.log(left[byte] / (total + kinds))
            out += math.log(kinds / (total + kinds))
            if exclude:
                gone |= left.keys()
        return out - math.log(max(1, 256 - len(gone)) if exclude else 256)
