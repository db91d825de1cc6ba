"""Plain references of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_components(rows, size, percent=80):
    """rows: (id, text) -> {id: (n, component)}."""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    first = {}  # equal sets are linked; only different ones are compared
    for i in ids:
        if sets[i]:
            up[root(i)] = root(first.setdefault(sets[i], i))
    rarity = {}
    for s in first:
        for x in s:
            rarity[x] = rarity.get(x, 0) + 1
    # A set that is similar enough to another one has one of its rarest shingles among the other's.
    holders = {}
    for s, i in first.items():
        few = len(s) - -(-percent * len(s) // 100) + 1
        for x in sorted(s, key=lambda x: (rarity[x], x))[:few]:
            for j in holders.setdefault(x, []):
                small, large = sorted((len(s), len(sets[j])))
                if 100 * small >= percent * large and root(i) != root(j):
                    common = len(s & sets[j])
                    if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                        a, b = sorted((root(i), root(j)))
                        up[b] = a
            holders[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def tokens(text):
    """Words of letters, digits and non-ASCII characters, A-Z as a-z."""
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def tiles(doc, item, size):
    """Greedy string tiling by full search: the longest match, first in doc and then in item, again and again."""
    marked_d, marked_i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not marked_d[i + n] and not marked_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return out
        marked_d[i : i + n] = marked_i[j : j + n] = [True] * n
        out.append((i, j, n))


def coverage(doc, item, size=5):
    d, i = tokens(doc), tokens(item)
    if i and len(set(d + i)) == 1:  # one word again and again
        return min(1.0, len(d) / len(i)) if min(len(d), len(i)) >= min(size, len(i)) else 0.0
    return sum(n for _, _, n in tiles(d, i, min(size, len(i)))) / len(i) if i else 0.0


def mix(rows, cycle=3, repeats=3):
    """rows: (doc_id, source, text) -> {doc_id: (source_size, target, taken, places at which its copies begin)}."""
    import hashlib

    texts = {d: t or "" for d, _, t in rows}
    rows = [(d, s, len(WORD.findall(t or ""))) for d, s, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    have = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: i % cycle + 1 for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(have.values()) - sum(repeats * have[s] for s in full)
        open_ = [s for s in names if s not in full]
        w = sum(weight[s] for s in open_)
        target = {s: repeats * have[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in open_ if target[s] > repeats * have[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in names:
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        docs = sorted((md5(f"{d}:{md5(texts[d])}"), d, n) for d, x, n in rows if x == s)
        taken, places, at = dict.fromkeys((d for _, d, _ in docs), 0), {d: [] for _, d, _ in docs}, 0
        left = int(target[s] + 0.5)
        while left > 0 and have[s]:
            for _, d, n in docs:
                taken[d] += min(n, left)
                places[d] += [at] if min(n, left) else []
                at += n
                left -= min(n, left)
        out |= {d: (have[s], target[s], taken[d], places[d]) for _, d, _ in docs}
    return out
