"""Plain single-machine versions of the operators, for small inputs."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return WORDS.findall(text.translate(UPPER) if lower else text)


def shingles(text, size):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(docs, size, percent):
    """doc_id to (set size, smallest reachable doc_id); ``docs`` are (doc_id, text)."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def kept_words(docs, size):
    """doc_id to the words that stay, windows judged on the input."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = words(text)
        gone = set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone.update(range(s, s + size))
            seen.add(key)
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def longest_overlap(a, b, shift, agree):
    """Longest stretch of a diagonal whose ends match, at least ``agree`` of its tokens too."""
    best = 0
    places = [i for i in range(max(0, shift), min(len(a), len(b) + shift)) if a[i] == b[i - shift]]
    for x, i in enumerate(places):
        for y in range(x, len(places)):
            length = places[y] - i + 1
            if (y - x + 1) >= agree * length - 1e-9:
                best = max(best, length)
    return best


def seed(tokens, at, mask):
    return tuple(tokens[at + k] for k, bit in enumerate(mask) if bit == "1")


def contaminated(docs, items, masks, least, agree):
    """{(doc_id, item_id): overlap} over all diagonals on which a seed agrees."""
    out, seeds = {}, {}
    cut = [(i, tokens(other)) for i, other in items]
    for k, (_, b) in enumerate(cut):
        for mask in masks if len(b) >= len(masks[0]) else ("1" * len(b),) if b else ():
            for y in range(len(b) - len(mask) + 1):
                seeds.setdefault(mask, {}).setdefault(seed(b, y, mask), []).append((k, y))
    for d, text in docs:
        a = tokens(text)
        shifts = {(k, x - y) for mask, places in seeds.items() for x in range(len(a) - len(mask) + 1) for k, y in places.get(seed(a, x, mask), ())}
        for k, shift in shifts:
            i, b = cut[k]
            found = longest_overlap(a, b, shift, agree)
            if found and found >= min(least, len(b)):
                out[d, i] = max(found, out.get((d, i), 0))
    return out


def contaminated_on_any_diagonal(docs, items, least, agree):
    """{(doc_id, item_id): overlap} over all diagonals, without masks."""
    out = {}
    for d, text in docs:
        a = tokens(text)
        for i, other in items:
            b = tokens(other)
            found = max((longest_overlap(a, b, shift, agree) for shift in range(1 - len(b), len(a))), default=0)
            if found and found >= min(least, len(b)):
                out[d, i] = found
    return out
