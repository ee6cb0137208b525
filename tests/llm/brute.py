"""Plain single-machine versions of the corpus operators, for small tables."""

import re

import xxhash

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(s):
    return [w for w in BLANK.split(s or "") if w]


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def dedup_lines(docs, min_words=5, bound=1):
    """{doc_id: text without repeated lines} by comparing every pair."""
    seen, out = [], {}
    for doc_id, text in sorted(docs.items()):
        if text is None:
            out[doc_id] = None
            continue
        stay = []
        for line in text.split("\n"):
            w = words(ascii_lower(line))
            if len(w) >= min_words:
                repeated = any(abs(len(w) - len(v)) <= bound and edits(w, v) <= bound for v in seen)
                seen.append(w)
                if repeated:
                    continue
            stay.append(line)
        out[doc_id] = "\n".join(stay)
    return out


def fingerprint(text, k=4):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bound=4):
    """{doc_id: smallest doc_id reachable}."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= bound:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}
