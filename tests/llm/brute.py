"""Plain definitions of the training-data operators, for small tables."""

import hashlib
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = SPACED.findall(lower(text))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(docs, width, percent=80):
    sets = {d: shingles(t, width) for d, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    c = components(ids, links)
    return sorted((d, len(sets[d]), c[d], c[d] == d) for d in ids)


def decontaminate(docs, items, span=13):
    windows = {}
    for item, text in items:
        w = LETTERS.findall(lower(text))
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = LETTERS.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def leaked(docs, items, span=13):
    """Ids of documents that hold a whole window of `span` words, or that `decontaminate` calls contaminated."""
    windows = set()
    for _, text in items:
        w = LETTERS.findall(lower(text))
        windows |= {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
    out = {r[0] for r in decontaminate(docs, items, span) if r[5]}
    for d, text in docs:
        w = LETTERS.findall(lower(text))
        if any(tuple(w[i : i + span]) in windows for i in range(len(w) - span + 1)):
            out.add(d)
    return out


def cut_repeats(docs, span=13):
    first = {}
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    """(start, kind number, end) of the patterns' matches that pass their checks."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
                ok = 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
            else:
                ok = kind == "email" or 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)
