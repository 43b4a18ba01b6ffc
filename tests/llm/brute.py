"""Plain answers to compare the operators with."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = -(1 << 63)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def key(doc_id):
    return LOW if doc_id is None else doc_id


def windows_removed(rows, size=50):
    """Sorted (doc_id, n_words, n_removed, sha256) of words in windows that also start in a smaller doc_id."""
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, w in texts:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < key(d):
                gone.update(range(s, s + size))
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def bytes_removed(rows, size=400):
    count = Counter(b[s : s + size] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - size + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def components(rows, k, percent):
    """(doc_id, n_shingles, component_id) of each row."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(s), min(ids[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def quality(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def personal(text):
    """Base spans (kind, start, end), by start and kind."""
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m.group())]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def lines(rows, least=10):
    """(doc_id, n_lines, n_dropped, sha256)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            owner[norm(line)] = min(owner.get(norm(line), key(d)), key(d))
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p in parts if len(norm(p)) < least or owner[norm(p)] == key(d)]
        out.append((d, len(parts), len(parts) - len(kept), sha("\n".join(kept).encode())))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
