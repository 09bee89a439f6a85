"""Plain restatements of the operators' contracts, row by row and pair by pair, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def near(docs, percent=85):
    """{doc_id: (n_shingles, component_id, kept)} for distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    pairs = Counter()
    for i in ids:
        seen = Counter(j for s in sets[i] for j in by[s] if j < i)
        pairs.update({(j, i): c for j, c in seen.items()})
    for (j, i), c in pairs.items():
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def repeats(texts, n):
    """[(n_bytes, n_removed, n_spans, kept_sha256)] by the set of all n-byte strings."""
    b = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + n] for x in b for i in range(len(x) - n + 1))
    out = []
    for x in b:
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return out


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 14 <= len(d) <= 19 or sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
