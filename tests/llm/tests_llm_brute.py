"""Plain Python versions of the text operators, for the tests."""

import hashlib
import re

import xxhash

from blockreach.llm import secrets as S

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WEAK = {3: re.compile(S.WEAK_ACCESS), 4: re.compile(S.WEAK_KEY), 5: re.compile(S.ENDPOINT)}


def brute_spans(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    weak = [(m.start(), kind, m.end()) for kind, p in WEAK.items() for m in p.finditer(text) if not any(b[0] < m.end() and m.start() < b[2] for b in base)]

    def near(s, kinds):
        return any(o[1] in kinds and max(o[0] - s[2], s[0] - o[2]) <= S.SCOPE for o in base + weak)

    linked = [s for s in weak if (s[1] == 3 and near(s, S.SECRETS)) or (s[1] == 4 and near(s, S.IDENTIFIERS)) or (s[1] == 5 and near(s, S.SECRETS) and near(s, S.IDENTIFIERS))]

    def joined(spans):
        return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    counts = tuple(sum(s[1] == k for s in base) for k in S.BASE)
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + linked)), sorted(base + linked)


def brute_redacted(text, spans):
    out, at = "", 0
    for a, _, b in spans:
        if a >= at:
            out += text[at:a] + S.MARK
        at = max(at, b)
    return out + text[at:]


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Smallest id reachable over links of at most three bits."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def brute_shingles(text, words=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_near_texts(texts):
    """Per id the smallest id reachable over pairs of five-word similarity 0.8 or more."""
    ids, sets = list(texts), {i: brute_shingles(t) for i, t in texts.items()}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def brute_contamination(texts, items, window=10):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(tuple(w[at:at + n]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for at in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[at:at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
