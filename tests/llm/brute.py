"""Plain Python versions of the operators' results, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

from dendra.llm import secrets_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def either(word):
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def z_scores(token, alphabet, two, three, cuts, often):
    """Chi-squared, runs and serial correlation against even symbols; pairs and class changes, combined, against natural text."""
    v = [alphabet.index(c) for c in token]
    n, a = len(v), len(alphabet)
    pairs = sum(c * (c - 1) // 2 for c in Counter(v).values())
    chi = a * (2 * pairs + n) / n - n
    mid = (a - 1) / 2
    bits = [x > mid for x in v]
    high = sum(bits)
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(bits[i] != bits[i - 1] for i in range(1, n))
    serial = sum((v[i] - mid) * (v[i - 1] - mid) for i in range(1, n)) / ((n - 1) ** 0.5 * (a * a - 1) / 12)
    m = n * (n - 1) / 2
    by_pairs = (m * two - pairs) / (m * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two)) ** 0.5
    kind = [sum(x >= c for c in cuts) for x in v]
    turns = sum(kind[i] != kind[i - 1] for i in range(1, n))
    by_turns = (turns - (n - 1) * often) / ((n - 1) * often * (1 - often)) ** 0.5
    return (chi - a + 1) / (2 * (a - 1) * (n - 1) / n) ** 0.5, (runs - mean) / spread**0.5 if spread > 0 and 0 < high < n else None, serial, (by_pairs + by_turns) / 2**0.5


def random_candidates(text):
    """(start, end, stratum, bin, passes the battery) of each run to test. The parameters are the operator's."""
    text, base, out = text or "", secrets(text), []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text):
        if m[0].isdigit() or any(a < m.end() and b > m.start() for a, _, b in base):
            continue
        k = next(i for i, e in enumerate(secrets_scan.ENCODINGS) if re.search(e[1], m[0]))
        name, _, *more = secrets_scan.ENCODINGS[k]
        token = m[0].lower() if name == "hex" else m[0].replace("-", "+").replace("_", "/")
        chi, runs, serial, z = z_scores(token, *more)
        even = runs is not None and max(abs(chi), abs(runs), abs(serial)) <= secrets_scan.CRITICAL
        band = sum(len(token) >= b for b in secrets_scan.BANDS)
        out.append((m.start(), m.end(), k * (len(secrets_scan.BANDS) + 1) + band, min(max(math.floor(z * 10), 0), secrets_scan.TOP_BIN), even))
    return out


def all_secrets(texts):
    """Per text, its base and random spans: Benjamini-Hochberg per stratum over all texts, on binned p-values."""
    tried = [random_candidates(t) for t in texts]
    least = {}
    for stratum in {c[2] for own in tried for c in own}:
        bins = [(c[3], c[4]) for own in tried for c in own if c[2] == stratum]
        good = [b for b in {b for b, _ in bins} if any(e for x, e in bins if x >= b) and (0.5 * math.erfc(b / 10 / 2**0.5) if b else 1) * len(bins) <= secrets_scan.FDR * sum(e for x, e in bins if x >= b)]
        least[stratum] = min(good, default=math.inf)
    return [sorted(secrets(t) + [(a, 3, b) for a, b, stratum, bin_, even in own if even and bin_ >= least[stratum]]) for t, own in zip(texts, tried)]


def shingle_groups(ids, texts, least=0.8, size=5):
    """Smallest id that each text reaches over pairs whose word shingles have this Jaccard similarity or more."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    holders = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s or {None} for j in holders[x] if j < i)
        for j, n in common.items():
            if n >= least * (max(1, len(s)) + max(1, len(sets[j])) - n) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    low = {}
    for i, x in enumerate(ids):
        low[root(i)] = min(low.get(root(i), x), x)
    return [low[root(i)] for i in range(len(ids))]


def span_text(spans):
    return ",".join(f"{['assign', 'access', 'hex', 'random'][k]}:{a}:{b}" for a, k, b in spans)


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, most=3):
    """Smallest id that each row reaches over fingerprints at ``most`` or fewer bits."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        r = root(i)
        low[r] = min([y for y in (low.get(r), x) if y is not None], default=None)
    return [low[root(i)] for i in range(len(ids))]


def crc(text):
    return zlib.crc32((text or "").encode())


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
