"""Plain restatements of the operators' rules, for small inputs."""

import collections
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def repeats(rows):
    """rows: (id, text). Per row (bytes, removed, spans, kept)."""
    data = [(i if i is not None else float("inf"), (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in data:
        for p in range(len(t) - 49):
            least[t[p:p + 50]] = min(i, least.get(t[p:p + 50], i))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        out.append((len(t), sum(gone), sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1])), bytes(c for c, x in zip(t, gone) if not x)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def private(text):
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 14 <= len(d) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 10 <= len(d) <= 15))
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
    return ",".join(f"{rules[i][0]}:{a}:{b}" for a, i, b in sorted(found))


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts, hit, seen, repeated = collections.Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(hit)


def fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def shingles(text, n):
    words = WORD.findall(lower(text))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(prints):
    """Root position of each fingerprint, linked at four or fewer differing bits."""
    values, up = np.array(prints, np.uint64), list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 4) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            up[b] = a
    return [top(i) for i in range(len(prints))]


def contamination(text, items):
    """(words, hit words, items) for items (id, text)."""
    pattern = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = pattern.findall(lower(text)), set(), set()
    for item, said in items:
        theirs = pattern.findall(lower(said))
        n = min(10, len(theirs))
        for window in {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), found


def without_spread_lines(rows, sites):
    """rows: (site, text)."""
    used = collections.defaultdict(set)
    for site, text in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line) and site is not None:
                used[line].add(site)
    return [None if t is None else "\n".join(x for x in t.split("\n") if len(used[x]) < sites) for _, t in rows]
