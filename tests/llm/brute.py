"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def shingle_set(text):
    w = WORD.findall(lower(text))
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def near_duplicates(rows):
    """{doc_id: (size, component)} for rows (doc_id, text)."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in holders[x]:
                if e < d:
                    common[e] += 1
        for e, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def contamination(rows, items):
    """{doc_id: (n_words, n_hit, n_items, sha)} for rows (doc_id, text) and items (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                held = windows.get(tuple(w[i:i + n]))
                if held:
                    hit |= set(range(i, i + n))
                    found |= held
        out[d] = (len(w), len(hit), len(found), sha(sorted(found)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def secret_spans(text):
    found = []
    pattern = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
                         r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [("assign", *m.span()) for m in pattern.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def personal_spans(text):
    kinds = []
    kinds.append(("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True))
    kinds.append(("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))))
    kinds.append(("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19
                  and luhn(re.sub(r"\D", "", s))))
    kinds.append(("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15))
    return [(kind, *m.span()) for kind, pattern, good in kinds for m in re.finditer(pattern, text) if good(m[0])]


def span_digest(spans):
    return sha([f"{k}:{s}:{e}" for k, s, e in spans])
