"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import re
from collections import defaultdict


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", low(text))
    return frozenset(map(tuple, [w[i : i + size] for i in range(len(w) - size + 1)] if len(w) >= size else [w] if w else []))


def groups(rows, percent=75):
    """``doc_id -> (size of its set, smallest id reachable)`` by comparing all pairs of a small table."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def _digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
]


def personal(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, form, fits in FORMS for m in re.finditer(form, text or "") if fits(m[0])]


NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_~-]{8,}={0,2})")


def secrets(text):
    """What stands behind a telling name and has two digits and two letters."""
    found = [m for m in NAMED.finditer(text or "") if sum("0" <= c <= "9" for c in m[1]) > 1 and sum(c.isalpha() for c in m[1]) > 1]
    return [f"secret:{m.start(1)}:{m.end(1)}" for m in found]
