"""Plain Python versions of what the operators return, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_duplicates(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingles(t, size) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    seen = set()
    for own in holders.values():
        for a, b in combinations(sorted(own), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((top(a), top(b)))
                    up[q] = p
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for rank, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(text)).encode()).hexdigest()


def contamination(docs, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: re.findall(word, (t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        listed = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def all_spans(docs: list[tuple[object, str | None]], posterior=0.5, bits=4.0, reach=8, shortest=3) -> tuple[list[str], set[str]]:
    """The spans of each document, disclosing words among them, and these words."""
    found = [base_spans(t) for _, t in docs]
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(TERM, t or "")] for _, t in docs]
    near, of_entity, alone = {}, {}, {}
    texts = {t or "" for _, t in docs}
    for t in texts:
        own = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(TERM, t)]
        for w in {w for _, _, w in own}:
            alone[w] = alone.get(w, 0) + 1
        for start, _, kind, end in base_spans(t):
            value, number = t[start:end].lower(), re.sub("[^0-9]", "", t[start:end])
            group = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": number[:6], "phone": number[:-7]}[kind]
            left = [w for _, e, w in own if e <= start][-reach:]
            right = [w for s, _, w in own if s >= end][:reach]
            for entity in ((kind, number if kind in ("card", "phone") else value), (kind, "class", group)):
                of_entity.setdefault(entity, set()).add(t)
                for w in {*left, *right}:
                    if len(w) >= shortest and not re.fullmatch("[0-9]+", w):
                        near.setdefault((w, entity), set()).add(t)

    def likely(k, n):
        return (k + 0.5 - math.sqrt(k * (n - k) / n + 0.25)) / (n + 1)

    telling = {
        w for (w, e), d in near.items()
        if likely(len(d), alone[w]) >= posterior and math.log2(len(d) * len(texts) / (alone[w] * len(of_entity[e]))) >= bits
    }
    out = []
    for base, own in zip(found, words, strict=True):
        terms = [(s, 4, "term", e) for s, e, w in own if w in telling and not any(a < e and s < b for a, _, _, b in base)]
        out.append(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(base + terms)))
    return out, telling
