"""Plain versions of the operators, for small inputs. Documents are (id, text, source) in the order of ids."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeat), failed


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        share = (total - sum(3 * sizes[s] for s in capped)) / free if free else 0.0
        new = {s for s in order if s not in capped and share * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in capped else share * weight[s] for s in order}
        capped |= new


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs: list[tuple]) -> dict[int, int]:
    sets, root = {d: shingles(t) for d, t, *_ in docs}, {d: d for d, *_ in docs}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


def substrings(docs: list[tuple], window: int = 20) -> dict[int, tuple[int, int, str]]:
    seen: set[tuple] = set()
    out = {}
    for d, text, *_ in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def strings(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


PARAGRAPH = re.compile(r"[^\n]{128,640}?[.!?](?=\s|$)|[^\n]{128,640}?[aeiou](?= )|[^\n]{1,640}")


def likeness(a: str, b: str) -> float:
    """Shared paragraphs against all that are shared or in one text only."""
    x, y = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    part = len(text) // 3
    return text[: len(text) - part] + following[:part]


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
