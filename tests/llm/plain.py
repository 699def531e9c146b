"""The text operators again, in plain Python and one row at a time, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*values: int | None, seed: int = 42) -> int:
    """Spark's xxhash64 of longs (plain numbers) and ints (given as 4 bytes), signed."""
    h = seed
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def text_hash(text: str | None) -> int | None:
    if text is None:
        return None
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def permuted(number: int, n: int, seed: int, rounds: int) -> int:
    """Where a Feistel network with cycle walking over 0..n-1 moves a number."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, math.ceil(n / a))
    while True:
        left, right = divmod(number, b)
        for i in range(rounds):
            key = (seed.to_bytes(4, "little"), i.to_bytes(4, "little"))
            if i % 2:
                right = (right + spark_hash(left, *key) % b) % b
            else:
                left = (left + spark_hash(right, *key) % a) % a
        number = left * b + right
        if number < n:
            return number


def sharded(keys: list[tuple], shards: int, seed: int, rounds: int, buckets: int) -> list[tuple[int, int]]:
    """(shard, slot) of each row, which has a tuple of long keys."""
    order = sorted(range(len(keys)), key=lambda i: (spark_hash(*keys[i]) % buckets, [(k is not None, k or 0) for k in keys[i]]))
    out: list[tuple[int, int]] = [(0, 0)] * len(keys)
    for number, i in enumerate(order):
        slot, shard = divmod(permuted(number, len(keys), seed, rounds), shards)
        out[i] = (shard, slot)
    return out


def filled(budget: int, caps: dict, weights: dict) -> dict:
    """Water-filling: whoever can't use its part is filled up, again and again, and the rest is split anew."""
    caps = {k: c for k, c in caps.items() if weights[k] > 0}
    parts: dict = {}
    while True:
        open_ = [k for k in caps if k not in parts]
        rest, total = budget - sum(parts.values()), sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] <= Fraction(rest * weights[k], total)]
        if not full:
            return parts | {k: rest * weights[k] // total for k in open_}
        parts |= {k: caps[k] for k in full}


def domain_of(source: str | None) -> str:
    number = re.search(r"(\d{1,9})$", source or "")
    return ("web", "news", "reference", "forum")[int(number[1]) % 4] if number else "unknown"


def mixed(rows: list[tuple], mix) -> dict:
    """Row number -> copies, for rows (id, text, lang, source) of different ids."""
    tokens = [len(WORD.findall(r[1] or "")) for r in rows]
    path = [(domain_of(r[3]), r[2] or "unknown", r[3] or "unknown") for r in rows]
    held: dict = defaultdict(int)
    for p, n in zip(path, tokens, strict=True):
        held[p] += n
    held = {p: n for p, n in held.items() if n}
    weight = lambda level, name: mix.weights[level].get(name, mix.default)
    leaf_cap = {p: n * mix.max_epochs if weight(2, p[2]) > 0 else 0 for p, n in held.items()}
    lang_cap, dom_cap = Counter(), Counter()
    for p, c in leaf_cap.items():
        lang_cap[p[:2]] += c if weight(1, p[1]) > 0 else 0
    for p, c in lang_cap.items():
        dom_cap[p[:1]] += c
    usable = sum(c for p, c in dom_cap.items() if weight(0, p[0]) > 0)
    budget = min(sum(held.values()) * mix.budget_percent // 100, usable)
    top = filled(budget, dom_cap, {p: weight(0, p[0]) for p in dom_cap})
    part: dict = {}
    for d, b in top.items():
        langs = {p: c for p, c in lang_cap.items() if p[:1] == d}
        for lang, c in filled(b, langs, {p: weight(1, p[1]) for p in langs}).items():
            leaves = {p: x for p, x in leaf_cap.items() if p[:2] == lang}
            part |= filled(c, leaves, {p: weight(2, p[2]) for p in leaves})
    copies = {}
    for leaf, budget in part.items():
        passes, rest = divmod(budget, held[leaf])
        own = [i for i in range(len(rows)) if path[i] == leaf and tokens[i]]
        key = lambda i: (hashlib.md5(f"{mix.seed}|{passes}|{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][0] or 0)  # noqa: B023, E731, S324
        read = 0
        for i in sorted(own, key=key):
            read += tokens[i]
            copies[i] = passes + (read <= rest)
    return {i: c for i, c in copies.items() if c}


STOPS = re.compile(r"[.,;:!?]+$")


def good(text: str | None, thresholds, stop_words) -> bool:
    words, text = WORD.findall(text or ""), text or ""
    n = max(len(words), 1)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    found = {
        "n_words": len(words),
        "repeat_ratio": len(repeat) / n,
        "mean_word_chars": sum(map(len, words)) / n,
        "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / n,
        "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "stop_word_ratio": sum(STOPS.sub("", w).lower() in stop_words for w in words) / n,
    }
    return all((t.low is None or found[t.metric] >= t.low) and (t.high is None or found[t.metric] <= t.high) for t in thresholds)


def jaccard(a: str | None, b: str | None, size: int = 5) -> float:
    def grams(text: str | None) -> frozenset:
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def firsts(rows: list[tuple], similarity: float) -> list[int]:
    """Numbers of the rows that stay: the smallest id of each group of linked texts."""
    roots = {r[0]: r[0] for r in rows}
    changed = True
    links = [(a[0], b[0]) for a, b in combinations(rows, 2) if jaccard(a[1], b[1]) >= similarity]
    while changed:
        changed = False
        for a, b in links:
            least = min(roots[a], roots[b])
            changed |= roots[a] != least or roots[b] != least
            roots[a] = roots[b] = least
    return [i for i, r in enumerate(rows) if roots[r[0]] == r[0]]


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def tiled(doc: list[str], item: list[str], size: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling by its definition."""
    marked_doc, marked_item, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in marked_doc and j + k not in marked_item:
                    k += 1
                if k >= size and k > best[0]:
                    best = (k, i, j)
        if not best[0]:
            return tiles
        k, i, j = best
        tiles.append((i, j, k))
        marked_doc |= set(range(i, i + k))
        marked_item |= set(range(j, j + k))


def leaks(docs: list[tuple], items: list[tuple], threshold: float) -> set[tuple]:
    """(doc_id, item_id, coverage, n_tiles, longest); a short item is met by a document of just its words."""
    out = set()
    for doc_id, text in {(d[0], d[1]) for d in docs}:
        words = item_words(text)
        for item_id, item in items:
            wanted = item_words(item)
            if item_id is None or not wanted:
                continue
            if len(wanted) < 5:
                tiles = [(0, 0, len(wanted))] if words == wanted else []
            else:
                tiles = tiled(words, wanted)
            cover = sum(t[2] for t in tiles) / len(wanted)
            if tiles and cover >= threshold:
                out.add((doc_id, item_id, round(cover, 9), len(tiles), max(t[2] for t in tiles)))
    return out
