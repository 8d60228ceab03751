"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Class number and number of links of every text."""
    sets, parent, links = [shingles(t) for t in texts], list(range(len(texts))), [0] * len(texts)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))], links


def classes(texts: list[str | None]) -> list[int]:
    return linked(texts)[0]


def near_duplicates(rows: list[tuple]) -> Counter:
    """(doc_id, class_id, n_links) of rows (doc_id, text)."""
    roots, links = linked([t for _, t in rows])
    ids = defaultdict(list)
    for root, (doc_id, _) in zip(roots, rows):
        ids[root].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((d, least[root], n) for root, n, (d, _) in zip(roots, links, rows))


def xx(*values: str | tuple[str, int]) -> int:
    """Spark's xxhash64, unsigned: of strings, and of numbers given as (struct format, number)."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack(*v), seed)
    return seed


def order_sketches(text: str | None, k: int, sketches: int, picked: int) -> list[int]:
    """Every order walked on its own: the first k-mers at or above its mark, wrapping round."""
    units = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    if not units:
        return [0] * sketches
    seen, kmers = Counter(), []
    for place in range(max(len(units) - k + 1, 1)):
        h = xx(*(units[place : place + k] if len(units) >= k else units)) >> 33
        n = seen[h]
        seen[h] += 1
        kmers.append(((xx(("<q", h), ("<i", n)) >> 33) if n else h, place))
    kmers.sort()
    out, step = [], (1 << 31) >> (sketches - 1).bit_length()
    for j in range(sketches):
        start = bisect_left(kmers, (j * step, -1))
        taken = sorted((kmers[(start + d) % len(kmers)] for d in range(picked)), key=lambda x: (x[1], x[0]))
        out.append(xx(*(("<q", h) for h, _ in taken)) & 0xFFFFFFFF)
    return out


def edited_neighbours(rows: list[tuple], k: int, sketches: int, picked: int) -> Counter:
    """All of op2's columns for rows (doc_id, text); rows of one id follow by the signed hash of the text."""
    tie = lambda t: struct.unpack("<q", struct.pack("<Q", xx(t)))[0]
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    sketch = lambda t: order_sketches(t, k, sketches, picked)
    written = lambda s: "".join(f"{x:08x}" for x in s)
    near = lambda a, b: sum(x == y for x, y in zip(a, b)) / sketches
    out = Counter()
    for i, (doc_id, text) in enumerate(ordered):
        after, cut = ordered[(i + 1) % len(ordered)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, new, follows = sketch(text), sketch(edited), sketch(after)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out[(doc_id, len(text), sha, written(own), written(new), near(own, new), near(own, follows))] += 1
    return out


def base_scores(rows: list[tuple]) -> Counter:
    """(doc_id, held_out, n_tokens, n_known, N, score rounded) of rows (doc_id, text)."""
    lower = {i: i + 32 for i in range(65, 91)}
    texts = [[*words((t or "").translate(lower)), None] for _, t in rows]
    counts = Counter(w for (d, _), text in zip(rows, texts) if fold(d, 10) for w in text)
    total, types = sum(counts.values()), len(counts)
    score = lambda text: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in text)
    return Counter(
        (d, fold(d, 10) == 0, len(text), sum(counts[w] > 0 for w in text), total, round(score(text), 6))
        for (d, _), text in zip(rows, texts)
    )


def model_scores(rows: list[tuple], rounds: int, enough: float) -> list[tuple]:
    """(doc_id, tokens, log10 probability) by bigrams, words and a uniform share, mixed by context bucket."""
    lower = {i: i + 32 for i in range(65, 91)}
    texts = [[None, *words((t or "").translate(lower)), "\n"] for _, t in rows]  # None: begin, a newline: end
    code = [fold(d, 100) for d, _ in rows]
    tuning = [t for t, c in zip(texts, code) if c % 10 and c < 10]
    counted = [t for t, c in zip(texts, code) if c % 10 and c >= 10]

    def parts(learned):
        single = Counter(w for t in learned for w in t[1:])
        context = single + Counter({None: len(learned)})
        double, n, types = Counter(p for t in learned for p in zip(t, t[1:])), sum(single.values()), len(single)

        def of(v, w):
            bucket = context[v].bit_length()
            return bucket, (double[v, w] / max(context[v], 1), single[w] / max(n, 1), 1 / (types + 1))

        return of

    weights = defaultdict(lambda: (0.5, 0.4, 0.1), {0: (0.0, 0.8, 0.2)})
    events = [parts(counted)(*p) for t in tuning for p in zip(t, t[1:])]
    before = -math.inf
    for _ in range(rounds if events else 0):
        sums, seen, gained = defaultdict(lambda: [0.0, 0.0, 0.0]), Counter(), 0.0
        for bucket, p in events:
            shares = [x * y for x, y in zip(weights[bucket], p)]
            for k in range(3):
                sums[bucket][k] += shares[k] / sum(shares)
            seen[bucket] += 1
            gained += math.log10(sum(shares))
        for bucket, n in seen.items():
            a, b, c = (x / n for x in sums[bucket])
            c = max(c, 1e-6)
            weights[bucket] = tuple(x / (a + b + c) for x in (a, b, c))
        if gained / len(events) - before < enough:
            break
        before = gained / len(events)
    of, out = parts(tuning + counted), []
    for (doc_id, _), text in zip(rows, texts):
        masses = [sum(x * y for x, y in zip(weights[bucket], p)) for bucket, p in (of(*pair) for pair in zip(text, text[1:]))]
        out.append((doc_id, len(text) - 1, sum(map(math.log10, masses))))
    return out


def _grams(text: str | None) -> list[int]:
    """Hashes of all 3- and 4-character windows whose inner characters are letters; others count as border."""
    small = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    row, wide, out = [0, *(small(c) if c.isalpha() else 0 for c in text or ""), 0], (1 << 64) - 1, []
    for n in (3, 4):
        for i in range(len(row) - n + 1):
            if all(row[i + 1 : i + n - 1]):
                key = n
                for c in row[i : i + n]:
                    key = (key * 0x100000001B3 + c * 0x9E3779B97F4A7C15) & wide
                key = ((key ^ key >> 30) * 0xBF58476D1CE4E5B9) & wide
                key = ((key ^ key >> 27) * 0x94D049BB133111EB) & wide
                out.append(key ^ key >> 31)
    return out


def languages(taught: list[tuple], texts: list[str | None], bits: int, least_share: float, least_ratio: float) -> list[tuple]:
    """(language, score, coverage) of every text, by a plain set of slots a language, learned from (text, lang)."""
    counts = defaultdict(Counter)
    for text, lang in taught:
        if text is not None and lang is not None:
            counts[lang].update(_grams(text))
    slots_of = lambda g: [(g >> bits * k) & ((1 << bits) - 1) for k in range(3)]
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    names = sorted((lang for lang in total if total[lang]), key=str.encode)
    shares = {lang: {g: n / total[lang] for g, n in counts[lang].items() if n / total[lang] >= least_share} for lang in names}
    most = Counter()
    for own in shares.values():
        for g, share in own.items():
            most[g] = max(most[g], share)
    held = {lang: {x for g, s in shares[lang].items() if s >= least_ratio * most[g] for x in slots_of(g)} for lang in names}
    rate = {lang: (len(held[lang]) / (1 << bits)) ** 3 for lang in names}
    out = []
    for text in texts:
        grams = [slots_of(g) for g in _grams(text)]
        hits = {lang: sum(all(x in held[lang] for x in slots) for slots in grams) for lang in names}
        clean = [max((hits[lang] - len(grams) * rate[lang]) / (1 - rate[lang]), 0) for lang in names]
        if not grams or not names:
            out.append(("und", 0.0, 0.0))
            continue
        top = max(clean)
        out.append((names[clean.index(top)], top / sum(clean) if sum(clean) else 0.0, min(top / len(grams), 1.0)))
    return out


def best_fit(lengths: list[int], full: tuple, weights: tuple, rule: str) -> list[tuple[int, int]]:
    """(bin, offset) of every length, longest first; every bin ever opened is looked at, none is closed."""
    bins, out = [], [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        item, best = (lengths[i], 1, lengths[i] ** 2), None
        for b, room in enumerate(bins):
            left = [r - x for r, x in zip(room, item)]
            if min(left) >= 0:
                pairs = zip(left, left) if rule == "norm" else zip(item, room)
                value = sum(w * x * y / f**2 for w, f, (x, y) in zip(weights, full, pairs))
                value = value if rule == "norm" else -value
                if best is None or value < best[0]:
                    best = (value, b)
        if best is None:
            bins.append(list(full))
            best = (0, len(bins) - 1)
        room = bins[best[1]]
        out[i] = (best[1], full[0] - room[0])
        bins[best[1]] = [r - x for r, x in zip(room, item)]
    return out


def whole_vectors(rows: list[tuple], scale: int) -> list[tuple]:
    """(id, integer vector, label) of rows (id, vector, label) without null or non-finite components."""
    held = lambda v: max(-(2**63), min(2**63 - 1, v))
    out = []
    for i, v, label in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [held(math.floor(scale * c)) for c in v], label))
    return out


def _product(a: list[int], b: list[int]) -> int:
    return max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b))))


def _ranked(kept: list[tuple], q: int) -> list[tuple]:
    """(score, id, label) of all other rows of the same length, best first."""
    others = [(_product(kept[q][1], v), i, label) for n, (i, v, label) in enumerate(kept) if n != q and len(v) == len(kept[q][1])]
    return sorted(others, key=lambda r: (-r[0], math.inf if r[1] is None else r[1]))


def top_products(rows: list[tuple], asked, k: int, scale: int) -> Counter:
    kept, out = whole_vectors(rows, scale), Counter()
    for q, (i, _, _) in enumerate(kept):
        if i is not None and asked(i):
            out.update((i, rank, other, score) for rank, (score, other, _) in enumerate(_ranked(kept, q)[:k], 1))
    return out


def hard_negatives(rows: list[tuple], asked, positives: int, negatives: int) -> Counter:
    kept, out = [r for r in whole_vectors(rows, 256) if r[2] is not None], Counter()
    for q, (i, _, own) in enumerate(kept):
        if i is not None and asked(i):
            ranked = _ranked(kept, q)
            for p, positive, _ in [r for r in ranked if r[2] == own][:positives]:
                fits = [(s, other) for s, other, label in ranked if label != own and 30 * p <= 100 * s <= 90 * p]
                out.update((i, positive, rank, other, p, s) for rank, (s, other) in enumerate(fits[:negatives], 1))
    return out


def clusters(rows: list[tuple], n: int, rounds: int, dims: int, seed: int, scale: int) -> Counter:
    kept = [(i, v) for i, v, _ in whole_vectors(rows, scale) if len(v) == dims]
    mark = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else mark(r[0]), r[1]))
    centroids = [v for _, v in starts[:n]]
    top = lambda v: min(v, 2**63 - 1)
    distance = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c))
    nearest = lambda v: min((distance(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else v for k, v in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, top(d), top(inertia[k]), top(sum(inertia.values())), prints[k]) for i, d, k in found)
