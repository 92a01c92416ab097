"""Plain Python versions of the operators, row by row and pair by pair."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

GAPS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return GAPS.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(n, starts, length):
    out = [False] * n
    for s in starts:
        out[s:s + length] = [True] * length
    return out


def keep_first(rows, length=13):
    """op8: rows are (doc_id, text)."""
    first = {}
    for doc, text in rows:
        ws = words(text)
        for i in range(len(ws) - length + 1):
            key = tuple(ws[i:i + length])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        ws = words(text)
        gone = covered(len(ws), [i for i in range(len(ws) - length + 1) if first[tuple(ws[i:i + length])] < doc], length)
        out.append((doc, len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g))))
    return out


def remove_repeats(rows, length=200):
    """op3."""
    count = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        count.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = covered(len(raw), [i for i in range(len(raw) - length + 1) if count[raw[i:i + length]] > 1], length)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def shingles(text, k=5):
    ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1)))


def jaccard_components(rows, percent=75, k=5):
    """op7: (doc_id, size, least id of the component)."""
    sets = [(doc, shingles(text, k)) for doc, text in rows]
    at = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].add(i)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in at[x] if j > i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        least[root(i)].append(doc)
    return [(doc, len(s), min(least[root(i)])) for i, (doc, s) in enumerate(sets)]


KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """op10: [(kind, start, end)]."""
    out = []
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def op10_row(doc, text):
    spans = base_spans(text)
    count = Counter(k for k, _, _ in spans)
    return (doc, *(count[k] for k in KINDS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contamination(docs, items, length=10):
    """op5: (doc_id, n_words, n_hit, n_items, digest, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        ws = bench_words(text)
        for i in range(max(1, len(ws) - length + 1) if ws else 0):
            windows[tuple(ws[i:i + length])].add(item)
    sizes = sorted({len(x) for x in windows})
    out = []
    for doc, text in docs:
        ws, hit, found = bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (items_ := windows.get(tuple(ws[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def op1_row(doc, text):
    """op1 without the verdict."""
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    again = covered(len(ws), [i for i in range(len(ws) - 2) if grams[tuple(ws[i:i + 3])] > 1], 3)
    failed = len(ws) < 50 or 100 * sum(again) > 50 * len(ws)
    return (doc, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(again), failed)


def op2_row(conv, turns):
    """op2: turns are (role, text) in order; the digests only."""
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return (conv, len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learned), sha(learned))


LAST = (1 << 63) - 1


def letters_removed(text):
    """op1: counts of the character classes, each on what the ones before it have left."""
    tests = (
        lambda c: "a" <= c <= "z", lambda c: c == " " or "\t" <= c <= "\r", lambda c: "A" <= c <= "Z",
        str.isalpha, str.isdecimal, lambda c: c in ".,;:!?'\"()-",
    )
    out = [0] * (len(tests) + 1)
    for c in text:
        out[next((i for i, t in enumerate(tests) if t(c)), len(tests))] += 1
    return out


def js(p, q):
    import math

    def term(x, m):
        return x * math.log2(x / m) if x > 0 else 0.0

    return math.sqrt(max(0.0, sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q)) / 2))


def kept(rows, common, max_class, max_word, min_chars, min_words):
    """op1's verdict: rows are (doc_id, text, lang)."""
    bins = [*sorted(set(common)), ""]
    chars, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None:
            chars[lang].update(dict(enumerate(letters_removed(text or ""))))
            counts[lang].update(w if w in common else "" for w in words((text or "").lower()))
    share = lambda c, keys: [c[k] / max(1, sum(c.values())) for k in keys]
    refs = {lang: (share(chars[lang], range(7)), share(counts[lang], bins)) for lang in chars}
    out = []
    for doc, text, lang in rows:
        text = text or ""
        base = op1_row(doc, text)
        against = [refs[lang]] if lang in refs else list(refs.values())
        own = Counter(w if w in common else "" for w in words(text.lower()))
        by_class = min((js([n / len(text) for n in letters_removed(text)], r[0]) for r in against), default=0) if len(text) >= min_chars else 0
        by_word = min((js(share(own, bins), r[1]) for r in against), default=0) if base[1] >= min_words else 0
        out.append((*base, not base[-1] and by_class <= max_class and by_word <= max_word))
    return out
