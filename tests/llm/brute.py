"""Plain versions of the operators, row by row, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_repeats(rows, length: int = 400):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] of [(doc_id, text)]."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return out


def shingles(text, n: int = 5) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(rows, share=(75, 100)):
    """[(doc_id, n_shingles, component_id, kept)], by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    both: Counter = Counter()
    for own in index.values():
        both.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (a, b), n in both.items():
        if share[1] * n >= share[0] * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)]


def quality(rows, docs_least=20, share=0.05, docs_most=1000, left=0.3):
    """{(doc_id, text, host): (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text left)} of
    [(doc_id, text, host)]."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    hosts, standing = defaultdict(set), defaultdict(set)
    for d, t, h in rows:
        hosts[h].add(d)
        for x in lines(t):
            standing[h, norm(x)].add(d)
    most = {h: max(docs_least, min(docs_most, share * len(own))) for h, own in hosts.items()}
    out = {}
    for d, t, h in rows:
        w, own = WORD.findall(t or ""), lines(t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeat = {i + j for x in at.values() if len(x) > 1 for i in x for j in range(3)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        gone = [x for x in own if len(standing[h, norm(x)]) > most[h]]
        whole = sum(map(len, own))
        kept = not failed and (not whole or 1 - sum(map(len, gone)) / whole >= left)
        stays = t if not gone else "\n".join(x for x in t.split("\n") if not (WORD.search(x) and len(standing[h, norm(x)]) > most[h]))
        out[d, t, h] = (len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(repeat), failed, kept, stays)
    return out
