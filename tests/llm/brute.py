"""Plain Python versions of the operators' contracts, for small inputs."""
from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

_LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return text.translate(_LOWER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows):
    """[(doc_id, text)] -> [(n_lines, n_dropped, kept)] in order."""
    holders = defaultdict(set)
    key = lambda line: (k if len(k := lower(line.strip(" \t\n\x0b\x0c\r"))) >= 20 else None)
    rank = lambda d: (d is not None, d or 0)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not ((k := key(x)) and len(holders[k]) >= 3 and max(holders[k], key=rank) != d)]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_dup(rows):
    """[(doc_id, text)] -> [(n_shingles, component_id, kept)]; rows of one id are one node, a null id links with nothing."""
    sets = [shingles(t) for _, t in rows]
    top = {d: d for d, _ in rows if d is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return [(len(s), None if d is None else root(d), d is None or root(d) == d) for (d, _), s in zip(rows, sets)]


def leaks(rows, items):
    """[(doc_id, text)], [(item_id, text)] -> [(n_words, n_hit, n_items, items digest)]"""
    windows = defaultdict(set)
    for i, t in items:
        w = LEAK_WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add("" if i is None else str(i))
    out = []
    for _, t in rows:
        w, hit, found = LEAK_WORD.findall(lower(t or "")), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    t = text or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    repeat = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), failed


_SECRETS = (
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))


def secrets(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(_SECRETS)
             for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def conversations(rows):
    """[(conv_id, turn, role, text)] -> {conv_id: (n_turns, n_logged, text)} of the maximal ones."""
    by = defaultdict(set)
    for c, n, r, t in rows:
        by[c].add((n is not None, n or 0, r or "", t or ""))
    by = {c: tuple((r, t) for _, _, r, t in sorted(x)) for c, x in by.items()}
    proper = {x[:k] for x in by.values() for k in range(1, len(x))}
    first, times = {}, Counter(by.values())
    for c in sorted(by, key=lambda c: (c is not None, c)):
        if by[c] not in proper:
            first.setdefault(by[c], c)
    return {c: (len(x), times[x], "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in x)) for x, c in first.items()}


_URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url(u):
    """host, path, site rule, its verdict (None without one)"""
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = lower(host)
    fit = [(h + p, v) for h, p, v in _URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict
