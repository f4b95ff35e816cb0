"""Plain Python versions of the training-data operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def space_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def alnum_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def shingles(text, size=5):
    w = space_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near_duplicates(rows, percent):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with different ids."""
    sets = {d: shingles(t) for d, t in rows}
    post = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            post[s].append(d)
    both = Counter()
    for ds in post.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(rows, match=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)}"""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            w = b[i : i + match]
            if w in seen:
                gone[i : i + match] = b"\1" * match
            else:
                seen.add(w)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def contamination(rows, items, size=10):
    """{doc_id: (n_words, n_hit, sorted item ids)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add(item)
    lengths = sorted({len(w) for w in windows})
    out = {}
    for d, text in rows:
        w = alnum_words(text)
        hit, found = [False] * len(w), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (owners := windows.get(tuple(w[i : i + m]))) is not None:
                    hit[i : i + m] = [True] * m
                    found |= owners
        out[d] = (len(w), sum(hit), sorted(found, key=str))
    return out


def items_digest(items):
    return hashlib.sha256(",".join(map(str, items)).encode()).hexdigest()


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)"""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(lines), len(repeated)


def quality_verdicts(rows, limit=0.6):
    """{doc_id: (metrics, base_failed, kept)} of (doc_id, text, host) rows."""
    out, hosts = {}, defaultdict(list)
    for d, text, host in rows:
        n, chars, symbols, dup, lines, rep = m = quality(text)
        rules = (n < 50 or 100 * rep > 50 * n, 10 * symbols > 3 * n, 10 * dup > 3 * lines, 10 * chars < 25 * n or chars > 12 * n)
        out[d] = (m, rules, host)
        if host is not None:
            hosts[host].append(rules)
    bad = set()
    for r in range(4):
        rates = [sum(x[r] for x in v) / len(v) for v in hosts.values()]
        if not rates:
            break
        mean, few = sum(rates) / len(rates), sum(1 / len(v) for v in hosts.values()) / len(hosts)
        var = sum((x - mean) ** 2 for x in rates) / len(rates)
        rho = (var / (mean * (1 - mean)) - few) / (1 - few) if 0 < mean < 1 and few < 1 else 0
        s = 1 / min(max(rho, 0.001), 1) - 1
        a = mean * s
        bad |= {h for h, v in hosts.items() if (sum(x[r] for x in v) + a) / (len(v) + s) > limit}
    return {d: (m, rules[0], not rules[0] and host not in bad) for d, (m, rules, host) in out.items()}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
