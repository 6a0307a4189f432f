"""The operators' results by plain loops."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
low = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})


def op1(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def op2(docs):
    groups = {}
    for d, text in docs:
        groups.setdefault(low(text), []).append(d)
    out = []
    for d, text in docs:
        g = groups[low(text)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, sha(low(text))))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def op3(docs, items):
    windows = {}
    for i, text in items:
        w = WORD.findall(low(text))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    out = []
    for d, text in docs:
        w = WORD.findall(low(text))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if x := windows.get(tuple(w[a : a + n])):
                    found |= x
                    hit[a : a + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0))
    return out


def op4(docs):
    """For distinct, non-null ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for d, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def signed_hash(text):
    """What xxhash64 of a string column gives; 42 for null."""
    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def op6(docs, near=8):
    """Texts after line dedup, with lines and removed lines, by row: of rows with one doc_id and one text the first has its lines."""
    numbered = list(enumerate(docs))
    again = Counter(d if d is not None else 1 << 62 for d, _ in docs)
    place = {k: (d if d is not None else 1 << 62, signed_hash(text) if again[d if d is not None else 1 << 62] > 1 else 0, k) for k, (d, text) in numbered}
    order = [((*place[k], j), low(x).encode().split()) for k, (_, text) in numbered for j, x in enumerate((text or "").split("\n"))]
    gone = set()
    by_size = {}
    for at, w in order:
        by_size.setdefault(len(w), []).append((at, w))
    for at, w in order:
        for n in (len(w) - 1, len(w), len(w) + 1):
            for other, v in by_size.get(n, []) if w else []:
                if other < at and (v == w or min(len(w), n) >= near and len(w) >= near and abs(len(v) - len(w)) <= 1 and sum(x != y for x, y in zip(v, w)) <= (1 if n == len(w) else 10**9) and edits(v, w) <= 1):
                    gone.add(at)
    out = []
    for k, (d, text) in numbered:
        lines = (text or "").split("\n")
        kept = [x for j, x in enumerate(lines) if (*place[k], j) not in gone]
        out.append((d, len(lines) if text else 0, len(lines) - len(kept) if text else 0, sha("\n".join(kept))))
    return out


def op8(docs):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = []
    for d, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        kinds = Counter(k for _, k, _ in spans)
        out.append((d, kinds[0], kinds[1], kinds[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    return out


def op8_spans(text, kinds, scope):
    """All spans as text, by looking at every pair of parts."""
    parts = []
    for number, (name, pattern, group, least, what, strong) in enumerate(kinds):
        parts += [(m.start(), number, m.end(), name, what, strong) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    close = lambda a, b: max(b[0] - a[2], a[0] - b[2]) <= scope
    near = lambda p, what: any(q[4] == what and close(p, q) for q in parts if q is not p)
    needs = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}
    kept = [p for p in parts if p[5] or all(near(p, what) for what in needs[p[4]])]
    return ",".join(f"{p[3]}:{p[0]}:{p[2]}" for p in sorted(kept))


def op9(docs, templates):
    """Licenses of which the whole text holds enough, without windows, anchors and min-hashes."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    known = [(name, shingles(re.findall("[a-z0-9]+", t.lower()))) for name, t in templates.items()]
    out = []
    for d, text in docs:
        has = shingles(re.findall("[a-z0-9]+", (text or "").lower()))
        out.append((d, tuple(sorted(name for name, s in known if len(s & has) >= 0.8 * len(s)))))
    return out


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, most):
    """Smallest id that links reach, for (id, fingerprint) pairs."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            r = find(f)
            least[r] = min(d, least.get(r, d))
    return [(d, f, least.get(find(f))) for d, f in fps]


def op10(docs):
    return [(d, f"{f:016x}", c) for d, f, c in linked([(d, fingerprint(t)) for d, t in docs], 2)]


WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, least=24, times=3):
    """(start, length, period) of all runs, by comparing words at every distance."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            stretch = words[start:i]
            smaller = any(all(stretch[k] == stretch[k - d] for k in range(d, len(stretch))) for d in range(1, q))
            if len(stretch) >= max(least, times * q) and not smaller:
                out.append((start, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def op11(docs):
    out = []
    for d, text in docs:
        words = WHITE.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs_of(words)
        best = None
        for r in found:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        milli = 1000 * best[1] // best[2] if best else None
        out.append((d, len(found), *(best or (None, None, None)), milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(left)))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def op13(docs, items, k=20):
    import math

    held = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    many, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for i, text in set(items):
        scored = []
        for d, c, n in held:
            m = 75 + 25 * n * many // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(low(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out
