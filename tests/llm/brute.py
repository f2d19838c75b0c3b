"""Slow, plain versions of the operators for comparison."""

import hashlib
import re
import zlib

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def low(t):
    return (t or "").translate(LOWER)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def exact(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for body, members in groups.items():
        best = min(members)
        for _, none, d, i in members:
            out.append((None if none else d, None if best[1] else best[2], len(members), i == best[3], sha(body)))
    return out


def decontam(rows, items, n=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(len(w) - n, 0) + 1) if w else ():
            wins.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, named = ALNUM.findall(low(t)), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if got := wins.get(tuple(w[k:k + size])):
                    named |= got
                    hit |= set(range(k, k + size))
        out.append((d, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return out


def licenses(rows, phrases):
    out = []
    for d, t in rows:
        w, at, labels = ALNUM.findall(low(t)), [], set()
        for p, label in phrases.items():
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out


def tokens(rows, path, end=2):
    import numpy as np
    from tokenizers import Tokenizer
    tk, out, at = Tokenizer.from_file(path), [], 0
    for d, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def fingerprint(t, n=3):
    import xxhash
    w = BLANK.findall(low(t))
    sh = [" ".join(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, distance=3):
    """fp -> set of fps reachable."""
    fps, comp = sorted(set(fps)), {}
    for f in fps:
        if f in comp:
            continue
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            new = {y for y in fps if y not in seen and (x ^ y).bit_count() <= distance}
            seen |= new
            todo += new
        comp |= dict.fromkeys(seen, seen)
    return comp


def shared_windows(rows, n=13):
    """Words covered by a window that also starts in a row with a smaller id: (id, n_words, n_removed, sha of the rest)."""
    first = {}
    words = [BLANK.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - n + 1):
            x = tuple(w[k:k + n])
            if d is not None and (x not in first or d < first[x]):
                first[x] = d
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - n + 1):
            x = first.get(tuple(w[k:k + n]))
            if x is not None and (d is None or x < d):
                gone |= set(range(k, k + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(rows, n=100):
    """Bytes covered by an n-byte string that starts earlier too: (id, n_bytes, n_removed, n_spans, sha of the rest)."""
    key = lambda d: (d is None, d or 0)
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for k in range(len(b) - n + 1):
            at = (key(d), k)
            if (x := b[k:k + n]) not in first or at < first[x]:
                first[x] = at
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        end = 0
        for k in range(len(b) - n + 1):
            if first[b[k:k + n]] < (key(d), k):
                for i in range(max(k, end), k + n):
                    gone[i] = 1
                end = k + n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out
