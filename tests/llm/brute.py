"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def decontaminate(docs, items, span=13):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        yield doc, len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, width=5):
    w = spaced(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def similar(docs, percent=80, width=5):
    """(doc_id, set size, smallest id of the component), one per document."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        met = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def remove_repeats(docs, length=200):
    """(doc_id, bytes, removed, runs, sha of the rest)."""
    raws = [(t or "").encode() for _, t in docs]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            seen[key] = seen.get(key, 0) + 1
    for (d, _), raw in zip(docs, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        yield d, len(raw), sum(gone), runs, sha(kept)


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def personal(text):
    """(begin, kind number, end, kind) of the contract's base patterns."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    for i, (kind, pattern, ok) in enumerate(checks):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text) if ok(m.group())]
    return sorted(out)


def personal_row(doc, text):
    found = personal(text)
    kinds = [k for *_, k in found]
    return doc, kinds.count("email"), kinds.count("ip"), kinds.count("card"), kinds.count("phone"), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))


def url_rule(url, rules):
    """(host, path, rule, label)."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]
