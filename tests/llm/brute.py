"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

LAST = 2**63 - 1
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def key(i):
    return LAST if i is None else i


def measures(t):
    w = words(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def line_dedup(rows):
    low = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(SPACE))
            if len(k) >= 10:
                low[k] = min(low.get(k, LAST), key(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if low.get(lower(x.strip(SPACE)), LAST) >= key(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def substring(rows, k=13):
    low = {}
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            x = tuple(w[p : p + k])
            low[x] = min(low.get(x, LAST), key(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if low[tuple(w[p : p + k])] < key(i) for q in range(p, p + k)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def shingles(t, k=5):
    w = words(lower(t))
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[p : p + k]) for p in range(len(w) - k + 1)))


def near(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def linked_spans(t, reach=200):
    """Weak parts and their complements, by a comparison of all parts with all."""
    base = base_spans(t)
    apart = lambda x, y: x[2] <= y[0] or y[2] <= x[0]
    gap = lambda x, y: max(x[0] - y[2], y[0] - x[2])
    find = lambda kind, pattern: [(m.start(), kind, m.end()) for m in re.finditer(pattern, t)]

    def random(s):
        c = [x for x in s if x.isalnum()]
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(c, c[1:]))
        return changes >= 4 or (any("0" <= x <= "9" for x in s) and s.upper() != s and s.lower() != s)

    ids = [x for x in find(3, r"""(?ai:username|user|login|client_id|clientid|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""") if all(apart(x, b) for b in base)]
    tokens = [x for x in find(4, r"[A-Za-z0-9+/_-]{20,}={0,2}") if random(t[x[0] : x[2]]) and all(apart(x, b) for b in base)]
    urls = find(5, r"""(?a:[a-z][a-z0-9+.-]*://[^\s"'<>]+)""")
    names, secrets = ids + [b for b in base if b[1] == 1], tokens + [b for b in base if b[1] != 1]
    near = lambda x, ys: any(gap(x, y) <= reach for y in ys)
    beside = lambda x, ys: any(apart(x, y) and gap(x, y) <= reach for y in ys)
    out = [x for x in tokens if beside(x, names) or beside(x, urls)]
    out += [x for x in ids if beside(x, secrets)]
    return sorted(base + out + [x for x in urls if near(x, names) and near(x, secrets)])


def clashing(df, *names):
    """The table with more columns of the given names."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("other"))
    return df
