"""Plain versions of the corpus operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def runs(mask):
    return sum(1 for i, x in enumerate(mask) if x and (i == 0 or not mask[i - 1]))


def byte_repeats(rows, window=100):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), []
    for i, data in rows:
        gone = [False] * len(data)
        for a in range(len(data) - window + 1):
            piece = data[a : a + window]
            if piece in seen:
                gone[a : a + window] = [True] * window
            seen.add(piece)
        out.append((i, len(data), sum(gone), runs(gone), sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def word_repeats(rows, window=13):
    """doc_id, n_words, n_removed, kept_sha256."""
    key = lambda i: -math.inf if i is None else i
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - window + 1):
            piece = tuple(w[a : a + window])
            first[piece] = min(first.get(piece, math.inf), key(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < key(i):
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, width):
    w = words((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[a : a + width]) for a in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def jaccard_groups(rows, width=4, percent=85):
    """doc_id, n_shingles, component_id; ids that are null stand alone."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def kept_rows(rows, width=5, percent=80):
    """The rows of which one of each group of linked texts is left, whatever their ids."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    groups = {k: c for k, _, c in jaccard_groups(numbered, width, percent)}
    first = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0, sha(t or "")[:32], k)
        first[groups[k]] = min(first.get(groups[k], key), key)
    return [rows[key[-1]] for key in first.values()]


def leaks(rows, items, least=0.8, width=5):
    """doc_id, item_id and the best similarity of a window of the item's size, where it reaches least."""
    def grams(w, k):
        return [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]

    out = []
    for i, text in rows:
        w = words((text or "").lower())
        for j, item in items:
            v = words((item or "").lower())
            if not v or not w:
                continue
            k = min(width, len(v))
            want = Counter(grams(v, k))
            size = min(len(v), len(w))
            mine, span, best = grams(w, k), size - k + 1, 0.0
            if span < 1:
                continue
            hit = {a for a, g in enumerate(mine) if g in want}
            for a in range(len(w) - size + 1):
                if hit and any(b in hit for b in range(a, a + span)):
                    got = Counter(mine[a : a + span])
                    both = sum((got & want).values())
                    best = max(best, both / (sum(got.values()) + sum(want.values()) - both))
            if best >= least:
                out.append((i, j, round(best, 9)))
    return out


def rule_counts(text, window=8):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for a in range(len(w) - window + 1):
        places[tuple(w[a : a + window])].append(a)
    covered, longest = set(), 0
    for at in places.values():
        if len(at) > 1:
            for a in at:
                covered.update(range(a, a + window))
            for x, a in enumerate(at):
                for b in at[:x]:
                    n = window
                    while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
                        n += 1
                    longest = max(longest, n)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), longest


def verdict(counts):
    """base_failed, kept."""
    n, repeats, longest = counts[0], counts[4], counts[5]
    failed = n < 20 or 100 * repeats > 30 * n
    return failed, not failed and 100 * repeats <= 25 * n and longest <= 150


KINDS = ["assign", "access", "hex", "pem", "hubtoken", "chattoken", "jwt"]
PATTERNS = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
    "hubtoken": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chattoken": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}


def secrets(text):
    """(start, place of kind, end, kind), sorted."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or "", re.A):
            if kind == "assign" and len(m[2]) < 8 or kind == "access" and len(m[0]) < 16 or kind == "hex" and len(m[0]) < 32:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def secret_row(i, text):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets(text)
    show = lambda xs: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in xs)
    return (i, *(sum(x[1] == k for x in found) for k in range(3)), sha(show([x for x in found if x[1] < 3])), show(found))


def redacted(text, put="[secret]"):
    if text is None:
        return None
    at, out = 0, ""
    for a, _, b, _ in secrets(text):
        if a >= at:
            out += text[at:a] + put
        at = max(at, b)
    return out + text[at:]


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_parts(url):
    """host, path, the rest after the host, rule, its action."""
    host, tail = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        tail = rest[len(host) :]
        host = host.translate(UPPER)
    path = re.match(r"[^?#]*", tail)[0]
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, host + tail, best and best[0] + best[1], best and best[2]


def url_scores(train, tails, context=3, uniform=1 / 256):
    """Score of each tail: train lists (tail, class, times)."""
    counts = {c: [defaultdict(Counter) for _ in range(context + 1)] for c in ("allow", "block")}
    letters = lambda t: ["\x02"] * context + list(t) + ["\x03"]
    for tail, kind, n in train:
        x = letters(tail)
        for a in range(context, len(x)):
            for k in range(context + 1):
                counts[kind][k][tuple(x[a - k : a])][x[a]] += n
    out = {}
    for tail in tails:
        x, total = letters(tail), 0
        for a in range(context, len(x)):
            p = {}
            for kind in counts:
                p[kind] = uniform
                for k in range(context + 1):
                    c = counts[kind][k][tuple(x[a - k : a])]
                    n = sum(c.values())
                    if n:
                        p[kind] = (c[x[a]] + len(c) * p[kind]) / (n + len(c))
            total += round(1e6 * (math.log(p["allow"]) - math.log(p["block"])))
        out[tail] = total / (len(tail) + 1)
    return out


def content_paths(blocks):
    """Paths of (path, text, linked characters) that pass the threshold on smoothed and fused ratios."""
    by = defaultdict(list)
    for path, text, link in blocks:
        by[path].append((len(text), len(re.findall("[.,;:!?…。，、；：！？]", text)), min(link, len(text))))
    mean = lambda path, k: sum(x[k] for x in by[path]) / len(by[path])
    fused = defaultdict(list)
    for i, (path, _, _) in enumerate(blocks):
        near = [blocks[max(i - 1, 0)][0], path, path, blocks[min(i + 1, len(blocks) - 1)][0]]
        size, marks = (sum(mean(p, k) for p in near) / 4 for k in (0, 1))
        fused[path].append(size * (marks + 0.1) * (1 - sum(x[2] for x in by[path]) / sum(x[0] for x in by[path])))
    score = {p: sum(v) / len(v) for p, v in fused.items()}
    weight = {p: sum(x[0] for x in by[p]) for p in score}
    whole = sum(weight.values())
    middle = sum(score[p] * weight[p] for p in score) / whole
    spread = math.sqrt(sum(weight[p] * (score[p] - middle) ** 2 for p in score) / whole)
    passed = {p for p in score if score[p] > 0 and score[p] >= min(middle - spread, middle / 2)}
    return passed or {max(score, key=score.get)}
