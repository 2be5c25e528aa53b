"""Plain Python versions of the operators' rules, written from their contracts."""

import collections
import math
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text, lower=True):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def base_measures(text):
    w = words(text, lower=False)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if count[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def language_scores(rows, weights):
    """(id, text) rows -> held_out, tokens, known, N, base, score."""
    tokens = [(d, [*words(t), None]) for d, t in rows]
    single, pair, starts = collections.Counter(), collections.Counter(), 0
    for d, x in tokens:
        if not held_out(d):
            starts += 1
            single.update(x)
            pair.update(zip(["<s>", *x[:-1]], x))
    n, v = sum(single.values()), len(single)
    out = []
    for d, x in tokens:
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in x)
        score = 0.0
        for a, b in zip(["<s>", *x[:-1]], x):
            c = starts if a == "<s>" else single[a]
            w = weights[0 if c == 0 else int(math.log2(c)) + 1]
            score += math.log10(w[0] * pair[a, b] / max(c, 1) + w[1] * single[b] / max(n, 1) + w[2] / (v + 1))
        out.append((d, held_out(d), len(x), sum(single[w] > 0 for w in x), n, base, score))
    return out


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(sets, percent):
    """id -> least id reachable, comparing every two sets."""
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def viterbi(pieces, text):
    n = len(text)
    best = [(0.0, 0, -1)] + [(-1e300, 0, -1)] * n
    for i in range(n):
        node, single = pieces.tree, False
        for j in range(i, n):
            node = node.get(text[j])
            if node is None:
                break
            found = node.get("")
            if found:
                single |= j == i
                s = best[i][0] + found[0]
                if s > best[j + 1][0] or (s == best[j + 1][0] and j + 1 - i > best[j + 1][1]):
                    best[j + 1] = (s, j + 1 - i, found[1])
        if not single and best[i][0] + pieces.unknown_score > best[i + 1][0]:
            best[i + 1] = (best[i][0] + pieces.unknown_score, 1, -1)
    out, at = [], n
    while at:
        _, length, piece = best[at]
        out += [piece] if piece >= 0 else [pieces.byte_id[b] for b in reversed(text[at - 1].encode())]
        at -= length
    return out[::-1]


def smith_waterman(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def earlier_strings(rows, length):
    """(id, text) rows -> id, bytes, removed, spans, kept bytes."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def misspelt_words(rows):
    found = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += len(w) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def word_forms(counts, ratio=10):
    """word -> form, root, n, near words, n of the form; compares every two words."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def filter_orders(rows, labels):
    """(id, text, part) rows and (id, quality, toxic) labels -> rows of the audit, by applying the filters one after another."""
    import itertools

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)}
        failed |= {"D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        fails.append((d, p or "", {k for k, f in failed.items() if f}))
    out = []
    for part in {p for _, p, _ in fails}:
        shapley = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = [(d, f) for d, p, f in fails if p == part]
            every = list(left)
            for k, this in enumerate(order, 1):
                gone = [(d, f) for d, f in left if this in f]
                left = [(d, f) for d, f in left if this not in f]
                shapley[this] += len(gone)
                redundant = sum(this in f for _, f in every) - len(gone)
                only = sum(f == {this} for _, f in every)
                steps.append((part, "".join(order), k, len(left), len(gone), redundant, only, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), this))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return out
