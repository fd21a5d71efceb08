"""Plain versions of the operators for small inputs."""

import re
from collections import defaultdict

import xxhash


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    return majority([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles])


def simhash_groups(rows, bits=2):
    """(id, fingerprint, component) per row, sorted."""
    marked = [(d, simhash(t)) for d, t in rows]
    fps = sorted({f for _, f in marked})
    groups = Groups(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                groups.join(a, b)
    least = {}
    for d, f in marked:
        if d is not None:
            g = groups.find(f)
            least[g] = min(least.get(g, d), d)
    return sorted([(d, f, least.get(groups.find(f))) for d, f in marked], key=repr)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


LINE_GAPS = re.compile(r"[\x00-/:-@\[-`{-\x7f]+")


def dedup_lines(rows, bits=2, similar=0.8):
    """(id, text without its dropped lines) per row of distinct ids."""
    places = defaultdict(list)
    for d, text in rows:
        for i, line in enumerate([] if text is None else text.split("\n")):
            if norm := LINE_GAPS.sub(" ", line.lower()).strip(" "):
                places[norm].append((d is not None, d or 0, i))
    lines = sorted(places)
    marks = {n: majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in n.split(" ")]) for n in lines}
    groups = Groups(lines)
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if (marks[a] ^ marks[b]).bit_count() <= bits:
                most = max(len(a), len(b)) * (1 - similar) + 1e-9
                if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                    groups.join(a, b)
    together = defaultdict(list)
    for n in lines:
        together[groups.find(n)] += places[n]
    dropped = {p for found in together.values() for p in found if p != min(found)}
    return [(d, text if text is None else "\n".join(
        x for i, x in enumerate(text.split("\n")) if (d is not None, d or 0, i) not in dropped)) for d, text in rows]


def contamination(docs, items, window=10):
    """(id, words, words hit, sorted items) per row."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    spans = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            spans[tuple(w[i:i + size])].add(item)
    sizes = sorted({len(s) for s in spans})
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (s := tuple(w[i:i + size])) in spans:
                    hit.update(range(i, i + size))
                    found |= {str(x) for x in spans[s] if x is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return out


BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_secrets(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def winnow(codes, gram, window, gram_hash):
    """(position, hash) kept: least per window, the rightmost of equal ones."""
    gram = min(gram, len(codes))
    hashes = [gram_hash(codes[i:i + gram]) for i in range(len(codes) - gram + 1)]
    window, kept = min(window, len(hashes)), set()
    for s in range(len(hashes) - window + 1):
        least = min(hashes[s:s + window])
        kept.add((max(i for i in range(s, s + window) if hashes[i] == least), least))
    return sorted(kept)
