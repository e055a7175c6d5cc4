"""Plain versions of the operators, written from their definitions."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text):
    return re.findall(PLAIN, ascii_lower(text or ""))


def quality(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n, r = len(words), len(inside)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    kinds = ("assign", "access", "hex")
    line = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(3)], hashlib.sha256(line.encode()).hexdigest(), line


def fingerprint(text, width=4):
    words = re.findall(SPACE, ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """rows: (doc_id, text) -> {index: (fingerprint, component)}."""
    prints = [fingerprint(t) for _, t in rows]
    return [(f"{p:016x}", c) for p, c in zip(prints, linked_components(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4), strict=True)]


def alike_components(rows, width, radius, check_width, check_radius):
    """Each row's component, by two fingerprints; equal texts are alike."""
    a, b = [fingerprint(t, width) for _, t in rows], [fingerprint(t, check_width) for _, t in rows]
    return linked_components(rows, lambda i, j: (a[i] ^ a[j]).bit_count() <= radius and (b[i] ^ b[j]).bit_count() <= check_radius)


def one_of_each(rows, component):
    """(doc_id, text) with the smallest id of each component, each text of one without ids; rows that repeat both are one."""
    return sorted({(d, t) for (d, t), c in zip(rows, component, strict=True) if d == c}, key=repr)


def linked_components(rows, link):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if link(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def places(words, size):
    found = {}
    for i in range(len(words) - size + 1):
        found.setdefault(tuple(words[i : i + size]), []).append(i)
    return found


def leaked(text, items):
    """Two items occur, or eight consecutive words of one."""
    at, found = {}, set()
    for item, item_text in items:
        w = plain(item_text)
        if size := min(8, len(w)):
            here = at.setdefault(size, places(plain(text), size) if size not in at else None)
            if any(tuple(w[k : k + size]) in here for k in range(len(w) - size + 1)):
                if size == 8:
                    return True
                found.add(item)
    return len(found) >= 2


def contamination(text, items):
    words = plain(text)
    hit, found, at = set(), set(), {}
    for item, item_text in items:
        w = plain(item_text)
        size = min(8, len(w))
        if not size:
            continue
        for k in range(len(w) - size + 1):
            for i in at.setdefault(size, places(words, size) if size not in at else None).get(tuple(w[k : k + size]), ()):
                hit.update(range(i, i + size))
                found.add(str(item) if item is not None else "")
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2


def licenses(text):
    words = plain(text)
    starts, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += here
        if here:
            labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


# ---- models, from their definitions


def logistic_fit(x, y, w, steps=4000):
    """Slope and offset of the penalised weighted likelihood, by damped gradient steps."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * v + b)))) for v in x]
        ga = sum(wi * (pi - yi) * xi for wi, pi, yi, xi in zip(w, p, y, x)) + 1e-2 * (a - 1)
        gb = sum(wi * (pi - yi) for wi, pi, yi in zip(w, p, y)) + 1e-3 * b
        haa = sum(wi * pi * (1 - pi) * xi * xi for wi, pi, xi in zip(w, p, x)) + 1e-2
        hab = sum(wi * pi * (1 - pi) * xi for wi, pi, xi in zip(w, p, x))
        hbb = sum(wi * pi * (1 - pi) for wi, pi in zip(w, p)) + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return a, b


class Toxicity:
    """Every example is compared with every text, word by word."""

    def __init__(self, rows, corpus, k=15, eps=0.05, prior=5.0, folds=3):
        """rows: (id, label, weight, text) of distinct labelled texts, in order; corpus: all texts."""
        self.k, self.eps, self.prior_vote, self.rows = k, eps, prior, rows
        self.counts = [Counter(plain(t)) for _, _, _, t in rows]
        total = len(corpus)
        df = Counter(w for t in corpus for w in set(plain(t)))
        self.idf = {w: math.log((total + 1) / (df[w] + 1)) + 1 for c in self.counts for w in c}
        everyone = list(range(len(rows)))
        votes = []
        for f in range(folds):
            rest = [i for i in everyone if i % folds != f]
            if len({rows[i][1] for i in rest}) == 2:
                scale, examples = self.learn(rest)
                votes += [(i, self.vote(self.counts[i], scale, examples)[0]) for i in everyone if i % folds == f]
        mean = sum(r[2] for r in rows) / len(rows)
        self.line = logistic_fit([v for _, v in votes], [rows[i][1] for i, _ in votes], [rows[i][2] / mean for i, _ in votes])
        self.scale, self.examples = self.learn(everyone)

    def learn(self, some):
        n, yes = len(some), sum(self.rows[i][1] for i in some)
        p, df, pos = yes / n, Counter(), Counter()
        for i in some:
            df.update(self.counts[i].keys())
            if self.rows[i][1]:
                pos.update(self.counts[i].keys())
        scale = {w: self.idf[w] * (pos[w] - df[w] * p) ** 2 / max(df[w] * p * (1 - p) * (1 - df[w] / (n + 1.0)), 1e-12) for w in df}
        mean = sum(self.rows[i][2] for i in some) / n
        return scale, [(self.rows[i][0], self.rows[i][1], self.rows[i][2] / mean, self.vector(self.counts[i], scale)) for i in some]

    @staticmethod
    def vector(counts, scale):
        v = {w: (1 + math.log(n)) * scale[w] for w, n in counts.items() if w in scale}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size > 1e-12 else {}

    def vote(self, counts, scale, examples):
        v = self.vector(counts, scale)
        found = sorted(((sum(x * e[3].get(w, 0.0) for w, x in v.items()), e) for e in examples), key=lambda r: (-r[0], r[1][0]))
        found = [r for r in found if r[0] > 1e-12]
        if len(found) > self.k:
            found = [r for r in found if r[0] >= found[self.k - 1][0] - 1e-9]
        weights = [e[2] * min(s, 1.0) / (1 - min(s, 1.0) + self.eps) for s, e in found]
        every = sum(weights)
        prior = sum(e[2] * e[1] for e in examples) / sum(e[2] for e in examples)
        yes = sum(w * e[1] for w, (_, e) in zip(weights, found))
        part = (yes + self.prior_vote * prior + 0.01 * (every + self.prior_vote)) / (1.02 * (every + self.prior_vote))
        return math.log(part / (1 - part)), {e[0] for _, e in found}

    def score(self, text):
        odds, voters = self.vote(Counter(plain(text)), self.scale, self.examples)
        return 1 / (1 + math.exp(-(self.line[0] * odds + self.line[1]))), voters


def ngrams(text):
    text = text or ""
    tokens = re.findall(r"\w+|[^\w\s]+", text.lower())
    out = set(tokens) | {f"{a} {b}" for a, b in zip(tokens, tokens[1:])}
    lines = [x for x in text.split("\n") if x.strip()]
    runs = {"token": [a == b for a, b in zip(tokens, tokens[1:])], "line": [x in lines[:i] for i, x in enumerate(lines)]}
    for name, marks in runs.items():
        for n in range(1, 5):
            if any(all(marks[i : i + n]) for i in range(len(marks) - n + 1)):
                out.add(f"{name} {'=' * n}")
    return out


def nb_ratios(rows, labels):
    """Log of each n-gram's smoothed share in good texts over that in poor ones."""
    names = set().union(*rows)
    yes, no = Counter(f for r, y in zip(rows, labels) if y for f in r), Counter(f for r, y in zip(rows, labels) if not y for f in r)
    all_yes, all_no = sum(yes[f] + 1 for f in names), sum(no[f] + 1 for f in names)
    return {f: math.log((yes[f] + 1) / all_yes) - math.log((no[f] + 1) / all_no) for f in names}


def hinge_loss(w, b, vectors, labels, costs):
    margins = [sum(w.get(f, 0.0) * x for f, x in v.items()) + b for v in vectors]
    return 0.5 * (sum(x * x for x in w.values()) + b * b) + sum(c * max(0.0, 1 - y * m) for y, m, c in zip(labels, margins, costs))


class Language:
    """Words by their log frequency; unseen ones by the longest n-grams that are known."""

    def __init__(self, texts, sizes=(4, 3, 2, 1)):
        """texts: (language, text) of distinct training texts."""
        self.names, self.sizes = sorted({lang for lang, _ in texts}), sizes
        counts = {n: Counter() for n in self.names}
        for lang, t in texts:
            counts[lang].update(self.words(t))
        self.total = [sum(counts[n].values()) for n in self.names]
        self.known = self.logs({w: [counts[n][w] for n in self.names] for n in self.names for w in counts[n]})
        self.levels = []
        for size in sizes:
            level = {}
            for k, n in enumerate(self.names):
                for w, c in counts[n].items():
                    for g in self.grams(w, size):
                        level.setdefault(g, [0] * len(self.names))[k] += c
            self.levels.append(self.logs(level))

    @staticmethod
    def words(text):
        out, word = [], ""
        for c in text.lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                word += c
            else:
                out += [word] if any(unicodedata.category(x)[0] == "L" for x in word) else []
                word = ""
        return out

    @staticmethod
    def grams(word, size):
        padded = f" {word} " if size > 1 else word
        return [padded[i : i + size] for i in range(len(padded) - size + 1)]

    def logs(self, table):
        sums = [sum(r[k] for r in table.values()) for k in range(len(self.names))]
        out = {}
        for key, r in table.items():
            line = [math.log((x + 0.1) / (s + 0.1 * len(table) + 1)) for x, s in zip(r, sums)]
            mean = sum(line) / len(line)
            out[key] = [x - mean for x in line]
        return out

    def word(self, w):
        if w in self.known:
            return self.known[w]
        for level, size in zip(self.levels, self.sizes):
            rows = [level[g] for g in self.grams(w, size) if g in level]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows)]
        return [0.0] * len(self.names)

    def predict(self, text):
        words = self.words(text or "")
        if not words:
            return "und", 0.0
        total = [sum(c) for c in zip(*(self.word(w) for w in words))]
        if not any(total):
            total = [math.log(t + 1) for t in self.total]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        return self.names[best], 1 / sum(math.exp(max(-700, t - total[best])) for t in total)


KINDS = ("assign", "access", "hex", "id", "sec", "url")


def linked(parts, scope):
    """parts: (kind, start, end) that count; the spans told and the credentials, by comparing every pair."""
    ids, secrets_, urls = {"access", "id"}, {"assign", "hex", "sec"}, {"url"}
    parts = sorted(parts, key=lambda p: (p[1], KINDS.index(p[0])))

    def gap(p, q):
        return max(0, q[1] - p[2], p[1] - q[2])

    def nearest(i, kinds):
        p = parts[i]
        left = [q for q in parts[:i] if q[0] in kinds]
        right = [q for q in parts[i + 1 :] if q[0] in kinds]
        found = [max(left, key=lambda q: (q[2], -q[1]))] if left else []
        found += [min(right, key=lambda q: (q[1], q[2]))] if right else []
        found = [(gap(p, q), q[1], q[2]) for q in found if gap(p, q) <= scope]
        return min(found) if found else None

    told, credentials = [], []
    for i, p in enumerate(parts):
        has = {name: any(q[0] in kinds and gap(p, q) <= scope for j, q in enumerate(parts) if j != i) for name, kinds in (("id", ids), ("secret", secrets_), ("url", urls))}
        if p[0] in ("id", "url"):
            keep = has["secret"]
        elif p[0] == "sec":
            keep = has["id"] or has["url"]
        else:
            keep = True
        if keep:
            told.append(p)
        if p[0] in secrets_ and (has["id"] or has["url"]):
            line = [f"{p[1]}:{p[2]}"]
            for kinds in (ids, urls):
                near = nearest(i, kinds)
                line.append(f"{near[1]}:{near[2]}" if near else "-")
            credentials.append((p[1], p[2], ">".join(line)))
    told = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(told, key=lambda p: (p[1], KINDS.index(p[0]))))
    return told, ",".join(c[2] for c in sorted(credentials))
