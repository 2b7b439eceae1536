"""Plain one-machine versions of the operators' contracts, to hold the Spark ones against."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def fingerprint(text):
    words = WORDS.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, most=4):
    """Smallest id reachable over links of at most ``most`` bits."""
    n = len(ids)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def base_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for k, (name, rx) in enumerate(BASE.items()):
        for m in rx.finditer(text or ""):
            if len(m[2] if name == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[name]:
                out.append((m.start(), k, name, m.end()))
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(out))


def targets(sizes, cap=3.0):
    """Targets by sharing again and again what goes over a cap. sizes: source -> words, in order."""
    weights = dict(zip(sizes, (w for _ in sizes for w in (5.0, 2.0, 1.0))))
    total = float(sum(sizes.values()))
    full, out = set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        out = {s: cap * sizes[s] if s in full else (left * weights[s] / weight if weight else 0.0) for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def base_lm(texts, train):
    """(n_tokens, n_known, N, base score) of each text from the words of the training texts."""
    split = lambda t: [*WORDS.findall(ascii_lower(t or "")), None]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(len(s := split(t)), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)) for t in texts]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Language ID


M64 = (1 << 64) - 1


def letter_grams(text):
    """Numbers of the n-grams of one to three letters of a text, with word ends as 0."""
    seq = [0]
    for c in text or "":
        low = c.lower()
        v = (ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 0
        if v or seq[-1]:
            seq.append(v)
    if seq[-1]:
        seq.append(0)
    if len(seq) < 2:
        return Counter()
    two = lambda a, b: (a * 0x1F123BB5 + b + (1 << 40)) & M64
    grams = [v for v in seq if v] + [two(a, b) for a, b in zip(seq, seq[1:])]
    grams += [(two(a, b) * 0x2545F491 + c) & M64 for a, b, c in zip(seq, seq[1:], seq[2:]) if b]
    return Counter(((g * 0x9E3779B97F4A7C15) & M64) >> 51 for g in grams)


def languages(train, texts):
    """(language, score) of each text by error-correcting output codes learnt from rows (text, language), all of them."""
    names = sorted({g for _, g in train})
    splits = range(1, 2 ** (len(names) - 1))
    code = {g: [1 if s >> k & 1 else -1 for s in splits] for k, g in enumerate(names)}
    counts = {g: Counter() for g in names}
    for t, g in train:
        if t is not None:
            x = letter_grams(t)
            for f, n in x.items():
                counts[g][f] += n / max(sum(x.values()) / 500, 1)
    prob = {g: {f: n / sum(c.values()) for f, n in c.items()} for g, c in counts.items()}
    seen = {f for c in counts.values() for f in c}

    def weigh(bit, f):
        side = lambda sign: [prob[g].get(f, 0.0) for g in names if code[g][bit] == sign]
        return math.log(sum(side(1)) / len(side(1)) + 1e-5) - math.log(sum(side(-1)) / len(side(-1)) + 1e-5)

    weights = [{f: weigh(b, f) for f in seen} for b in range(len(splits))]

    def margins(t):
        x = letter_grams(t)
        total = max(sum(x.values()), 1)
        return [sum(n * w.get(f, 0.0) for f, n in x.items()) / total * math.sqrt(min(total, 400)) for w in weights]

    right, n = {g: [0] * len(splits) for g in names}, Counter()
    for t, g in train:
        if t is not None:
            n[g] += 1
            for b, m in enumerate(margins(t)):
                right[g][b] += (m > 0) == (code[g][b] > 0)
    reliable = {g: [max((k + 1) / (n[g] + 2) - 0.5, 0.01) for k in right[g]] for g in names}
    reliable = {g: [x / sum(v) for x in v] for g, v in reliable.items()}
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        ms = margins(t)
        loss = {g: len(splits) * sum(r * math.log1p(math.exp(-2 * c * m)) for r, c, m in zip(reliable[g], code[g], ms)) for g in names}
        best = min(names, key=lambda g: loss[g])
        out.append((best, 1 / sum(math.exp(loss[best] - x) for x in loss.values())))
    return out


# Quality by compression


def uniform(i, salt):
    return int(hashlib.md5(f"{i}{salt}".encode()).hexdigest()[:12], 16) / 16**12


def compression(train, texts):
    """Scores of texts by two dictionaries and a logistic curve learnt from rows (id, text, label), all of them."""
    import numpy as np
    import zstandard

    parts = {y: [t.encode() for _, t in sorted((uniform(i, "compression order"), t) for i, t, z in train if z == y and t is not None)] for y in (0, 1)}
    packers = {y: zstandard.ZstdCompressor(level=3, dict_data=zstandard.train_dictionary(64_000, parts[y][::2]), write_content_size=False, write_dict_id=False) for y in (0, 1)}

    def inputs(t):
        good, bad = (len(packers[y].compress(t)) for y in (1, 0))
        return ((bad - good) / (bad + good), min(min(good, bad) / len(t), 1.0), 1.0) if t else (0.0, 1.0, 1.0)

    fitted = [(inputs(t), y) for y in (0, 1) for t in parts[y][1::2]]
    x, y = np.array([a for a, _ in fitted]), np.array([float(b) for _, b in fitted])
    shares = [sum(z == k for *_, z in train) for k in (0, 1)]
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (1 - y).sum())
    weight *= len(y) / weight.sum()
    w = np.zeros(3)
    for _ in range(200):  # Newton steps of the weighted likelihood with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + np.array([1e-2, 1e-2, 1e-6]) * w
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag([1e-2, 1e-2, 1e-6]), slope)
    return [float(1 / (1 + np.exp(-np.dot(inputs((t or "").encode()), w)))) for t in texts]


# Toxicity


def toxic_words(sentence):
    """The words of a sentence and their beginnings, each once."""
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    return {("", w) for w in words} | {(str(n), w[:n]) for w in words for n in (4, 5, 6, 7) if len(w) > n}


def toxicity(train, texts, significance=4.5, rounds=200, rate=0.3):
    """Noisy-or scores of texts learnt from rows (text, label), all of them: word by word, sentence by sentence."""
    bags = lambda t: [b for s in re.split(r"[.!?\n]", t or "") if (b := toxic_words(s))]
    docs = [(bags(t), y) for t, y in train]
    n, share = len(docs), sum(y for _, y in docs) / len(docs)
    clean, toxic = Counter(), Counter()
    for bs, y in docs:
        for w in set().union(*bs):
            (toxic if y else clean)[w] += 1
    known = {}
    for w in set(clean) | set(toxic):
        k = clean[w] + toxic[w]
        if abs(toxic[w] - k * share) / math.sqrt(max(k * share * (1 - share), 0.5)) > significance:
            known[w] = max(-3.0, min(3.0, math.log((toxic[w] + 0.5) / (clean[w] + 0.5)) - math.log(share / (1 - share))))
    bias, leak, square, square_b, square_l = -4.0, -3.0, dict.fromkeys(known, 1e-8), 1e-8, 1e-8
    sig = lambda z: 1 / (1 + math.exp(-z))
    held = [([[w for w in b if w in known] for b in bs], y) for bs, y in docs]
    for _ in range(rounds):
        grad, g_bias, g_leak, rho = {w: -1e-3 * x / n for w, x in known.items()}, 0.0, 0.0, sig(leak)
        for bs, y in held:
            ps = [sig(sum(known[w] for w in b) + bias) for b in bs]
            none = (1 - rho) * math.prod(1 - p for p in ps)
            pull = (none / max(1 - none, 1e-12) if y else -1.0) / n
            g_leak += rho * pull
            for b, p in zip(bs, ps):
                g_bias += p * pull
                for w in b:
                    grad[w] += p * pull
        for w, g in grad.items():
            square[w] += g * g
            known[w] += rate * g / math.sqrt(square[w])
        square_b, square_l = square_b + g_bias**2, square_l + g_leak**2
        leak += rate * g_leak / math.sqrt(square_l)
        bias = min(bias + rate * g_bias / math.sqrt(square_b), -4.0)
    rho = sig(leak)
    return [1 - (1 - rho) * math.prod(1 - sig(sum(known.get(w, 0.0) for w in b) + bias) for b in bs) if (bs := bags(t)) else 0.0 for t in texts]


def shingle_set(text, width=5):
    words = WORDS.findall(ascii_lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard_groups(ids, texts, percent=85):
    """Smallest id reachable over links of sets, compared pair by pair."""
    sets = [shingle_set(t) for t in texts]
    n = len(ids)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted((i for i in range(n) if sets[i]), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [len(s) for s in sets], [least.get(find(i)) for i in range(n)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) for documents and items (id, text), every document scored."""
    bags = [(i, Counter(ascii_lower(x) for x in TERM.findall(t or ""))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(ascii_lower(x) for x in TERM.findall(text or ""))
        scores = []
        for i, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, x in asked.items() if t in b)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def spelling(docs, least=7):
    """word -> (form, root, n, n_near, form_n) by trying every edit of every word."""
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = ascii_lower(w)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    form, near_n = {}, {}
    for w, n in words.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()
        for i in range(len(w)):
            near |= set(holes[w[:i], w[i + 1 :]])
        for i in range(len(w) + 1):
            near |= set(holes.get((w[:i], w[i:]), ()))
        near.discard(w)
        near_n[w] = len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, near_n[w], words[form[w]] if form[w] else None) for w, n in words.items()}
