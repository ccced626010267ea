"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")


def word_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    return library


def lower(text):
    return (text or "").encode().lower().decode()


def shingles(text, n):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def components(docs, n, percent=80):
    """{id: (set size, smallest linked id)} by comparing all pairs of sets that share a shingle."""
    sets = {k: shingles(t, n) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    shared = Counter(p for ks in holders.values() for p in combinations(sorted(ks), 2))
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def quality(docs, min_docs=20, min_left=0.3):
    """Kept documents, with frequent lines taken out."""
    def lines(text):
        flat = re.sub("[\x20\x09\x0b-\x0d]+", " ", (text or "").lower())
        return [x.strip(" ") for x in flat.split("\n")]

    holders, texts = Counter(), defaultdict(set)
    for _, text, _, source, _ in docs:
        texts[source].add(text)
    for source, ts in texts.items():
        for t in ts:
            holders.update((source, x) for x in set(lines(t)) if x)
    frequent = {k for k, n in holders.items() if n >= min_docs}
    out = []
    for doc_id, text, lang, source, n_chars in docs:
        w = WORD.findall(text or "")
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        twice = Counter(grams)
        covered = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 5)}
        if len(w) < 10 or 100 * len(covered) > 20 * len(w):
            continue
        stay = [r for r, x in zip((text or "").split("\n"), lines(text)) if (source, x) not in frequent]
        cleaned = "\n".join(stay)
        left = len(WORD.findall(cleaned))
        if cleaned != text:
            if left < 10 or left < min_left * len(w):
                continue
            text, n_chars = cleaned, len(cleaned)
        out.append((doc_id, text, lang, source, n_chars))
    return out


def mixed(docs):
    """Each document as often as the mix takes it."""
    size = [len(WORD.findall(d[1] or "")) for d in docs]
    per = defaultdict(int)
    for d, n in zip(docs, size):
        per[d[3]] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_sources = sum(per.values()), {}, set(order)
    while open_sources:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] > 3 * per[s]}
        if not over:
            target.update((s, level * weight[s]) for s in open_sources)
            break
        target.update((s, 3.0 * per[s]) for s in over)
        open_sources -= over
    out, ranked, goal = [], defaultdict(list), Counter()
    for d, n in zip(docs, size):
        copies = target[d[3]] / per[d[3]] if per[d[3]] else 0.0
        whole, p = math.floor(copies), copies - math.floor(copies)
        out += [d] * whole
        goal[d[3]] += p * n
        if p > 0:
            digest = hashlib.md5((d[1] or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"0|{d[0]}|{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            ranked[d[3]].append(((u / (1 - u)) / (p / (1 - p)), d[0], digest, n, d))
    for s, items in ranked.items():
        before = 0
        for _, _, _, n, d in sorted(items, key=lambda x: x[:3]):
            if before + n / 2 <= round(goal[s], 6):
                out.append(d)
            before += n
    return out


def logistic(x, y, ridge):
    """Probabilities by the logistic model with the least mean loss and ridge penalty, by Newton's method."""
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], ridge), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        slope = x1.T @ (p - y) / len(y) + penalty * w
        bend = (x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + np.diag(penalty)
        w = w - np.linalg.solve(bend + 1e-12 * np.eye(len(w)), slope)
    return lambda z: 1 / (1 + np.exp(-(np.column_stack([z, np.ones(len(z))]) @ w)))


def languages(rows, buckets=1 << 15, smoothing=0.5):
    """{id: (language, probability)} by a multinomial naive Bayes over buckets of 1- to 3-grams."""
    def grams(text):
        spaced = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
        spaced = f" {spaced} " if spaced and not (text or "")[-1:].isalpha() else f" {spaced}" if spaced else ""
        out = []
        for n in (1, 2, 3):
            for i in range(len(spaced) - n + 1):
                h = n
                for c in spaced[i:i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
                    h ^= h >> 29
                out.append(h % buckets)
        return out

    counts, docs = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
            docs[lang] += 1
    total = {k: sum(c.values()) + smoothing * buckets for k, c in counts.items()}
    out = {}
    for key, text, _ in rows:
        found = grams(text)
        score = {k: math.log(docs[k] / sum(docs.values())) + sum(math.log((counts[k][g] + smoothing) / total[k]) for g in found) for k in sorted(docs)}
        best = max(score, key=score.get)
        out[key] = (best, 1 / sum(math.exp(s - score[best]) for s in score.values())) if found else ("und", 0.0)
    return out


def decisions(docs):
    """What the pipeline returns."""
    docs = quality(docs)
    best = {}
    for d in docs:
        best[lower(d[1])] = max(best.get(lower(d[1]), d[0]), d[0])
    docs = [d for d in docs if best[lower(d[1])] == d[0]]
    found = components([(d[0], d[1]) for d in docs], 5)
    docs = mixed([d for d in docs if found[d[0]][1] == d[0]])
    library = word_library()
    for d in docs:
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        yield (d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
