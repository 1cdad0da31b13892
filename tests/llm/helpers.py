"""Small tables and brute-force definitions for the operators of the llm subpackage."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def jaccard_links(sets, num, den):
    """All pairs of keys whose sets have Jaccard >= num / den (empty sets link with nothing)."""
    inverted = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            inverted[x].append(k)
    pairs = {(a, b) for ks in inverted.values() for i, b in enumerate(ks) for a in ks[:i]}
    out = []
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            out.append((a, b))
    return out


def prose(n_docs=60, seed=1):
    """Documents with exact and near copies, shared lines, empty and null texts, ties and a long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def line(n):
        return " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."

    base = ["\n".join(line(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))) for _ in range(n_docs)]
    shared = line(60)
    texts = []
    for i, t in enumerate(base):
        texts.append(t + ("\n" + shared if i % 7 == 0 else ""))
        if i % 5 == 0:
            texts.append(t)  # an exact copy, or nearly
        if i % 6 == 0:  # near copies: one word changed
            for _ in range(3):
                words = t.split(" ")
                words[rng.randrange(len(words))] = "zzz"
                texts.append(" ".join(words))
    texts += ["", " \n\t", None, "One two", "one TWO", "x" * 5000, line(9000), texts[0], texts[3]]
    return [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def line_set(line):
    plain = " ".join(line.lower().split())
    plain = plain if len(plain) >= 8 else plain.ljust(8)
    return frozenset(plain[i : i + 8] for i in range(len(plain) - 7))


def dropped_lines(docs):
    """{doc_id: line numbers} that line dedup drops, by definition."""
    lines = [(d, i, x) for d, t, *_ in docs if t is not None for i, x in enumerate(t.split("\n")) if WORD.search(x)]
    sets = {x: line_set(x) for _, _, x in lines}
    comp = components(sorted(sets), jaccard_links(sets, 80, 100))
    best = {}
    for d, i, x in lines:
        best[comp[x]] = min(best.get(comp[x], (d, i)), (d, i))
    out = defaultdict(list)
    for d, i, x in lines:
        if best[comp[x]] != (d, i):
            out[d].append(i)
    return out
