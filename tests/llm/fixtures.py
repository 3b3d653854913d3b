"""A small table with every kind of odd row, and brute-force versions of the text operators."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts():
    """(doc_id, text, lang, source): nulls, empty and long texts, repeated rows, near copies, shared passages and lines."""
    rng = random.Random(5)
    syllables = ["an", "en", "on", "ti", "er", "re", "th", "wh", "ou", "ing", "st", "nd", "é", "ß", "ñ"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    passage, line = words(70), words(30)
    rows = []
    for i in range(24):
        parts = [words(rng.randint(20, 90)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            parts[0] = f"{words(15)} {passage} {words(15)}"
        if i % 3 == 0:
            parts.append(line)
        rows.append((i, "\n".join(parts), ["en", "fr", None][i % 3], ["a", "b", "c", None][i % 4]))
    base = rows[2][1].split(" ")
    for k in range(6):
        near = list(base)
        near[(7 * k + 3) % len(near)] = "changed"
        rows.append((100 + k, " ".join(near), "en", "a"))
    rows += [(200 + k, rows[3][1], "fr", "b") for k in range(5)]
    rows += [(300, None, None, None), (301, "", "en", ""), (302, "   \t\n ", "en", "a"), (303, "one", "en", "a"), (304, "One", "en", "a"), (305, "12 34 !!", "fr", "a"), (None, "no id at all", "en", "b"), (306, "ab " * 3000, "en", "c"), (307, "x" * 20_000, "fr", "c"), (308, "x" * 20_000 + "y", "fr", "c")]
    rows += [rows[1], rows[1]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_pairs(sets, percent=80):
    """Pairs of indexes with that share of common elements, by an inverted index."""
    posts = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            posts[t].append(i)
    seen = {(a, b) for p in posts.values() for k, a in enumerate(p) for b in p[k + 1 :]}
    return [(a, b) for a, b in seen if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def word_set(text, size=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()


def repeated_bytes(rows, length=400):
    data = [(t or "").encode() for t in rows]
    count = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
