"""Awkward documents, and the contract's functions written plainly."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block long, row long, words string, id int, class_id string, label int, _0 string, n int, hashes long"
RNG = random.Random(5)
LEXICON = ["".join(RNG.choices("abcdefghilmnoprstué", k=RNG.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(LEXICON) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def awkward():
    """Rows with nulls, empties, ties, repeats, odd characters, a very long text and near copies."""
    base, passage = prose(300, 1), prose(60, 2)
    words = base.split(" ")
    near = " ".join(words[:150] + ["changed"] + words[151:])
    texts = [
        (1, base), (2, base), (3, near), (3, near), (4, prose(80, 3) + " " + passage + " " + prose(90, 4)), (5, passage + "\n" + prose(120, 5)),
        (6, None), (7, ""), (8, " \t\n\x0b\x0c\r "), (9, "one"), (10, "a b c d e f g h i j k l m"), (11, "a b c d e f g h i j k l m"),
        (12, "repeat me now " * 200), (13, "\x00 zero ▁ mark 中文 😀 é é 　 <s></s> <|endoftext|> <0x41>"), (14, "12 34 !? ## $$"),
        (15, prose(20000, 6)), (None, base), (None, None), (16, "line\nline\nline\nother line here\n\n"), (5, prose(40, 7)), (-3, passage), (17, "x" * 3000), (18, "x" * 1000 + "y"),
        (19, "  two  spaces   here \n  and\tthere "),
    ]
    return [(i, t, "xx", "s", 0, 7, 7, "w", 3, "c", 1, "z", 2, 9) for i, t in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, COLUMNS)


def words_of(text):
    return WORD.findall(text or "")


def without_repeats(rows, size=13):
    """(n_words, kept words) for (doc_id, text) rows: windows that start in a smaller document go."""
    least = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def without_repeated_bytes(rows, size):
    seen = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] = seen.get(b[k : k + size], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingles(text, size=5):
    w = words_of(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def classes(rows, similarity=0.8):
    """Class id by brute force for (doc_id, text) rows without null ids."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            both = len(sets[a] & sets[b])
            if same or (both and both >= similarity * len(sets[a] | sets[b])):
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return [(i, least[top(k)]) for k, (i, _) in enumerate(rows)]
