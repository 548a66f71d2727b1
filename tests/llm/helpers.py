"""Small fixtures and brute-force versions."""

import re
import string

SPACE = "[\x20\x09-\x0d]"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """rows: (doc_id, text). ``extra`` columns are null."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) + (None,) * bool(extra) for i, t in rows], DOCS + (f", {extra}" if extra else ""))


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def components(sets, percent=75):
    ids, parent = list(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def shingles(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def deduped_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: re.sub(f"^{SPACE}+|{SPACE}+$", "", line).translate(LOWER)
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(-1 if i is None else i)
    gone = lambda i, k: len(k) >= min_chars and len(held[k]) >= min_docs and max(held[k]) != (-1 if i is None else i)
    return [(i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, key(x)))) for i, t in rows]
