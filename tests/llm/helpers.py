"""A small table with every awkward row, and brute-force versions of the contracts."""

import random
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, label double, h int, n int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}{'aeiou'[rnd.randrange(5)]}" for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "one", "two words", base, base, base, " ".join(near), prose(2, 200), prose(3, 5000), "x" * 30000, "#*$%& | <>\nline\nline\nline",
        "mail Ann.b@c-d.org or +1 (663) 555-6869, 10.0.0.255 and 4111 1111 1111 1111", "ÄÖÜ ß Straße ÉÈ ΣΑΣ", "<|endoftext|> inside <|startoftext|>", base.upper(),
    ]
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "b", "a", "é"][i % 4], 1, 2, "s", 0.5, 3, 4) for i, t in enumerate(texts)]
    rows.append((6, base, "en", "b", 1, 2, "s", 0.5, 3, 4))  # the same row again
    rows.append((100, prose(2, 200), "en", "b", 1, 2, "s", 0.5, 3, 4))
    rows.append((100, base, "en", "b", 1, 2, "s", 0.5, 3, 4))  # one id, another text
    rows.append((None, base, None, None, None, None, None, None, None, None))
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None) -> frozenset:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def smallest_reachable(nodes, linked) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def base_counts(text: str | None) -> tuple:
    t = text or ""
    w, seen, dup = WORDS.findall(t), set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] >= 2:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def personal(text: str | None) -> list[tuple]:
    only = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in reversed(only(s))]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]
