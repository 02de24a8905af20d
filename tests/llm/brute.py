"""Plain versions of operators, by their definitions."""

import hashlib
import re
from collections import defaultdict

from tests.llm.test_simhash import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def chunks(lines):
    """(first line, line after the last) of every content-defined chunk."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    out, begin = [], 0
    for k, line in enumerate(lines):
        if (number(line) + (31 * number(lines[k - 1]) if k else 0)) % 3 == 0 or k == len(lines) - 1:
            out.append((begin, k + 1))
            begin = k + 1
    return out


def passages(lines, words=50):
    """The shortest runs of over ``words`` words from each line that has words on, and up to it."""
    sizes, out = [len(SPACE.findall(x)) for x in lines], set()
    for k in (k for k, n in enumerate(sizes) if n):
        ends = [j for j in range(k + 1, len(lines) + 1) if sum(sizes[k:j]) > words]
        out |= {(k, ends[0])} if ends else set()
        begins = [i for i in range(k + 1) if sizes[i] and sum(sizes[i : k + 1]) > words]
        out |= {(begins[-1], k + 1)} if begins else set()
    return out


def lines_gone(texts, words=50):
    """For each key of ``texts``, in ascending order, the numbers of the lines that repeat what stands before."""
    places = defaultdict(list)
    lines = {i: t.split("\n") for i, t in texts.items() if t is not None}
    for i in sorted(lines):
        for a, b in {s for s in chunks(lines[i]) if s[1] - s[0] > 1} | passages(lines[i], words):
            places["\n".join(lines[i][a:b])].append((i, a, b))
    gone = {i: set() for i in texts}
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b))
    return gone


def brute_lines(texts, words=50):
    gone = lines_gone(texts, words)
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def similar_groups(texts):
    """key -> smallest key over pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    return components(sets, lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
