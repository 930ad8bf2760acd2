"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

from sessionlake.llm import secret_scan


def split(text):
    """Bytes of words, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(text, n):
    words = split(text)
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(n))))


def jaccard_classes(docs, n, num, den):
    """id: (size of the set, component, number of different sets linked with)."""
    sets = {id: shingles(text, n) for id, text in docs.items()}
    distinct = sorted({s for s in sets.values() if s}, key=sorted)
    lead, degree = list(range(len(distinct))), Counter()

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            if den * len(a & distinct[j]) >= num * len(a | distinct[j]):
                degree[i] += 1
                degree[j] += 1
                lead[root(i)] = root(j)
    place = {s: i for i, s in enumerate(distinct)}
    smallest = defaultdict(lambda: 10**18)
    for id, s in sets.items():
        if s:
            smallest[root(place[s])] = min(smallest[root(place[s])], id)
    return {
        id: (len(s), smallest[root(place[s])] if s else id, degree[place[s]] if s else 0) for id, s in sets.items()
    }


def quality_stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def secrets(text):
    """(kind, start, end) by start, then kind as listed."""
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(secret_scan.RULES.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_stretch(words, item):
    """Over all diagonals: equal words less different ones."""
    best = 0
    for shift in range(-len(item) + 1, len(words)):
        run = 0
        for j, word in enumerate(item):
            if 0 <= shift + j < len(words):
                run = max(0, run + (1 if words[shift + j] == word else -1))
                best = max(best, run)
    return best
