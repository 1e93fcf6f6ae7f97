"""Plain re-statements of the operators, on rows in memory."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    words = WORD.findall(lowered(text or ""))
    if not words:
        return frozenset()
    m = min(n, len(words))
    return frozenset(tuple(words[i : i + m]) for i in range(len(words) - m + 1))


def joined_components(rows, n, num, den):
    """{id: (shingles, smallest reachable id)} for (id, text) rows with distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {}
    for ids in by_shingle.values():
        for a in ids:
            for b in ids:
                if a < b:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), common in pairs.items():
        if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def lines_removed(rows, least):
    """{id: kept text}: a line goes if a run of lines with it, of ``least`` words or more, was there before."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    order = sorted(lines)
    norm = {i: [lowered(x) for x in v] for i, v in lines.items()}
    count = {i: [len(WORD.findall(x)) for x in v] for i, v in lines.items()}
    kept = {}
    for b in order:
        gone = set()
        for p in range(len(norm[b])):
            for q in range(p + 1, len(norm[b]) + 1):
                if sum(count[b][p:q]) < least:
                    continue
                run = norm[b][p:q]
                if any(
                    norm[a][s : s + q - p] == run
                    for a in order if a <= b
                    for s in range(len(norm[a]) - (q - p) + 1)
                    if a < b or s + (q - p) <= p
                ):
                    gone.update(range(p, q))
                # a longer run from p must hold this one; the shortest repeats decide
                elif q - p > 1:
                    break
        kept[b] = "\n".join(x for k, x in enumerate(lines[b]) if k not in gone)
    return kept
