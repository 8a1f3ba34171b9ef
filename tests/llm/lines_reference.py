"""Recurring lines by the plain definition: every line is compared with every template of its leaf, every document with every other."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of_copies(rows, similar):
    """Pairs of ids whose five-word shingles are that similar."""
    words = [(doc, WORD.findall((text or "").lower())) for doc, text in rows]
    sets = [(doc, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for doc, w in words if w]
    return [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) >= similar * len(x | y)]


def recurring(rows, min_docs=10, short_words=42, long_words=50, long_docs=2, similar=0.8, copies=0.7, told=None):
    """(n_lines, n_dropped, text) by id; rows are (id, text). ``told``: the groups of copies, (id: first); else they are made from all pairs."""
    lines = {}
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
            if tokens:
                lines[doc, pos, text] = tokens
    templates, place = defaultdict(list), {}
    for tokens in sorted(set(lines.values()), key=lambda t: " ".join(t).encode()):
        leaf = templates[len(tokens), tokens[:3]]
        same = [sum(a == b for a, b in zip(t, tokens, strict=True)) for t in leaf]
        best = max(range(len(leaf)), key=lambda i: (same[i], -i), default=None)
        if best is None or same[best] < similar * len(tokens):
            leaf.append(list(tokens))
            best = len(leaf) - 1
        leaf[best] = [a if a == b else "<*>" for a, b in zip(leaf[best], tokens, strict=True)]
        place[tokens] = (len(tokens), tokens[:3], best)
    group = {doc: doc for doc, _ in rows}
    if told is not None:
        group |= told
    for i, j in [] if told is not None else pairs_of_copies(rows, copies):
        if group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = {d: low if g == high else g for d, g in group.items()}
    groups = defaultdict(set)
    for (doc, _, _), tokens in lines.items():
        groups[place[tokens]].add(group[doc])
    gone = defaultdict(set)
    for (doc, pos, _), tokens in lines.items():
        g = groups[place[tokens]]
        down = -(-(long_words - len(tokens)) * (min_docs - long_docs) // (long_words - short_words))
        if len(g) >= min_docs or len(g) >= max(long_docs, long_docs + down) and group[doc] != min(g):
            gone[doc].add(pos)
    out = {}
    for doc, text in rows:
        split = [] if text is None else text.split("\n")
        mine = {p for p in gone[doc] if p < len(split)}
        out[doc] = (len(split), len(mine), None if text is None else "\n".join(x for i, x in enumerate(split) if i not in mine))
    return out
