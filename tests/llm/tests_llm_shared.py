"""Brute force that several tests use."""

import re


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_groups(rows):
    """(id, least id of its component) by all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if label[i] != label[j] and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for k, (d, _) in zip(label, rows, strict=True):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return [(d, least.get(k) if s else d) for k, (d, _), s in zip(label, rows, sets, strict=True)]
