"""One seed at a time: the definition of a context, for comparison."""

import hashlib
import math


def h60(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


PRIME, MULTIPLIERS, ROUNDS = 2**31 - 1, (1_103_515_245, 742_938_285), 8


def mix(x, s):
    y = (x + s) % PRIME
    z = (y * y + y * MULTIPLIERS[0]) % PRIME
    return (z * z + z * MULTIPLIERS[1] + s) % PRIME


def choose(n, k, many, h):
    """k of the places 0..n-1 with their keys: the smallest of ``many``."""
    if not n:
        return
    s = [(mix(j + 1, h % PRIME) + h // PRIME) % PRIME for j in range(ROUNDS + 4)]
    unit = lambda i, a, b: (mix(i, s[a]) * PRIME + mix(i, s[b])) / PRIME**2
    a = max(min(2, n), math.isqrt(n))
    b = -(-n // a)
    cut = 1.0
    if many > k:
        cut = -math.expm1(-sum(-math.log1p(-unit(i, ROUNDS + 2, ROUNDS + 3)) / (many - i) for i in range(k + 1)))
    for i in range(k):
        x = i
        while True:
            left, right = x % a, x // a
            for turn in range(ROUNDS):
                if turn % 2 == 0:
                    left = (left + mix(right, s[turn])) % a
                else:
                    right = (right + mix(left, s[turn])) % b
            x = right * a + left
            if x < n:
                break
        yield x, -math.log1p(-unit(i, ROUNDS, ROUNDS + 1) * cut)


def context(seed, seed_ts, seed_class, parents, children, cells, width, seq_len, run_seed=0, epoch=0):
    """Rows of a context in order. ``parents[n]``: [(fk_pos, parent)]; ``children[n]``:
    {class: [(place, child, ts)]} in time order."""
    waiting, seen, out = {}, set(), []
    shown = 0

    def visit(node, depth):
        nonlocal shown
        if node in seen or shown >= seq_len:
            return
        seen.add(node)
        out.append((node, depth))
        shown += cells[node]
        for kind in sorted({0, seed_class}):
            visible = [
                (place, child)
                for place, child, ts in children.get(node, {}).get(kind, [])
                if ts is None or seed_ts is None or ts <= seed_ts
            ]
            limit = width if kind == 0 else len(visible)
            k = min(limit, len(visible))
            for o, key in choose(len(visible), k, k if kind == 0 else len(visible), h60(run_seed, epoch, "d", seed, node, kind)):
                place, child = visible[o]
                waiting.setdefault(depth + 1, []).append((key, place, child))
        for _, parent in sorted(parents.get(node, []), reverse=True):
            visit(parent, depth + 1)

    visit(seed, 0)
    while shown < seq_len and any(waiting.values()):
        depth = min(d for d, entries in waiting.items() if entries)
        entry = min(waiting[depth])
        waiting[depth].remove(entry)
        visit(entry[2], depth)
    return out
