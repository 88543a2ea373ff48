"""Small sequence databases with known answers, and a brute-force miner."""

import random

# Profits, sequences and answers of the two running examples.
EXAMPLE = (
    "1:2\n2:2\n3:4\n4:5\n5:4",
    ["1[1] -1 2[12] -2", "1[1] -1 4[1] 5[1] -2", "1[1] 3[40] -1 2[12] -2", "1[1] -1 2[12] -2", "1[1] -1 4[1] 5[1] -2", "1[1] -1 2[12] -2", "1[1] -1 4[10] 5[10] -2", "1[1] -1 2[12] -1 4[10] 5[10] -2", "1[1] -1 4[2] -1 4[10] 5[10] -2"],
)
EXAMPLE_ANSWER = {"<(1)(4 5)>": (298, 3), "<(4 5)>": (288, 3), "<(1)(4)>": (170, 3), "<(4)>": (160, 3), "<(1)(5)>": (138, 3), "<(1)(2)>": (130, 2), "<(5)>": (128, 3), "<(2)>": (120, 2)}
EXAMPLE_SEEDS = {"<(1)(2)>": 104, "<(2)>": 96, "<(3)>": 160, "<(1 3)>": 162, "<(3)(2)>": 184, "<(1 3)(2)>": 186}
EXAMPLE_FIXED = {"<(1)(4 5)>", "<(4 5)>", "<(1)(4)>", "<(1)(5)>", "<(1)(2)>", "<(2)>"}
EXAMPLE_EUCS = {"i": {(1, 3): 186, (4, 5): 332}, "s": {(1, 2): 380, (1, 4): 332, (1, 5): 332, (2, 4): 116, (2, 5): 116, (3, 2): 186, (4, 4): 102, (4, 5): 102}}
EXAMPLE2 = (
    "1:3\n2:2\n3:4\n4:1",
    ["1[2] -1 2[2] -2", "1[1] -1 2[3] -1 3[1] -2", "1[2] 2[1] -2", "1[1] -1 2[2] -2", "3[2] -1 1[1] -1 2[2] -2", "1[2] -1 2[2] -1 4[3] -2", "1[1] -1 2[3] -2", "1[2] 2[2] -2", "1[1] -1 2[1] -1 3[2] -2", "1[2] -1 2[2] -2", "1[1] 2[2] -1 4[1] -2", "1[2] -1 2[3] -2"],
)
EXAMPLE2_ANSWER = {"<(1)(2)>": (79, 2), "<(1)>": (54, 1), "<(2)>": (50, 1), "<(1)(2)(3)>": (26, 7), "<(1 2)>": (25, 5), "<(2)(3)>": (20, 7), "<(3)>": (20, 4), "<(1)(3)>": (18, 7), "<(1)(2)(4)>": (13, 7), "<(1)(4)>": (13, 6)}


def random_rows(seed: int, sequences: int = 14, items: int = 5, events: int = 5) -> list[tuple[int, int, int, int]]:
    """(sid, ev, item, util) of random sequences."""
    rng, out = random.Random(seed), []
    for sid in range(sequences):
        for ev in range(rng.randint(1, events)):
            out += [(sid, ev, item, rng.randint(1, 20)) for item in rng.sample(range(1, items + 1), rng.randint(1, 3))]
    return out


def brute_patterns(rows: list[tuple[int, int, int, int]], max_len: int) -> dict[str, dict[int, int]]:
    """pattern -> sid -> best utility, by enumeration of every embedding."""
    seqs: dict[int, list[tuple[int, int, int]]] = {}
    for sid, ev, item, util in sorted(rows):
        seqs.setdefault(sid, []).append((ev, item, util))
    out: dict[str, dict[int, int]] = {}
    for sid, own in seqs.items():
        stack = [((), None, -1, 0)]
        while stack:
            pattern, ev, at, total = stack.pop()
            for k in range(at + 1, len(own)):
                e, item, util = own[k]
                new = (*pattern[:-1], (*pattern[-1], item)) if pattern and e == ev else (*pattern, (item,))
                if pattern and e == ev and item <= pattern[-1][-1]:
                    continue
                key = "<" + "".join("(" + " ".join(map(str, x)) + ")" for x in new) + ">"
                best = out.setdefault(key, {})
                best[sid] = max(best.get(sid, 0), total + util)
                if sum(map(len, new)) < max_len:
                    stack.append((new, e, k, total + util))
    return out


def brute_answer(rows, min_util: int, bound: int | None, n: int, max_len: int) -> dict[str, tuple[int, int]]:
    out = {}
    for pattern, by_sid in brute_patterns(rows, max_len).items():
        s = sorted(by_sid)
        period = max(s[0] + 1, n - s[-1], *(b - a for a, b in zip(s, s[1:], strict=False)), 0)
        total = sum(by_sid.values())
        if total >= min_util and (bound is None or period <= bound):
            out[pattern] = (total, period)
    return out
