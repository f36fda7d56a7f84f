"""Parsing and differencing against versions in plain integers, sign by sign and list by list."""

from __future__ import annotations

import random

import numpy as np
import pytest

from millwatch.llm.fingerprints import SLOTS, parse_level, sketch
from millwatch.llm.shards import difference

FULL = (1 << 64) - 1
SALT = 0x632BE59BD9B4E019


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def lowest(x: int) -> int:
    return (x & -x).bit_length() - 1


def plain_level(signs: list[int], level: int) -> list[int]:
    powers: list[list[int]] = []
    for s in signs:
        if powers and powers[-1][0] == s:
            powers[-1][1] += 1
        else:
            powers.append([s, 1])
    x = [s if n == 1 else mixed((s * 3 + n * SALT) & FULL) for s, n in powers]
    bits = [0] + [lowest(a ^ b) for a, b in zip(x[1:], x)]
    label = [2 * b + (s >> b & 1) for b, s in zip(bits, x)]
    for _ in range(3):
        before = [label[0] ^ 1] + label[:-1]
        label = [2 * lowest(a ^ b) + (a >> lowest(a ^ b) & 1) for a, b in zip(label, before)]
    cuts = [0] + [i for i in range(1, len(x) - 1) if label[i - 1] < label[i] > label[i + 1]]
    names = []
    for a, b in zip(cuts, cuts[1:] + [len(x)]):
        total = level * SALT + (b - a)
        for j, s in enumerate(x[a:b], 1):
            place = j * SALT & FULL
            part = (s + place) * (place | 1) & FULL
            part ^= part >> 29
            total += part * 0xBF58476D1CE4E5B9
        names.append(mixed(total & FULL))
    return names


def plain_sketch(text: str) -> list[int]:
    least, x, level = [0xFFFF] * SLOTS, [ord(c) for c in text], 0
    while x:
        level += 1
        x = plain_level(x, level)
        if level >= 2 or len(x) == 1:
            for name in x:
                least[name % SLOTS] = min(least[name % SLOTS], (name >> 40) % 0xFFFF)
        if len(x) == 1:
            break
    return least


@pytest.mark.parametrize("signs", ["ab", "abcdefgh ", "aé世😀 \n"])
def test_parsing_equals_plain_parsing(signs):
    rng = random.Random(len(signs))
    for length in [1, 2, 3, 5, 17, 100, 700]:
        text = "".join(rng.choice(signs) for _ in range(length))
        x, plain = np.array([ord(c) for c in text], np.int32), [ord(c) for c in text]
        for level in (1, 2, 3):
            x, plain = parse_level(x, level)[0], plain_level(plain, level)
            assert x.tolist() == plain
        assert sketch(text).tolist() == plain_sketch(text)
    assert sketch("a" * 1000).tolist() == plain_sketch("a" * 1000) and sketch("").tolist() == plain_sketch("")


def plain_difference(rows: list[list[int]]) -> list[list[list[tuple[int, int]]]]:
    """Partial partitions as lists of (sum, members), the two with the largest spread combined until one is left."""
    partial = []
    for i, row in enumerate(rows):
        order = sorted(range(len(row)), key=lambda c: row[c])
        partial.append((i, [(row[c], [(i, c)]) for c in order]))
    fresh = len(rows)
    while len(partial) > 1:
        partial.sort(key=lambda p: (-(p[1][-1][0] - p[1][0][0]), p[0]))
        (_, one), (_, two) = partial[0], partial[1]
        joined = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(one, reversed(two))]
        joined.sort(key=lambda part: part[0])
        partial = [*partial[2:], (fresh, joined)]
        fresh += 1
    return partial[0][1]


@pytest.mark.parametrize("parts", [2, 3, 16])
def test_differencing_equals_plain_differencing(parts):
    rng = random.Random(parts)
    for count in (1, 2, 7, 120):
        rows = [[0] * (parts - 1) + [rng.choice([1, 5, 5, rng.randint(1, 10_000)])] for _ in range(count)]
        rows += [[rng.randint(0, 50) for _ in range(parts)] for _ in range(count // 3)]
        sums, went = difference(np.array(rows, np.int64))
        plain = plain_difference(rows)
        assert sums.tolist() == [total for total, _ in plain]
        found = {(i, c): part for part, (_, members) in enumerate(plain) for i, c in members}
        assert {(i, c): int(went[i, c]) for i in range(len(rows)) for c in range(parts)} == found
