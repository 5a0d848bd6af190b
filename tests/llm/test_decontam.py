"""Leaks against an alignment of every part of an item with the whole text."""

from __future__ import annotations

import random
import string
import time

import numpy as np

from visitlens.llm import decontam

LIMITS = {"error": 0.06, "least_chars": 60, "share": 0.6}


def leaks(item: str, text: str) -> bool:
    """Whether some part of ``item`` that is long enough stands in ``text`` with few enough edits; full tables, no filter."""
    n = len(item)
    need, edits = min(n, max(60, int(0.6 * n))), int(0.06 * n)
    t, steps = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    for start in range(n - need + 1):
        row = np.zeros(len(text) + 1, int)
        for i in range(start, n):
            best = row + 1
            best[1:] = np.minimum(best[1:], row[:-1] + (t != ord(item[i])))
            row = np.minimum.accumulate(best - steps) + steps
            size = i + 1 - start
            if size >= need and row.min() <= -(-edits * size // n):
                return True
    return False


def found(item: str, text: str, **more) -> bool:
    q = decontam.gram_length(len(item), q=12, **LIMITS)
    table = decontam._fold_table()
    return bool(decontam.find_leaks([decontam.fold(text, table)], decontam.build_index([(1, item)], q=q, **LIMITS), q, **more))


def edited(rng: random.Random, text: str, times: int) -> str:
    out = list(text)
    for _ in range(times):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(([], ["0"], ["1", out[at]]))
    return "".join(out)


def test_every_leak_and_no_other():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    seen = set()
    for k in range(90):
        item = word(rng.choice((61, 70, 90, 130, 240)))
        need = min(len(item), max(60, int(0.6 * len(item))))
        size = min(len(item), need + rng.randrange(12))
        at = rng.randrange(len(item) - size + 1)
        edits = -(-int(0.06 * len(item)) * size // len(item)) + (k % 3 == 0) * rng.randrange(4)
        text = word(20) + edited(rng, item[at : at + size], edits) + word(20)
        want = leaks(item, text)
        assert found(item, text) == want, (item, text)
        seen.add(want)
    assert seen == {True, False}


def test_edits_at_the_ends():
    """Substitutions near both ends of a region of just the needed size."""
    rng = random.Random(8)
    for _ in range(300):
        item = "".join(rng.choices(string.ascii_lowercase, k=200))
        need, edits = 120, -(-12 * 120 // 200)
        text = list(item[30 : 30 + need])
        for at in rng.sample([*range(12), *range(need - 12, need), *range(40, 80)], edits):
            text[at] = "0"
        assert found(item, "".join(text))


def test_short_items_are_words():
    bench = decontam.Benchmark([(1, "Ab, c!"), (2, "x"), (None, "ab"), (4, "?"), (5, "a")], q=12, **LIMITS)
    got = [sorted(str(x["item_id"]) for x in one) for one in bench.leaks(["the AB c", "cab c x", None, "ab ab", "xx"])]
    assert got == [["1", "None"], ["2"], [], ["None"], []]


def test_runs_of_one_letter_take_bounded_memory():
    """The same answers however few pairs may be held at once."""
    rng = random.Random(9)
    texts = ["a" * 4000, "ab" * 900 + "a" * 70, "".join(rng.choices("ab", k=800)), "c" * 300]
    items = [(1, "a" * 2000), (2, "a" * 100), (3, "ab" * 60), (4, texts[2][100:260]), (5, texts[2][300:500].replace("aaa", "aba"))]
    for k in {decontam.gram_length(len(t), q=12, **LIMITS) for _, t in items}:
        index = decontam.build_index([x for x in items if decontam.gram_length(len(x[1]), q=12, **LIMITS) == k], q=k, **LIMITS)
        folded = [decontam.fold(t, decontam._fold_table()) for t in texts]
        by = [{x[:2] for x in decontam.find_leaks(folded, index, k, most)} for most in (1 << 26, 1 << 16, 300)]
        assert by[0] == by[1] == by[2]
    assert found(items[0][1], texts[0], most_pairs=1 << 12)


def test_characters_beyond_the_first_plane(spark):
    """Signs part words and don't count, whatever their code point; letters there are lower-cased."""
    table = decontam._fold_table()
    text = lambda t: decontam.fold(t, table).astype("<u4").tobytes().decode("utf-32-le")
    assert text("the fox\U0001f98aran") == "the fox ran" == text("\U0001f98a The  FOX - ran!")
    assert text("\U00010400x") == "\U00010428x"
    item = "a passage of words that is long enough to leak when one of its spaces has become something else entirely in between two of them"
    held = decontam.Benchmark([(1, item)], q=12, error=0.06, least_chars=60, share=0.6)
    assert [len(x) for x in held.leaks([item.replace(" words ", "\U0001f98awords\U0001f98a"), item.upper().replace(" ", " \U0001f98a ")])] == [1, 1]


def test_long_items(spark):
    """An item of 8,000 characters with five edits in a hundred is found in seconds."""
    draw = random.Random(5)
    item = "".join(draw.choice("abcdefghijklmnop ") for _ in range(8000))
    text = "".join(draw.choice("qrstuv") if c != " " and draw.random() < 0.05 else c for c in item)
    held = decontam.Benchmark([(1, item)], q=12, error=0.06, least_chars=60, share=0.6)
    began = time.process_time()
    assert len(held.leaks(["x y z " * 50 + text + " w" * 50])[0]) == 1
    assert time.process_time() - began < 20
