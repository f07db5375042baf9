"""Language profiles recomputed text by text and letter by letter."""

import random
import zlib

import numpy as np

from strataq.llm import language_id

WIDTH = 1024


def bound(left, middle, right):
    """A trigram's vector: letters' random signs, each rolled by its place; no letter is number 0."""
    signs = [np.random.default_rng([7, p]).integers(0, 2, WIDTH, np.int8).astype(int) * 2 - 1 for p in (left, middle, right)]
    return signs[0] * np.roll(signs[1], 1) * np.roll(signs[2], 2)


def bundle(text):
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""]
    out = np.zeros(WIDTH)
    for k, p in enumerate(low):
        if p:
            out += bound(low[k - 1] if k else 0, p, low[k + 1] if k + 1 < len(low) else 0)
    return out


def test_cosines_equal_brute_force(spark):
    r = random.Random(12)
    kinds = {"aa": "abcdeé", "bb": "xyzwuß", "cc": "ABzñ一\U00010400"}
    text = lambda letters: "".join(r.choice(letters + "  1-") for _ in range(r.randint(1, 60)))
    rows = [(k, text(kinds[lang]), lang) for k, lang in enumerate(r.choice(sorted(kinds)) for _ in range(60))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 ..", "cc"), (103, "abc", None), (104, text("abxy"), None), (None, "abc abc", "aa"), (7, rows[7][1], rows[7][2])]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    protos = {}
    for i, t, lang in rows:
        if i is not None and not held(i) and t is not None and lang is not None:
            protos[lang] = protos.get(lang, 0) + bundle(t)
    names = sorted(protos)
    table = np.stack([protos[n] for n in names])
    table -= 0.5 * table.mean(axis=0)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    want = []
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, held(i), "und", 0.0))
            continue
        v = bundle(t)
        cosine = table @ v / np.linalg.norm(v)
        want.append((i, held(i), names[int(cosine.argmax())], float(np.clip(cosine.max(), 0, 1))))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    key = lambda x: (str(x[0]), x[1], x[2], round(x[3], 3))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4
