"""Phrase mining against plain counting in Python."""

import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, n int, part string, phrase string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", "y", "z", "s") for i, (g, t) in enumerate(rows)], SCHEMA)


def plain(rows, least, longest, top, inside=50):
    """Rows of the result, by Python's own integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, words = {}, Counter()
    for lang, text in rows:
        f = count.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                f.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        found = []
        frequent = [p for p in f if len(p) > 1 and f[p] >= least]
        longer = {}
        for p in frequent:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer.get(p[i : i + m], 0), f[p])
        for p in frequent:
            if 100 * longer.get(p, 0) >= inside * f[p] and p in longer:
                continue
            score, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(rng, many):
    common = ["the", "of", "New", "York", "city", "é", "日本", "a'b", "x1"]
    out = []
    for i in range(many):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 3, 40, 200]))]
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", " ; \x0b "]) for w in words)))
    return out + [("en", None), ("en", ""), ("de", " .\n,"), ("en", "new york city hall " * 30)] + [("en", "A copy of the text that many have.")] * 300


@pytest.mark.parametrize("longest,how", [(3, {}), (3, {"bits": 6, "parts": 3}), (4, {"block_bytes": 97, "hold": 50}), (2, {"block_bytes": 1})])
def test_collocations(spark, rng, longest, how):
    rows = texts(rng, 250)
    got = phrases.collocations(frame(spark, rows).repartition(6), longest=longest, top=60, **how).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain(rows, 10, longest, 60)


def test_odd_tables(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("en", "one two three")])).count() == 0
    long = "ab " * 400_000
    (row,) = phrases.collocations(frame(spark, [("en", long)]), longest=2, block_bytes=50_000).collect()
    assert (row.phrase, row.a, row.l, row.n) == ("ab ab", 399_999, 400_000, 400_000)


def test_counts_beyond_four_bytes():
    e = np.zeros(3, phrases.ENTRY)
    e["print"], e["check"], e["n"], e["key"] = 7, 9, 0xF0000000, [3, 1, 2]
    out = phrases._merged(e)
    assert out["n"].astype(object).sum() == 3 * 0xF0000000 and set(out["key"]) == {1}


def test_fingerprints_depend_on_the_bytes_alone(rng):
    prints = phrases.Prints(3)
    raw = np.frombuffer(b"One two. one  two\tthree one two three", np.uint8)
    seen = {}
    for n, text, _place, start, stop, fp, check in prints.ngrams(raw, len(raw)):
        for s, e, f, c in zip(start, stop, fp, check, strict=True):
            assert seen.setdefault(text[s:e].tobytes(), (n, f, c)) == (n, f, c)
    assert len({v[1:] for v in seen.values()}) == len(seen) and {b"one two", b"one two three", b"two three one"} <= set(seen)
