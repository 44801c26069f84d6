import math
from collections import Counter

import pytest

from veilspark.llm import backoff
from veilspark.llm.queries import bpe
from veilspark.llm.secrets import tokenizer

VOCAB, PATTERN = bpe()


def brute(texts, order, weight):
    enc = tokenizer(VOCAB, PATTERN)
    ids = [enc.encode_ordinary(t or "") for t in texts]
    count = lambda xs: Counter(tuple(x[i : i + n]) for x in xs for n in range(1, order + 1) for i in range(len(x) - n + 1))
    whole = count(ids)
    total = sum(map(len, ids))
    out = []
    for x in ids:
        own, rest, score, steps = count([x]), max(total - len(x), 1), 0.0, 0
        f = lambda g: whole[g] - own[g]  # noqa: B023, E731
        for i in range(len(x)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(x[i - n + 1 : i + 1])
                if f(g) > 0:
                    score += math.log(f(g) / (f(g[:-1]) if n > 1 else rest))
                    break
                steps += 1
                score += math.log(weight)
            else:
                score -= math.log(rest)
        out.append((len(x), steps, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(docs_frame, rng, order):
    words = "the of thand erened hein tion moren ünd que 你好 42".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["", None, "unseen zebra\nline", "a" * 30000, "the of", "the of"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in backoff.stupid_backoff(docs_frame(rows), VOCAB, PATTERN, order=order, block_tokens=60).collect()}
    assert len(got) == len(rows)
    for (i, _), (n, steps, score) in zip(rows, brute(texts, order, 0.4), strict=True):
        assert (got[i].n_tokens, got[i].n_backoff) == (n, steps), i
        assert got[i].log_score == pytest.approx(score, abs=1e-6), i
        assert (got[i].mean_log_score is None) == (n == 0)


def test_empty_table_and_null_id(docs_frame):
    assert backoff.stupid_backoff(docs_frame([]), VOCAB, PATTERN).count() == 0
    assert backoff.stupid_backoff(docs_frame([(None, "a b")]), VOCAB, PATTERN).first().doc_id is None


def test_trigrams_are_the_default(docs_frame):
    rows = list(enumerate(["the of thand", "the of erened", "in the of thand", "not of thand"]))
    for (i, _), (n, steps, score) in zip(rows, brute([t for _, t in rows], 3, 0.4), strict=True):
        r = backoff.stupid_backoff(docs_frame(rows), VOCAB, PATTERN).where(f"doc_id = {i}").first()
        assert (r.n_tokens, r.n_backoff) == (n, steps) and r.log_score == pytest.approx(score, abs=1e-6)
