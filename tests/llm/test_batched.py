"""Steps that run on whole batches take no Python call for each word or piece."""

import cProfile
import pstats
import random
import re

import numpy as np
import pyarrow as pa

from veilspark.llm import backoff, minhash, sentpiece
from veilspark.llm.queries import model_file


def calls(f) -> int:
    p = cProfile.Profile()
    p.runcall(f)
    return pstats.Stats(p).total_calls


def test_words_are_packed_together():
    v = sentpiece.Viterbi(sentpiece.load_pieces(model_file()))
    rng = random.Random(8)
    words = [" " + "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(5_000)]
    assert calls(lambda: v.words(words)) < 4 * len(words)
    # Together or alone, also with characters that no piece covers.
    odd = [" " + "".join(rng.choice("etaué你😀▁") for _ in range(6)) for _ in range(300)]
    assert v.words(odd) == [v.words([w])[0] for w in odd]


def test_pieces_are_decoded_together():
    v = sentpiece.Viterbi(sentpiece.load_pieces(model_file()))
    texts = ["the very same words " * 50, "你好 wörld ▁x\n\t😀", "", "  two  spaces "]
    coded = [np.frombuffer(b"".join(v.words(re.findall(sentpiece.WORD, " " + t) if t else [])), np.int32).tolist() for t in texts]
    lists = pa.array([[7, 8], *coded, None] * 40, pa.list_(pa.int32()))
    part = lists.slice(1, 100)
    assert v.decode_all(part) == ([*texts, None, v.decode([7, 8])] * 40)[:100]
    assert calls(lambda: v.decode_all(part)) < 20 * len(part)


def test_later_star_rounds_propose_no_more_than_the_first(docs_frame, rng, monkeypatch):
    """A third of a family is linked with its first text, the rest with none: later rounds stay linear in the rows of the buckets."""
    passage = [f"p{i}" for i in range(140)]
    tails = [[f"t{i}_{j}" for j in range(30)] for i in range(300)]
    for i in range(1, 100):
        tails[i] = tails[0][:24] + tails[i][24:]
    made = {"stars": []}

    def cut(df):
        out = real(df)
        if "turned" in df.columns:
            made["stars"].append(out.count())
        return out

    real = minhash.cut
    monkeypatch.setattr(minhash, "cut", cut)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_frame([(i, " ".join(passage + t)) for i, t in enumerate(tails)]), k=4).collect()}
    assert got == {i: 0 if i < 100 else i for i in range(300)}
    assert len(made["stars"]) > 1 and max(made["stars"]) <= 2 * made["stars"][0]


def test_answers_are_smaller_than_the_lists_they_answer():
    keys = np.unique(np.random.default_rng(2).integers(1 << 40, 1 << 59, 20_000))
    asked = pa.table([pa.array(c, f.type) for c, f in zip([[3, 3], [0, 1], [backoff.pack(keys), backoff.pack(keys[::2])], [backoff.pack(np.ones(n, np.int64)) for n in (20_000, 10_000)]], backoff.GRAMS, strict=True)], schema=backoff.GRAMS)
    got = backoff.elsewhere(asked).to_pylist()
    assert [backoff.unpack(r["grams"]).tolist() for r in got] == [list(range(0, 20_000, 2)), list(range(10_000))]
    assert all(backoff.unpack(r["times"]).tolist() == [1] * 10_000 for r in got)
    assert all(len(r["grams"]) * 20 < len(backoff.pack(keys)) for r in got)
