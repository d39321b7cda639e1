"""The window network against plain loops, and its use on documents."""

import math

import numpy as np
import pytest

from larder.llm import lm_score as lm


def plain_log_probability(net, ids, pad):
    total = 0.0
    for i, target in enumerate(ids):
        h = net.bias.astype(float).copy()
        for k, o in enumerate([o for o in range(-lm.SIDE, lm.SIDE + 1) if o]):
            near = ids[i + o] if 0 <= i + o < len(ids) else pad
            h += net.embed[near].astype(float) * net.offset[k]
        h, group = np.tanh(h), target // lm.MEMBERS
        for logit, at in ((h @ net.groups + net.groups_bias, group), (h @ net.out[group] + net.out_bias[group], target % lm.MEMBERS)):
            total += logit[at] - math.log(np.exp(logit - logit.max()).sum()) - logit.max()
    return total


def test_score_equals_plain_loops():
    rng = np.random.default_rng(0)
    net = lm.Network.start(40)
    for n in (1, 2, 5, 60):
        ids = rng.integers(0, 40, n).astype(np.int32)
        assert net.log_probability(lm.contexts(ids, 40), ids).sum() == pytest.approx(plain_log_probability(net, ids, 40), abs=1e-3)


def test_step_follows_the_gradient():
    rng = np.random.default_rng(1)
    net = lm.Network.start(70)
    ids = rng.integers(0, 70, 90).astype(np.int32)
    context = lm.contexts(ids, 70)
    loss = lambda n: -n.log_probability(context, ids).mean()
    rate = 1e-3
    moved = net.unpack(net.pack())
    moved.learn(context, ids, rate)
    for name, scale in (("out", 1), ("out_bias", 1), ("groups", 1), ("groups_bias", 1), ("bias", 1), ("offset", 1), ("embed", 8)):
        step = (getattr(moved, name) - getattr(net, name)).ravel() / scale
        at = int(np.abs(step).argmax())
        up, down = net.unpack(net.pack()), net.unpack(net.pack())
        getattr(up, name).ravel()[at] += 0.01
        getattr(down, name).ravel()[at] -= 0.01
        assert step[at] == pytest.approx(-rate * (loss(up) - loss(down)) / 0.02, rel=0.05, abs=1e-7), name


def test_words_and_vocabulary():
    got = lm.words('The "quick", BROWN fox!\n ... É the').tolist()
    assert len(got) == 6 and got[0] == got[5] == lm.words("the")[0] and len(set(got)) == 5
    v = lm.Vocabulary(np.sort(np.concatenate([lm.words("the"), lm.words("of")])), classes=4)
    ids = v.ids("the of zebra the")
    assert ids[0] == ids[3] != ids[1] and {ids[0], ids[1]} == {0, 1} and 2 <= ids[2] < 6 and len(v) == 6


def test_counts_cover_all_documents(documents):
    docs = documents(["a b a", "b, c", None, "", "a"])
    hashed = {w: int(lm.words(w).view(np.int64)[0]) for w in "abc"}
    assert {r["word"]: r["n"] for r in lm.word_counts(docs).collect()} == {hashed["a"]: 3, hashed["b"]: 2, hashed["c"]: 1}
    names, frequency = lm.vocabulary(docs, known=2)
    assert sorted(names.known.view(np.int64).tolist()) == sorted([hashed["a"], hashed["b"]]) and frequency.sum() == pytest.approx(1)
    assert frequency[names.ids("a")[0]] == pytest.approx(4 / (6 + 2 + lm.CLASSES))


def test_training_learns_both_sides(documents):
    texts = ["left one right . " * 30, "up two down . " * 30] * 20
    docs = documents(texts)
    names, net = lm.train(docs, rounds=2)
    _, frequency = lm.vocabulary(docs)
    before = lm.Network.start(len(names), frequency)
    ids = names.ids(texts[0])
    assert net.log_probability(lm.contexts(ids, len(names)), ids).mean() > before.log_probability(lm.contexts(ids, len(names)), ids).mean() + 0.3


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_every_position_is_a_target_once(documents, monkeypatch, rounds):
    class Shared:
        def __init__(self, value):
            self.value = value

    import pandas as pd

    texts = ["a", "a b", "a b c", "a b c d e f g h i j k", None, ""]
    names = lm.Vocabulary(np.empty(0, np.uint64))
    seen = []
    monkeypatch.setattr(lm.Network, "learn", lambda self, context, target, rate=0: seen.extend(target.tolist()))
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 0})())
    for r in range(rounds):
        rows = [names.ids(t) for t in texts]
        frame = pd.DataFrame({"n_words": [len(x) for x in rows], "ids": [x.astype(lm.NUMBER).tobytes() for x in rows]})
        list(lm._train(Shared(lm.Network.start(len(names))), r, rounds)(iter([frame])))
    assert sorted(seen) == sorted(i for t in texts for i in names.ids(t).tolist())


@pytest.mark.parametrize("common", [1_000_000, 3])
def test_every_word_has_its_own_probability(documents, monkeypatch, common):
    monkeypatch.setattr(lm, "CLASSES", 2)
    texts = ["a b a b a b c", "c c d e f g h", "a b d d d i", "", None]
    docs = documents(texts)
    names, frequency = lm.vocabulary(docs, known=2, common=common)
    names = lm.replace(names, classes=2)
    net = lm.Network.start(len(names), frequency)
    asked = texts + ["a zebra c"]
    got = {r["doc_id"]: r["log_probability"] for r in lm.pseudo_likelihood(documents(asked), names, net).collect()}
    count = lm.pd.Series(" ".join(t for t in texts if t).split()).value_counts()
    kind = {w: int(names.ids(w)[0]) for w in [*count.index, "zebra"]}
    total = {k: sum(n for w, n in count.items() if kind[w] == k) for k in range(4)}
    share = {w: 1 if k < 2 else count.get(w, 1) / (total[k] + 1) for w, k in kind.items()}
    assert len({share[w] for w in "cde"}) > 1
    for d, text in enumerate(asked):
        want = plain_log_probability(net, names.ids(text), len(names)) + sum(math.log(share[w]) for w in (text or "").split())
        assert got[d] == pytest.approx(want, abs=1e-3)
    for k in (2, 3):  # the words of a class share its probability
        assert sum(share[w] for w in count.index if kind[w] == k) == pytest.approx(total[k] / (total[k] + 1))


def test_odd_documents(documents, no_documents):
    docs = documents([None, "", "...", "word", "the the the " * 2000, "word"], ids=[1, 2, 3, 2**60 + 1, None, 9])
    names, net = lm.train(docs)
    rows = {r["doc_id"]: r for r in lm.pseudo_likelihood(docs, names, net).collect()}
    assert len(rows) == 6 and rows[None]["n_words"] == 6000
    for d in (1, 2, 3):
        assert (rows[d]["n_words"], rows[d]["log_probability"], rows[d]["mean_log_probability"]) == (0, 0.0, None)
    for d in (2**60 + 1, 9):
        assert rows[d]["log_probability"] == pytest.approx(plain_log_probability(net, names.ids("word"), len(names)), abs=1e-3)
    assert lm.pseudo_likelihood(no_documents, *lm.train(no_documents)).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    net = lm.Network.start(75)
    context = np.repeat(np.array([[3, 75, 9, 74]], np.int32), 75, axis=0)
    assert np.exp(net.log_probability(context, np.arange(75, dtype=np.int32))).sum() == pytest.approx(1, abs=1e-4)


def test_training_and_scoring_in_one_go(documents):
    docs = documents(["a b c d " * 30, None, "b a " * 9, "zebra"], ids=[4, 5, 5, None])
    apart = lm.pseudo_likelihood(docs, *lm.train(docs)).collect()
    once = lm.train_and_score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in once) == [(0, 1), (4, 120), (5, 0), (5, 18)]
    assert sorted(r["log_probability"] for r in once) == pytest.approx(sorted(r["log_probability"] for r in apart), rel=1e-3)
