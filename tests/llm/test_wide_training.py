"""Training in the partitions takes wide windows: every token once, in few of them, and it still learns. Scores are the network's."""

import numpy as np

from arbordiff.llm.language_model import STEPS, UNITS, WIDE, Lanes, Network, Vocabulary

OTHERS = np.ones(64)


def made(random, n):
    """Documents in which a word is followed by its neighbour as a rule."""
    out = []
    for _ in range(n):
        word, size = int(random.integers(1, 50)), int(random.integers(5, 400))
        out.append(np.array([*((word + np.cumsum(random.random(size) < 0.95)) % 49 + 1), 0], np.uint16))
    return out


def test_every_token_once_in_few_windows():
    random = np.random.default_rng(5)
    texts = made(random, 500)
    n = sum(map(len, texts))
    network = Network(Vocabulary([b"", *(b"w%d" % i for i in range(49))], np.full(50, 9.0), 450, 50, OTHERS, OTHERS))
    held = [t.astype(np.int64) for t in made(random, 50)]

    def likelihood():
        scorer, lanes, h, out = network.prepared(), Lanes(iter([(None, t) for t in held]), 8), np.zeros((8, UNITS), np.float32), 0.0
        while (w := lanes.window(STEPS)) is not None:
            symbols, targets, keep, live, _ = w
            states = scorer.states(symbols, keep, h)
            want, _ = network.log_probabilities(states[live], targets[live])
            assert np.allclose(scorer.log_probabilities(states[live], targets[live]), want, atol=1e-4)
            h = lanes.shrink(states[-1])
            out += want.sum()
        return out / sum(map(len, held))

    met, plain, before = [], network.output_gradients, likelihood()

    def counting(h, targets, grads):
        met.append(np.bincount(targets, minlength=50))
        return plain(h, targets, grads)

    network.output_gradients = counting
    network.train(texts, rate=0.15, most_lanes=WIDE)
    assert (sum(met) == np.bincount(np.concatenate(texts), minlength=50)).all()
    assert len(met) <= n // 4000 + 1
    for _ in range(5):
        network.train(texts, rate=0.15, most_lanes=WIDE)
    assert likelihood() > before + 0.5


def test_the_scorer_far_from_training():
    random = np.random.default_rng(6)
    network = Network()
    network.p["class"] *= 3000
    h, targets = random.normal(0, 1, (1500, UNITS)).astype(np.float32), random.integers(0, Network.SYMBOLS, 1500)
    assert np.allclose(network.prepared().log_probabilities(h, targets), network.log_probabilities(h, targets)[0], rtol=1e-4, atol=1e-3)
