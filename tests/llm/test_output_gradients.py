"""The gradients that training uses are those of the log probabilities, and training takes the same steps as with these."""

import numpy as np

from arbordiff.llm import language_model
from arbordiff.llm.language_model import CLASSES, IN_CLASS, UNITS, Network


def test_gradients_of_the_log_probabilities():
    random = np.random.default_rng(3)
    network = Network()
    network.p["word_bias"][:] = random.normal(0, 1, (CLASSES, IN_CLASS))
    h = random.normal(0, 1, (500, UNITS)).astype(np.float32)
    targets = random.integers(0, Network.SYMBOLS, 500)
    for scale in (1, 300):  # far logits, too
        network.p["class"] *= scale
        one, two = ({k: np.zeros_like(x) for k, x in network.p.items() if k != "input"} for _ in range(2))
        _, want = network.log_probabilities(h, targets, one)
        back = network.output_gradients(h, targets, two)
        assert np.allclose(back, want, rtol=1e-3, atol=1e-3)
        for k in one:
            assert np.allclose(one[k], two[k], rtol=1e-3, atol=2e-3), k


def test_training_takes_the_same_steps():
    random = np.random.default_rng(4)
    texts = [random.integers(0, Network.SYMBOLS, n) for n in (3, 80, 1, 41, 200)]
    plain, quick = Network(), Network()

    def by_log_probabilities(h, targets, grads):
        return Network.log_probabilities(plain, h, targets, grads)[1]

    plain.output_gradients = by_log_probabilities
    plain.train(texts, 3)
    quick.train(texts, 3)
    assert all(np.allclose(plain.p[k], quick.p[k], atol=1e-3) for k in plain.p)
    assert not np.allclose(quick.p["input"], Network().p["input"]) and language_model.UNITS == UNITS
