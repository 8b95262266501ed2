"""The labeller's inner loop: cheap exponentials that stay right where they overflow."""

import warnings

import numpy as np

from veinstone.llm import langid


def test_no_tanh_at_a_position_and_right_at_saturation(monkeypatch):
    net = langid.Network(["a", "b", "c"], 5)
    for d in "fb":
        net.p[f"t{d}"] *= 400  # far beyond what an exponential holds
    texts = ["", "a", "some words and more", "ä ö " * 300]
    want = []
    for text in texts:
        b = text.encode()
        probs = []
        for lo in range(0, len(b), langid.CORE):
            a, hi = max(0, lo - langid.CONTEXT), min(lo + langid.CORE, len(b))
            x, lengths = langid.padded([b[a : hi + langid.CONTEXT]])
            probs.append(net.positions(x, lengths)[lo - a : hi - a, 0])
        want.append(np.concatenate(probs).mean(0) if probs else np.zeros(3))

    def refused(*_, **__):
        raise AssertionError("a tanh takes nearly twice the time of an exponential")

    monkeypatch.setattr(langid.np, "tanh", refused)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = langid.Labeller(net).pooled(texts)
    assert np.isfinite(got).all() and np.abs(got - np.array(want)).max() < 1e-4
