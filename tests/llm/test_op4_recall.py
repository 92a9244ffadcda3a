"""Secrets that have no digit, symbols, few characters or very many reach the forest."""

import numpy as np

from sparkveil.llm import op4_secrets as S


def reached(findings):
    good = [f for f in findings if f[4]]
    hit = [any(s <= len(b) and e >= len(b) + len(v) for s, e in S.candidates(b + v + a)) for b, v, a, _, _ in good]
    return sum(hit) / len(hit)


def test_recall_of_candidates():
    assert reached(S.example_findings(2000, 9)) == 1
    assert reached(S.more_findings(2000, 9)) > 0.99


def test_kinds_of_candidates():
    for text, value in [
        ('password = "P@ss!w0rd"', "P@ss!w0rd"), ("db postgres://joe:s3cr!t@host/x", "s3cr!t"), ("token: abcDEFghiJKLmnop end", "abcDEFghiJKLmnop"), ("pwd=h7Gk2p", "h7Gk2p"),
        ("x -----BEGIN PRIVATE KEY-----\n" + "Ab1+\n" * 9000 + "-----END PRIVATE KEY----- y", "-----BEGIN PRIVATE KEY-----\n" + "Ab1+\n" * 9000 + "-----END PRIVATE KEY-----"),
    ]:
        assert value in [text[s:e] for s, e in S.candidates(text)]
    assert S.candidates("-----BEGIN PRIVATE KEY-----" * 3000)[-1][1] <= 27 * 3000


def test_forest_on_the_new_kinds():
    forest = S.train(S.example_findings() + S.more_findings())
    for held in (S.example_findings(600, 77), S.more_findings(600, 78)):
        x = np.array([S.describe(v, b[-40:], a[:40], p) for b, v, a, p, _ in held])
        assert ((forest.predict(x) >= 0.5) == np.array([h[4] for h in held])).mean() > 0.9
