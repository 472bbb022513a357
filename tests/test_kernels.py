"""Expected scores of fixed sequences, properties of methods, and literal re-computation on random ones."""

import math

import numpy as np
import pytest

from tracelode.functions import kernels as K
from tracelode.functions.recursion import without_recursion

A, B = list(range(10, -1, -1)), [32, 2, 1, 0]
P1, P2 = [10, 9, 8, 5, 4, 3, 2, 1, 0], [10, 9, 8, 7, 6, 5, 4, 1, 0]
P3, P4 = [15, 22, 16, 26, 3, 2, 1, 0], [15, 22, 16, 26, 4, 3, 2, 1, 0]
DF = [(i + 1) / 40 for i in range(64)]
PAIRS = [(A, A), (A, B), (B, A), (P1, P2), (P2, P1), (P1, P3), (P3, P4), (P4, P3)]
EXPECTED = {
    ("brodie", (2,)): [4.85, -13.984489526, -13.957346196, 2.313888889, 2.313888889, -1.376621266, 0.307551075, 0.2650454],
    ("optimal_alignment", (1, 2, 5)): [1, 0.617647059, 0.617647059, 0.774193548, 0.774193548, 0.5, 0.982142857, 0.982142857],
    ("damerau", (1, 2, 3, 4, False)): [0.954545455, 0.227272727, 0, 0.611111111, 0.611111111, 0.222222222, 0.875, 0.833333333],
    ("damerau", (1, 1, 1, 1, True)): [0.909090909, 0.272727273, 0, 0.444444444, 0.444444444, 0.444444444, 0.75, 0.777777778],
    ("trace_sim", ()): [0.5, -0.657148268, -0.657148268, 0.225927266, 0.225927266, -0.6757219, 0.348438787, 0.348438787],
}


def solve(name, args, pairs):
    w = lambda s: [DF[x] for x in s]
    return K.METHODS[name](K.Batch([p[0] for p in pairs], [p[1] for p in pairs], [w(p[0]) for p in pairs], [w(p[1]) for p in pairs]), *args)


@pytest.mark.parametrize("name,args", list(EXPECTED))
def test_expected(name, args):
    np.testing.assert_allclose(solve(name, args, PAIRS), EXPECTED[name, args], atol=1e-9)


def test_position_dependent_expected():
    got = solve("position_dependent", (1, 1), [*PAIRS, ([], []), ([], [1])])
    np.testing.assert_allclose(got, [1, 0.000324708, 0.000324708, 0.956945565, 0.956945565, 0.006616757, 0.988630547, 0.988630547, 1, -9999], atol=1e-9)


@pytest.mark.parametrize("name,args", list(EXPECTED) + [("position_dependent", (1, 1))])
def test_self_is_best(name, args):
    s = solve(name, args, [(A, A), (A, B), (P1, P2), (P1, P3), (P3, P4), (P3, P1)])
    assert s[0] > s[1] and s[2] >= s[3] and s[4] >= s[5]


def test_empty_sides():
    assert solve("brodie", (2,), [([], [1, 2])])[0] == -4
    assert solve("trace_sim", (), [([], [])])[0] == 0


def literal(q, c, up, left, dia, row0, col0, best):
    m = [[row0(j) for j in range(len(c) + 1)]]
    for i in range(len(q)):
        m.append([col0(i)])
        for j in range(len(c)):
            m[-1].append(best(m[i][j + 1] + up, m[-1][j] + left, m[i][j] + dia(i, j)))
    return m[-1][-1]


def test_random_against_literal():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 5, rng.integers(1, 9)).tolist(), rng.integers(0, 5, rng.integers(1, 9)).tolist()) for _ in range(200)]
    got = solve("brodie", (1.5,), pairs)
    for (q, c), s in zip(pairs, got):
        gain = lambda i, j: (1 - DF[q[i]]) * (1 - i / len(q)) * math.exp(-abs(i - j) / 2) if q[i] == c[j] else 0.0
        assert abs(literal(q, c, -1.5, -1.5, gain, lambda j: -1.5 * j, lambda i: -1.5 * (i + 1), max) - s) < 1e-9


@pytest.mark.parametrize(
    "given,expected",
    [
        ("ABCDBCBEFBCD", "ABCDBCBEFBCD"), ("A" * 300, "A"), ("ABC" * 300, "ABC"), ("AB" + "ABC" * 300 + "D", "ABCD"), ("A" + "BC" * 300, "ABC"), ("A" + "B" * 300, "AB"),
        ("ABCADB" * 300, "ABCADB"), ("ABCDEDEDEABCDEDEF", "ABCDEF"), ("AB" + "CD" * 300 + "E" + "CD" * 300, "ABCDECD"), ("A" + "BC" * 300 + "D" + "BC" * 300, "ABCDBC"), ("ABCADB", "ABCADB"),
    ],
)
def test_recursion(given, expected):
    assert "".join(without_recursion(list(given))) == expected
