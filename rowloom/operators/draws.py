"""Draws without replacement by a keyed permutation, in integer arithmetic that any SQL engine repeats.

A question asks for k of the places 0..n-1. Draw i is place perm(i) of a Feistel permutation of 0..n-1, so k draws cost
k evaluations and no list of earlier draws is kept. One hash per question keys the permutation and the random numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Arithmetic is modulo this prime: products of two residues fit 64 bits.
PRIME = (1 << 31) - 1
MULTIPLIERS = (1_103_515_245, 742_938_285)
ROUNDS = 8
#: Steps that a place beyond n may take back into range. Up to 1,023 places need fewer; for more, the chance of 31 misses is below 32^-31.
STEPS = 31


def mixed(x: str, s: str) -> tuple[str, str]:
    """Two steps from x and s to a residue that depends on all of both; ``y`` stands for the first one in the second."""
    a, b = MULTIPLIERS
    y = f"({x} + {s}) % {PRIME}"
    return f"(({y}) * ({y}) % {PRIME} + ({y}) * {a}L) % {PRIME}", f"(y * y % {PRIME} + y * {b}L + {s}) % {PRIME}"


def mix(x: str, s: str) -> str:
    first, second = mixed(x, s)
    return "(" + second.replace("y", f"({first})") + ")"


def unit(i: str, high: str, low: str) -> str:
    """A number in [0, 1) of 62 random bits."""
    return f"(CAST({mix(i, high)} * {PRIME}L + {mix(i, low)} AS DOUBLE) / {float(PRIME * PRIME)!r}D)"


def _pass(x: str, turns: int = ROUNDS) -> list[dict[str, str]]:
    """The steps of one pass of x through a permutation of a * b places: __l and __r, round by round, each in one of them only."""
    steps = [{"__l": f"{x} % __a", "__r": f"{x} DIV __a"}]
    for turn in range(turns):
        still, moved, side = ("__r", "__l", "__a") if turn % 2 == 0 else ("__l", "__r", "__b")
        steps.append({moved: f"({moved} + {mix(still, f'__s{turn}')}) % {side}"})
    return steps


def drawn(questions: DataFrame) -> DataFrame:
    """One row per draw: the columns of ``questions``, ``offset`` in 0..n-1 and ``key``, an exponential random number.

    ``question`` keys a question (60 bits), ``k`` <= ``n`` offsets are drawn without replacement. The keys are those of
    the ``k`` first of ``of`` independent ones: if ``of`` > k, the k + 1-st smallest of ``of`` is drawn as a sum of gaps, and below
    it the k keys are again independent.
    """

    def with_(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        kept = [c for c in df.columns if c not in columns]
        return df.selectExpr(*[f"`{c}`" for c in kept], *[f"{e} AS `{c}`" for c, e in columns.items()])

    r = ROUNDS
    keys = {f"__s{j}": f"({mix(f'{j + 1}L', f'question % {PRIME}')} + question DIV {PRIME}) % {PRIME}" for j in range(r + 4)}
    gap = f"-ln(1 - {unit('i', f'__s{r + 2}', f'__s{r + 3}')}) / (of - i)"
    cut = f"CASE WHEN of > k THEN 1 - exp(-aggregate(sequence(0L, k), 0D, (t, i) -> t + {gap})) ELSE 1D END"
    # A second pass, for the few places beyond n, goes through the rounds by name in a list.
    again = "named_struct('l', o % __a, 'r', o DIV __a)"
    for turn in range(r):
        moved = f"(p.l + {mix('p.r', f'__s{turn}')}) % __a" if turn % 2 == 0 else "p.l"
        other = "p.r" if turn % 2 == 0 else f"(p.r + {mix('p.l', f'__s{turn}')}) % __b"
        again = f"transform(array({again}), p -> named_struct('l', {moved}, 'r', {other}))[0]"
    again = f"transform(array({again}), p -> p.r * __a + p.l)[0]"
    back = f"aggregate(sequence(1, {STEPS}), __o, (o, _) -> CASE WHEN o >= n THEN {again} ELSE o END)"

    df = with_(questions, keys)
    df = with_(df, {"__a": "greatest(least(2L, n), CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT))", "__cut": cut})
    df = with_(df, {"__b": "(n + __a - 1) DIV __a"})
    df = df.selectExpr("*", "explode(sequence(0L, k - 1)) AS __i")
    for step in _pass("__i"):
        df = with_(df, step)
    df = with_(df, {"__o": "__r * __a + __l"})
    offset = f"CASE WHEN __o < n THEN __o ELSE {back} END"
    key = f"-ln(1 - {unit('__i', f'__s{r}', f'__s{r + 1}')} * __cut)"
    # A generator: what later steps ask of the result must not be unfolded into all rounds below it.
    return df.selectExpr(*[f"`{c}`" for c in questions.columns], f"inline(array(named_struct('offset', {offset}, 'key', {key})))")
