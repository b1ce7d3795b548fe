"""SQL of the numbers that ``operators.sampling`` draws, for the oracles."""

from __future__ import annotations

from kinfold.operators.sampling import MIXES, PRIME, _round_keys


def _mix(x: str, a: int, b: int, c: int, d: int, e: int) -> str:
    u = f"(((({x}) & 4294967295) % {PRIME} * {a}::bigint + (({x}) >> 32) % {PRIME} * {b}::bigint + {c}) % {PRIME})"
    v = f"((xor({u}, {u} >> 15) * {d}::bigint) % {PRIME})"
    return f"((xor({v}, {v} >> 13) * {e}::bigint) % {PRIME})"


def scrambled(x: str, modulus: int = 1000) -> str:
    x = f"({x})::bigint"
    return f"(({_mix(x, *MIXES[0])} * {PRIME + 1}::bigint + {_mix(x, *MIXES[1])}) % {modulus}::bigint)"


#: How many rows there are (n, of the table named), and the numbers that their places are written in.
DIGITS = "select n, (floor(sqrt(n - 1)) + 1)::bigint lo, ((n + floor(sqrt(n - 1))::bigint) // (floor(sqrt(n - 1)) + 1)::bigint) hi from (select count(*) n from {})"


def _once(x: str, key: int) -> str:
    left, right = f"(({x}) // lo)", f"(({x}) % lo)"
    for i, (a, b) in enumerate(_round_keys(key)):
        if i % 2:
            right = f"(({right} + ({left} * {a}::bigint + {b}) % {PRIME}) % lo)"
        else:
            left = f"(({left} + ({right} * {a}::bigint + {b}) % {PRIME}) % hi)"
    return f"({left} * lo + {right})"


def permuted(x: str, key: int = 1) -> str:
    """Where n, lo and hi of ``DIGITS`` are at hand."""
    return f"list_reduce(list_prepend({_once(x, key)}, range(64)), lambda q, i: case when q >= n then {_once('q', key)} else q end)"
