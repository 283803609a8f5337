"""XXH64 as SQL for DuckDB, for checking what the library's hashes lead to."""

from __future__ import annotations

#: Fixed values of the hash function: its five primes.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
ALL = 1 << 64
_M = f"{ALL}::UHUGEINT"


def _n(x: int) -> str:
    return f"{x % ALL}::UHUGEINT"


def _times(a: str, n: int) -> str:
    return f"(({a}) * {_n(n)} % {_M})"


def _plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_M})"


def _rotated(x: str, bits: int, name: str = "q") -> str:
    """x turned left; name is that of a variable that is not in use around it."""
    return f"list_transform([({x}) * {_n(1 << bits)}], lambda {name}: ({name} % {_M} + {name} // {_M}))[1]"


def _lane(at: str, size: int) -> str:
    """size bytes from byte `at` on, the lowest first, of the hex digits h."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(size - 1, -1, -1)) + ")::UBIGINT::UHUGEINT"


def _round(acc: str, lane: str, name: str = "q") -> str:
    return _times(_rotated(_plus(acc, _times(lane, P2)), 31, name), P1)


def _merged(h: str, v: str) -> str:
    return _plus(_times(f"xor({h}, {_round(_n(0), v)})", P1), _n(P4))


def xxh64(table: str, seed: int) -> str:
    """A query for (s, g): the hash g, unsigned, of the UTF-8 bytes of each s of a table."""

    def stripe(k: int, begin: int) -> str:
        return f"list_reduce(list_transform(range(0, n // 32), lambda j: {_lane(f'32 * j + {8 * k}', 8)}), lambda acc, ln: {_round('acc', 'ln')}, {_n(begin)})"

    eights = f"list_transform(range(0, n % 32 // 8), lambda j: {_lane('n - n % 32 + 8 * j', 8)})"
    ones = f"list_transform(range(n - n % 4, n), lambda j: {_lane('j', 1)})"
    steps = (
        f"s, h, n, {', '.join(f'{stripe(k, begin)} AS v{k + 1}' for k, begin in enumerate((seed + P1 + P2, seed + P2, seed, seed - P1)))}",
        f"s, h, n, v1, v2, v3, v4, ({' + '.join(_rotated(f'v{k + 1}', bits) for k, bits in enumerate((1, 7, 12, 18)))}) % {_M} AS w0",
        *(f"s, h, n, v1, v2, v3, v4, {_merged(f'w{k}', f'v{k + 1}')} AS w{k + 1}" for k in range(4)),
        f"s, h, n, {_plus(f'CASE WHEN n < 32 THEN {_n(seed + P5)} ELSE w4 END', 'n::UHUGEINT')} AS y0",
        f"s, h, n, list_reduce({eights}, lambda acc, ln: {_plus(_times(_rotated('xor(acc, ' + _round(_n(0), 'ln') + ')', 27, 'p'), P1), _n(P4))}, y0) AS y1",
        f"s, h, n, CASE WHEN n % 8 >= 4 THEN {_plus(_times(_rotated('xor(y1, ' + _times(_lane('n - n % 8', 4), P1) + ')', 23), P2), _n(P3))} ELSE y1 END AS y2",
        f"s, list_reduce({ones}, lambda acc, ln: {_times(_rotated('xor(acc, ' + _times('ln', P5) + ')', 11), P1)}, y2) AS z0",
        f"s, {_times(f'xor(z0, z0 // {_n(1 << 33)})', P2)} AS z1",
        f"s, {_times(f'xor(z1, z1 // {_n(1 << 29)})', P3)} AS z2",
        f"s, xor(z2, z2 // {_n(1 << 32)}) AS g",
    )
    out = f"(SELECT s, hex(encode(s)) AS h, len(hex(encode(s))) // 2 AS n FROM {table})"
    for step in steps:
        out = f"(SELECT {step} FROM {out})"
    return out
