"""Networks with known truth: symbols that are functions of time alone, so any part of a series can be made anywhere.

A draw is the head of an MD5 digest of seed, stream and time, compared as
hexadecimal text; every value is written as SQL over the column t, without
recursion, in a form that Spark and other engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Symbol = Callable[[str], str]


def draw(stream: str, p: float = 0.5, seed: int = 7) -> Symbol:
    """1 with probability p at each time, else 0."""
    level = f"{min(round(p * 2**32), 2**32 - 1):08x}"
    return lambda t: f"(CASE WHEN substr(md5(concat('{seed}-{stream}-', CAST({t} AS STRING))), 1, 8) < '{level}' THEN 1 ELSE 0 END)"


def past(x: Symbol, lag: int) -> Symbol:
    return lambda t: x(f"({t} - {lag})")


def xor(*xs: Symbol) -> Symbol:
    return lambda t: f"(({' + '.join(x(t) for x in xs)}) % 2)"


def either(a: Symbol, b: Symbol) -> Symbol:
    return lambda t: f"greatest({a(t)}, {b(t)})"


def chosen(a: Symbol, b: Symbol, outcomes: list[Symbol]) -> Symbol:
    """The outcome that two bits select, 00 first."""
    return lambda t: f"(CASE 2 * {a(t)} + {b(t)} WHEN 0 THEN {outcomes[0](t)} WHEN 1 THEN {outcomes[1](t)} WHEN 2 THEN {outcomes[2](t)} ELSE {outcomes[3](t)} END)"


def by_block(size: int, even: Symbol, odd: Symbol) -> Symbol:
    """One symbol in even blocks of time, another in odd ones."""
    return lambda t: f"(CASE WHEN CAST(floor({t} / {size}.0) AS BIGINT) % 2 = 0 THEN {even(t)} ELSE {odd(t)} END)"


@dataclass(frozen=True)
class Motif:
    symbols: dict[str, Symbol]
    #: Planted arcs (source, target, lag).
    truth: list[tuple[str, str, int]]

    def parts(self) -> list[str]:
        return [f"SELECT CAST(0 AS BIGINT) AS trial, t, '{name}' AS process, CAST({symbol('t')} AS INT) AS code FROM steps" for name, symbol in self.symbols.items()]

    def sql(self, n: int) -> str:
        """The series as a SELECT for an engine whose range(n) is a table function over `range`."""
        return f"WITH steps AS (SELECT range AS t FROM range({n})) " + " UNION ALL ".join(self.parts())

    def table(self, spark: SparkSession, n: int) -> DataFrame:
        """(trial, t, process, code) of n steps; made where it is read, no step needs another."""
        names = list(self.symbols)
        steps = spark.range(n).withColumnRenamed("id", "t")
        wide = steps.selectExpr("t", *[f"CAST({self.symbols[p]('t')} AS INT) AS `{p}`" for p in names])
        return wide.unpivot(["t"], names, "process", "code").selectExpr("CAST(0 AS BIGINT) AS trial", "t", "process", "code")


def xor_synergy(noise: float = 0.0) -> Motif:
    a, b = draw("a"), draw("b")
    return Motif({"a": a, "b": b, "y": xor(past(a, 1), past(b, 1), draw("flip", noise))}, [("a", "y", 1), ("b", "y", 1)])


def xor_descendant(noise: float = 0.1, copy_noise: float = 0.1) -> Motif:
    m = xor_synergy(noise)
    y = m.symbols["y"]
    return Motif({**m.symbols, "z": xor(past(y, 1), draw("copy", copy_noise))}, [*m.truth, ("y", "z", 1)])


def asymmetric_interaction() -> Motif:
    a, b = draw("a"), draw("b")
    # The probabilities of a 1 after the pasts 00, 01, 10 and 11.
    levels = [0.1, 0.9, 0.8, 0.2]
    return Motif({"a": a, "b": b, "y": chosen(past(a, 1), past(b, 1), [draw(f"y{k}", p) for k, p in enumerate(levels)])}, [("a", "y", 1), ("b", "y", 1)])


def or_gate() -> Motif:
    a, b = draw("a"), draw("b")
    return Motif({"a": a, "b": b, "y": either(past(a, 1), past(b, 1))}, [("a", "y", 1), ("b", "y", 1)])


def xor_among(processes: int = 12, parents: tuple[tuple[int, int], ...] = ((8, 3), (10, 2)), noise: float = 0.1) -> Motif:
    bits = {f"p{k:02d}": draw(f"p{k}") for k in range(processes - 1)}
    last = f"p{processes - 1:02d}"
    y = xor(*[past(bits[f"p{k:02d}"], lag) for k, lag in parents], draw("flip", noise))
    return Motif({**bits, last: y}, [(f"p{k:02d}", last, lag) for k, lag in parents])


def common_driver(noise: float = 0.05) -> Motif:
    z = draw("z")
    return Motif({"x": xor(past(z, 1), draw("nx", noise)), "y": xor(past(z, 2), draw("ny", noise)), "z": z}, [("z", "x", 1), ("z", "y", 2)])


def chain(noise: float = 0.05) -> Motif:
    a = draw("a")
    b = xor(past(a, 1), draw("nb", noise))
    return Motif({"a": a, "b": b, "c": xor(past(b, 2), draw("nc", noise))}, [("a", "b", 1), ("b", "c", 2)])


def switching_coupling(block: int = 500, noise: float = 0.1) -> Motif:
    """x drives y in even blocks, y drives x in odd ones."""
    free_x, free_y, nx, ny = draw("x"), draw("y"), draw("nx", noise), draw("ny", noise)
    # at a border the driver's last value was driven itself, one step deep
    x_before, y_before = by_block(block, free_x, xor(past(free_y, 1), nx)), by_block(block, xor(past(free_x, 1), ny), free_y)
    return Motif({"x": by_block(block, free_x, xor(past(y_before, 1), nx)), "y": by_block(block, xor(past(x_before, 1), ny), free_y)}, [("x", "y", 1), ("y", "x", 1)])


def contemporaneous(kind: str = "xor", noise: float = 0.1) -> Motif:
    """Independent draws of three bits from a law at lag 0; no arc in time."""
    a, b, flip = draw("a"), draw("b"), draw("flip", noise)
    laws = {
        "xor": (a, b, xor(a, b)),
        "or": (a, b, either(a, b)),
        "copy": (a, a, b),
        "chain": (a, xor(a, flip), xor(a, flip, draw("flip2", noise))),
        "fork": (xor(b, flip), b, xor(b, draw("flip2", noise))),
        "independent": (a, b, draw("c")),
    }
    return Motif(dict(zip("abc", laws[kind], strict=True)), [])


MOTIFS = {f.__name__: f() for f in (xor_synergy, xor_descendant, asymmetric_interaction, or_gate, xor_among, common_driver, chain, switching_coupling)} | {f"contemporaneous_{k}": contemporaneous(k) for k in ("xor", "or", "copy", "chain", "fork", "independent")}
