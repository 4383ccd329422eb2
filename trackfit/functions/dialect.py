"""A small vocabulary of list expressions, written once and rendered for Spark SQL or for DuckDB (the test oracle).

Lists are indexed from 0. Rendering for Spark uses built-in higher-order functions, so rules stay inside the JVM.
"""

from __future__ import annotations


class Spark:
    """Renders for Spark SQL."""

    name = "spark"
    empty = "cast(array() as array<bigint>)"

    def at(self, items: str, i: object) -> str:
        return f"get({items}, cast({i} as int))"

    def seq(self, a: object, b: object) -> str:
        return f"if({b} >= {a}, sequence(cast({a} as int), cast({b} as int)), cast(array() as array<int>))"

    def keep(self, items: str, x: str, cond: str) -> str:
        return f"filter({items}, {x} -> {cond})"

    def each(self, items: str, x: str, value: str) -> str:
        return f"transform({items}, {x} -> {value})"

    def every(self, items: str, x: str, cond: str) -> str:
        return f"forall({items}, {x} -> {cond})"

    def part(self, items: str, start: object, length: object) -> str:
        return f"slice({items}, cast({start} + 1 as int), greatest(cast({length} as int), 0))"

    def let(self, name: str, value: str, body: str) -> str:
        """``body`` with ``name`` standing for ``value``, which is evaluated once."""
        return f"get(transform(array({value}), {name} -> {body}), 0)"

    def diff(self, items: str) -> str:
        """First differences. Both operands are whole lists: indexing inside a lambda would evaluate ``items`` once per element
        where the optimiser puts its expression in place of the column."""
        rest = f"greatest(size({items}) - 1, 0)"
        return f"zip_with(slice({items}, 2, {rest}), slice({items}, 1, {rest}), (p, q) -> p - q)"

    def least(self, items: str) -> str:
        return f"array_min({items})"

    def most(self, items: str) -> str:
        return f"array_max({items})"

    def kinds(self, items: str) -> str:
        return f"size(array_distinct({items}))"

    def size(self, items: str) -> str:
        return f"size({items})"

    def reverse(self, items: str) -> str:
        return f"reverse({items})"

    def sort(self, items: str) -> str:
        return f"array_sort({items})"

    def flat(self, items: str) -> str:
        return f"flatten({items})"

    def make(self, *values: object) -> str:
        return f"array({', '.join(f'cast({v} as bigint)' for v in values)})"

    def join(self, *lists: str) -> str:
        return f"concat({', '.join(lists)})"

    def longs(self, items: str) -> str:
        return f"transform({items}, q -> cast(q as bigint))"

    def div(self, a: object, b: object) -> str:
        return f"(({a}) div ({b}))"

    def mod(self, a: object, b: object) -> str:
        return f"pmod({a}, {b})"

    def xor(self, a: object, b: object) -> str:
        return f"(({a}) ^ ({b}))"

    def big(self, a: object) -> str:
        return f"cast({a} as bigint)"


class Duck(Spark):
    """Renders for DuckDB."""

    name = "duck"
    empty = "CAST([] AS BIGINT[])"

    def at(self, items: str, i: object) -> str:
        return f"list_extract({items}, CAST(({i}) + 1 AS BIGINT))"

    def seq(self, a: object, b: object) -> str:
        return f"range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)"

    def keep(self, items: str, x: str, cond: str) -> str:
        return f"list_filter({items}, lambda {x}: {cond})"

    def each(self, items: str, x: str, value: str) -> str:
        return f"list_transform({items}, lambda {x}: {value})"

    def every(self, items: str, x: str, cond: str) -> str:
        return f"(len(list_filter({items}, lambda {x}: NOT coalesce({cond}, false))) = 0)"

    def part(self, items: str, start: object, length: object) -> str:
        return f"list_slice({items}, ({start}) + 1, ({start}) + ({length}))"

    def let(self, name: str, value: str, body: str) -> str:
        return f"list_extract(list_transform([{value}], lambda {name}: {body}), 1)"

    def diff(self, items: str) -> str:
        return self.each(self.seq(1, f"{self.size(items)} - 1"), "j", f"{self.at(items, 'j')} - {self.at(items, 'j - 1')}")

    def least(self, items: str) -> str:
        return f"list_min({items})"

    def most(self, items: str) -> str:
        return f"list_max({items})"

    def kinds(self, items: str) -> str:
        return f"len(list_distinct({items}))"

    def size(self, items: str) -> str:
        return f"len({items})"

    def reverse(self, items: str) -> str:
        return f"list_reverse({items})"

    def sort(self, items: str) -> str:
        return f"list_sort({items})"

    def make(self, *values: object) -> str:
        return f"[{', '.join(f'CAST({v} AS BIGINT)' for v in values)}]"

    def join(self, *lists: str) -> str:
        return f"flatten([{', '.join(lists)}])"

    def longs(self, items: str) -> str:
        return f"list_transform({items}, lambda q: CAST(q AS BIGINT))"

    def div(self, a: object, b: object) -> str:
        return f"(({a}) // ({b}))"

    def mod(self, a: object, b: object) -> str:
        return f"(((({a}) % ({b})) + ({b})) % ({b}))"

    def xor(self, a: object, b: object) -> str:
        return f"xor({a}, {b})"

    def big(self, a: object) -> str:
        return f"CAST({a} AS BIGINT)"


SPARK, DUCK = Spark(), Duck()
