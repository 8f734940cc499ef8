"""SQL building blocks with a form for Spark and one for an ANSI engine such as DuckDB.

Rules and operators are written once, as SQL over the entity tables; where two engines spell an
expression differently, it is named here."""

from __future__ import annotations

import re

#: What Python's str.strip() removes (fixed values).
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


class Spark:
    """Spark SQL."""

    @staticmethod
    def pattern(p: str) -> str:
        return f'r"{p}"' if '"' not in p else f"r'{p}'"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.pattern(p)})"

    def replaced(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')"

    def group(self, n: int) -> str:
        """A group in a replacement."""
        return f"${n}"

    def found(self, x: str, p: str) -> str:
        """All matches, as an array."""
        return f"regexp_extract_all({x}, {self.pattern(p)}, 0)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def each(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {var} -> {body})"

    def kept(self, x: str, var: str, body: str) -> str:
        return f"filter({x}, {var} -> {body})"

    def total(self, x: str) -> str:
        return f"aggregate({x}, 0L, (a, b) -> a + b)"

    def joined(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {quoted(sep)}) WITHIN GROUP (ORDER BY {order})"

    def numbers(self, low: str, high: str) -> str:
        """Rows low..high in a column called n, as a lateral table."""
        return f"LATERAL (SELECT explode(sequence({low}, {high})) AS n)"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def at(self, x: str, n: str) -> str:
        """The n-th of an array, from 1."""
        return f"element_at({x}, CAST({n} AS INT))"


class Duck:
    """DuckDB."""

    @staticmethod
    def pattern(p: str) -> str:
        return quoted(p)

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def replaced(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}', 'g')"

    def group(self, n: int) -> str:
        return f"\\{n}"

    def found(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def each(self, x: str, var: str, body: str) -> str:
        return f"list_transform({x}, lambda {var}: {body})"

    def kept(self, x: str, var: str, body: str) -> str:
        return f"list_filter({x}, lambda {var}: {body})"

    def total(self, x: str) -> str:
        return f"coalesce(list_sum({x}), 0)"

    def joined(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {quoted(sep)} ORDER BY {order})"

    def numbers(self, low: str, high: str) -> str:
        return f"LATERAL (SELECT unnest(generate_series({low}, {high})) AS n)"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def at(self, x: str, n: str) -> str:
        return f"({x})[{n}]"


def strip(d, x: str) -> str:
    """x without white space at its ends; null stays null."""
    return d.replaced(x, f"^{SPACE}+|{SPACE}+$", "")


def filled(d, x: str) -> str:
    """x is not null and not only white space."""
    return f"coalesce({strip(d, x)} <> '', false)"


def truthy(x: str) -> str:
    """x is not null and not empty."""
    return f"coalesce({x} <> '', false)"


def tables_in(sql: str) -> list[str]:
    """The tables ($name) that a text of SQL reads."""
    return list(dict.fromkeys(re.findall(r"\$([a-z_]\w*)", sql)))


def bound(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\$([a-z_]\w*)", lambda m: names[m[1]], sql)
