"""Which formats a line of text matches: the patterns of `operators.extract`, tried inside a task on batches of lines.

The patterns are written for Spark's regular expressions with Unicode classes; :func:`compiled` gives the same pattern here.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

# the helpers travel with the task, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = {"\\s": f"[{SPACE}]", "\\S": f"[^{SPACE}]", ".": "[^\n\r\x85\u2028\u2029]"}
GAPS = re.compile(f"[{SPACE}]+")
DECIMAL = re.compile(r"[\d,]+\.\d+")
COMMA = re.compile(r"\$?[\d.]*\d,\d\d")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)", re.ASCII)
CENTS = re.compile(r",\d{1,2}$", re.ASCII)


def compiled(rx: str) -> re.Pattern:
    """A pattern of Spark that starts with (?U) or (?iU) and covers a whole line."""
    flags, body = re.fullmatch(r"\(\?(i?)U\)\^(.*)\$", rx, re.S).groups()
    body = re.sub(r"\[[^\]]*\]|\\.|\.", lambda m: PIECES.get(m[0], m[0]), body)
    return re.compile(body, re.I if flags else 0)


def tokens(line: str) -> list[str]:
    # str.split takes four control characters more for white space; none of them is printable
    return line.split() if line.isprintable() else [t for t in GAPS.split(line) if t]


UNIT = re.compile(r"Unidades?|ML|MTS?|M2|M3|KG|UN", re.I)
FIRST = {"carosio_presu": re.compile("[A-Z]{2}[A-Z0-9]{2,}"), "alfonsin": re.compile(r"\d+(?:,\d{1,2})?"), "molber": re.compile(r"\d+(?:\.\d\d)?"),
         "foresta": re.compile(r"\d{6,}"), "laprida": re.compile(r"\d+\.\d\d")}
SECOND = {"viejobueno": re.compile(r"\d+\.\d{10,}"), "molber": re.compile("[A-Z]{2,4}"), "galpon": re.compile(r"[A-Z]{1,3}\.?"), "laprida": FIRST["foresta"]}
UNIT_AT_END = re.compile(r"[A-Za-z]{1,6}\.?")
RATE, RATE_COMMA, ONE_PLACE = re.compile(r"\d{1,2}\.\d\d"), re.compile(r"\d{1,2},\d\d"), re.compile(r"\d{1,2},\d")
POINT, QUANTITY = re.compile(r"\$?[\d,]*\.\d\d"), re.compile(r"\d+(?:\.\d+)?")


def offered(line: str | None) -> list[str]:
    """Names of the formats a line can be, by the shape of its first and last tokens.

    Each test is necessary for its pattern, so no format that would match is left out; most lines are offered one to three.
    """
    t = tokens(line or "")
    if len(t) < 3 or not t[-1][-1].isdecimal():
        return []
    first, second, z1, z2, z3, z4 = t[0], t[1], t[-1], t[-2], t[-3], t[-4] if len(t) > 3 else ""
    whole, cents = first.isdecimal(), len(z1) > 2 and z1[-2].isdecimal()
    out = []
    if cents and z1[-3] == ",":
        pesos, percent, amount = line.count("$"), z3.endswith("%"), COMMA.fullmatch(first)
        if pesos and UNIT.fullmatch(z4 if z2 == "$" else z3):
            out.append("enseco")
        if percent and FIRST["alfonsin"].fullmatch(first):
            out.append("alfonsin")
        if amount and z3.startswith("-"):
            out.append("madlobos")
        if pesos > 2 and "%" in line:
            out.append("ofertas")
        if amount and percent and SECOND["galpon"].fullmatch(second):
            out.append("galpon")
        if whole and RATE_COMMA.fullmatch(z2) and COMMA.fullmatch(second):
            out.append("triunvirato")
        if FIRST["foresta"].fullmatch(first) and ONE_PLACE.fullmatch(z3):
            out.append("foresta")
        if pesos > 1:
            out.append("pedido_pev")
        if (second.isdecimal() or amount) and COMMA.fullmatch(z2):
            out += ["europeo"] * second.isdecimal() + ["cant_desc_eur"] * bool(amount)
        return out
    if cents and z1[-3] == ".":
        pesos = line.count("$")
        if whole and SECOND["viejobueno"].fullmatch(second):
            out.append("viejobueno")
        if FIRST["carosio_presu"].fullmatch(first) and UNIT_AT_END.fullmatch(z2):
            out.append("carosio_presu")
        if whole and pesos > 1:
            out.append("jeluz")
        if FIRST["molber"].fullmatch(first) and SECOND["molber"].fullmatch(second):
            out.append("molber")
        if len(first) > 5 and RATE.fullmatch(z2) and RATE.fullmatch(z3):
            out.append("insuma")
        if FIRST["laprida"].fullmatch(first) and SECOND["laprida"].fullmatch(second):
            out.append("laprida")
        if whole and RATE.fullmatch(z3) and POINT.fullmatch(z2):
            out.append("cant_desc_iva")
        if pesos > 1 and first[:2].isdecimal() and len(first) > 1:
            out.append("fagua")
    if DECIMAL.fullmatch(z1):
        if first[0].isdecimal() and DECIMAL.fullmatch(z2) and QUANTITY.fullmatch(z3):
            out.append("baukraft")
        if whole and DECIMAL.fullmatch(z3) and DECIMAL.fullmatch(z4):
            out.append("carosio")
    return out


def number(s: str) -> float | None:
    """`scalars.parse_number` of one text."""
    s = s.replace(" ", "")
    comma, dot = s.rfind(","), s.rfind(".")
    if comma >= 0:
        if comma > dot >= 0:
            s = s.replace(".", "").replace(",", ".")
        else:
            s = s.replace(",", "." if dot < 0 and CENTS.search(s) else "")
    return float(s) if NUMBER.fullmatch(s) else None


def matches(lines: list[str | None], formats: dict[str, tuple[int, re.Pattern, tuple[int, ...]]]):
    """(row, place, name, cod, desc, cant, pu, total, unidad, marca) of every line and format it matches; null for what is no number.

    `formats`: by name the place, the pattern and which of its groups gives each of the seven fields (0: none).
    """
    for row, line in enumerate(lines):
        for name in offered(line):
            place, rx, order = formats[name]
            m = rx.fullmatch(line)
            if m:
                field = [(m[g] or "").strip(" ") if g else "" for g in order]
                yield row, place, name, *field[:2], *(number(s) for s in field[2:5]), *field[5:]
