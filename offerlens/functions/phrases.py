"""The parsers of `text` for one short phrase inside a task: what a Column function gives, for phrases that come again and again.

Patterns are those of `text`, their classes ASCII and their word ends those of all letters, as Java has them; tests hold each
function against its Column.
"""

from __future__ import annotations

import calendar
import re
from datetime import date as Day

from offerlens.functions import text

CLASSES = {r"\d": "0-9", r"\s": r" \t\n\v\f\r", r"\w": "a-zA-Z0-9_"}


def compiled(pattern: str) -> re.Pattern[str]:
    """A pattern with its classes spelled out."""
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for name, letters in CLASSES.items():
        parts = [x.replace(name, letters if i % 2 else f"[{letters}]") for i, x in enumerate(parts)]
    return re.compile("".join(parts))


# blanks as Java's (?U)\s has them; NUMBER, AMOUNT and the rest as `text` has them
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
NUMBER, AMOUNTS, THREE_LAST = compiled(text.NUMBER), compiled(text.AMOUNT), compiled(r"\.\d{3}$")
PER_MILLE, PERCENT, PERCENT_WORD = (re.compile(p, re.IGNORECASE) for p in ("b[iİı]nde", "%|٪|y[üu]zde", "y[üu]zde|%"))
THOUSANDTH = compiled(r"\bbinde\s+([\d.,]+|\w+)")
MONTHS, YEARS = compiled(text.counted(text.MONTH_UNITS)), compiled(text.counted(text.YEAR_UNITS))
NAMES = "|".join(text.MONTHS)
SPELLED, DOTTED, ENDING, YEARLY = map(compiled, (rf"(\d{{1,2}})\s+({NAMES})\s+(\d{{4}})", r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b", rf"\b({NAMES})\s+(\d{{4}})\s*(?:sonu|ay\s*sonu)", r"\b(\d{4})\s*(?:yil\s*sonu|sonuna\s+kadar)"))
FOUR, DIGIT = compiled(r"\d{4}"), compiled(r"\d")
IN_PERCENT, IN_LIRA = compiled(r"%|yuzde|\bbinde\s"), compiled(r"₺|(?<![a-z])tl\b|(?<![a-z])try\b|turk\s+lirasi|\blira\b")
FOLDED = str.maketrans("âîûışğüöç", "aiuisguoc", text.APOSTROPHES + "̇")
DOTTED_I, LETTERS, NO_BLANKS = str.maketrans("IİŞĞÜÖÇ", "ıişğüöç"), str.maketrans("âîûışğüöç", "aiuisguoc"), str.maketrans("", "", " \t\n\v\f\r")


def search_key(s: str) -> str:
    return BLANKS.sub(" ", s.lower().translate(FOLDED)).strip(" ")


def position_key(s: str) -> str:
    return s.translate(DOTTED_I).lower().translate(LETTERS)


def number(s: str) -> float | None:
    found = NUMBER.search(s)
    if not found:
        return None
    raw = found.group().translate(NO_BLANKS)
    body = raw[1:] if raw[0] in "+-" else raw
    if "." in body and ("," in body or THREE_LAST.search(body)):
        body = body.replace(".", "")
    try:
        return float(body.replace(",", ".")) * (-1.0 if raw[0] == "-" else 1.0)
    except ValueError:
        return None


def rate(s: str) -> float | None:
    marked = PERCENT.search(s)
    if PER_MILLE.search(s):
        word = THOUSANDTH.search(search_key(s))
        if word:
            w = word.group(1)
            x = number(w) if DIGIT.match(w) else text.NUMBER_WORDS.get(w)
            return float(x) / 10 if x is not None and 0 <= x <= 1000 else None
    x = number(PERCENT_WORD.sub(" ", s)) if marked else None
    return x if x is not None and 0 <= x <= 100 else None


def money(s: str) -> float | None:
    for x in AMOUNTS.findall(position_key(s).replace("₺", "tl")):
        n = number(x) if DIGIT.search(x) else 1.0
        if n is not None:
            return n * next((v for name, v in text.MULTIPLIERS.items() if name in x), 1.0)
    return None


def term_months(s: str) -> int | None:
    key = position_key(s)
    longest = max([int(n) for n in MONTHS.findall(key)] + [12 * int(n) for n in YEARS.findall(key)], default=0)
    return longest if 0 < longest <= 600 else None


def date(s: str) -> Day | None:
    if not FOUR.search(s):
        return None
    key = position_key(s)
    last = lambda y, m: (y, m, calendar.monthrange(y, m)[1])
    forms = [
        (SPELLED, lambda d, m, y: (int(y), text.MONTHS[m], int(d))), (DOTTED, lambda d, m, y: (int(y), int(m), int(d))), (ENDING, lambda m, y: last(max(1, int(y)), text.MONTHS[m])),
        (YEARLY, lambda y: (int(y), 12, 31)),
    ]
    for pattern, parts in forms:
        found = pattern.search(key)
        if found:
            try:
                day = Day(*parts(*found.groups()))
            except ValueError:
                return None
            return day if 2000 <= day.year <= 2100 else None
    return None


def unit_of(s: str) -> str | None:
    key = position_key(s)
    return "percent" if IN_PERCENT.search(key) else "lira" if IN_LIRA.search(key) else None
