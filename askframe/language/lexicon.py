"""Words: number, stems, names made readable, synonyms, value aliases."""

from __future__ import annotations

import re

# Words that say nothing about what is asked.
STOPWORDS = frozenset("a an the of in on at by for to from with and or is are was were be been do does did have has had how many much what which who whose show me list give all each every per our my we i it that this these those there as not no".split())
# Groups of words that mean the same in business questions.
SYNONYMS = (
    ("customer", "client", "buyer", "account"), ("order", "purchase", "sale"), ("revenue", "sales", "turnover", "income"), ("product", "item", "part", "article"), ("supplier", "vendor"),
    ("employee", "staff", "worker"), ("region", "area", "territory"), ("nation", "country"), ("price", "cost"), ("total", "sum", "overall"), ("quantity", "units", "volume"), ("invoice", "bill"),
    ("category", "kind", "type"), ("segment", "group"), ("status", "state"), ("ticket", "case", "issue"), ("ship", "deliver", "dispatch"), ("value", "amount", "worth", "price"),
)
# Codes of states and countries.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}
COUNTRIES = {
    "US": "United States", "CA": "Canada", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "MX": "Mexico", "JP": "Japan",
    "AU": "Australia", "IN": "India", "BR": "Brazil", "CN": "China", "ES": "Spain", "IT": "Italy", "NL": "Netherlands",
}
#: Further short forms of countries.
MORE_COUNTRIES = {"USA": "United States", "UK": "United Kingdom", "UAE": "United Arab Emirates"}


def singular(w: str) -> str:
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if len(w) > 4 and re.search(r"(s|x|z|ch|sh)es$", w):
        return w[:-2]
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w


def plural(w: str) -> str:
    if re.search(r"[^aeiou]y$", w):
        return w[:-1] + "ies"
    return w + ("es" if re.search(r"(s|x|z|ch|sh)$", w) else "s")


def stem(w: str) -> str:
    w = singular(w.lower())
    for end in ("ing", "ed"):
        if len(w) > len(end) + 3 and w.endswith(end):
            w = w[: -len(end)]
            return w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sl" else w
    return w


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[\s-]+", "_", name).lower()


def humanize(name: str) -> str:
    table, _, column = name.rpartition(".")
    words = re.sub(r"^[a-z]{1,2}_(?=[a-z]{3})", "", snake(column)).replace("_", " ").strip()
    return f"{humanize(table)} {words}" if table else words


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:'[a-z]+)?", text.lower())


def content(text: str) -> list[str]:
    return [t for t in tokens(text) if t not in STOPWORDS]


def alike(word: str) -> frozenset[str]:
    """The stems that mean the word."""
    s = stem(word)
    return frozenset({s}.union(*(map(stem, g) for g in SYNONYMS if s in set(map(stem, g)))))


def aliases(value: str, column: str = "") -> frozenset[str]:
    """The ways to say a value; codes of places and their names stand for each other, by what the column's name says it holds."""
    v, c = value.lower(), column.lower()
    tables = [t for word, some in (("state", (STATES,)), ("country", (COUNTRIES, MORE_COUNTRIES)), ("nation", (COUNTRIES, MORE_COUNTRIES))) if word in c for t in some]
    full = {t[value.upper()].lower() for t in tables if value.upper() in t}
    short = {k.lower() for t in tables or (STATES, COUNTRIES, MORE_COUNTRIES) for k, name in t.items() if name.lower() == v}
    return frozenset({v, v.replace("_", " "), v.replace("-", " "), re.sub(r"^\d+[- ]", "", v)} | full | short)
