"""An offline oracle: lexical rules over schema metadata, no column names of any one schema."""

from __future__ import annotations

import itertools
import math
import re

from .details import METRICS, TEXT_CUES, spoken
from .lexicon import alike, content, humanize, stem, tokens
from .oracle import Answer, Question, Questions, normalized
from .spans import UNITS

# Cue words by option.
AGG_CUES = {"sum": r"\b(total|sum|revenue|overall|how much)\b", "avg": r"\b(average|mean|avg|typical)\b", "median": r"\bmedian\b", "min": r"\b(lowest|minimum|min|smallest|cheapest|earliest|shortest)\b", "max": r"\b(highest|maximum|max|largest|biggest|most expensive|latest|longest)\b"}
DERIVED_CUES = {
    "share_of_total": r"\b(share|proportion|percentage of|percent of|what fraction)\b",
    "running_total": r"\b(running total|cumulative|cumulated)\b",
    "pct_change_vs_previous": r"\b(percent(age)? change|% change|growth( rate)?|grew)\b",
    "change_vs_previous": r"\b(change|difference) (from|versus|vs|against|over|to) (the )?(previous|prior|last|month|year)|month[- ]over[- ]month|\bchange\b",
    "moving_average": r"\b(moving|rolling) average\b",
    "rank": r"\brank(ed|ing)?\b",
}
GRAIN_CUES = {"hour": r"\b(hourly|(per|each|by) hour)\b", "day": r"\b(daily|(per|each|by) day)\b", "week": r"\b(weekly|(per|each|by) week)\b", "month": r"\b(monthly|(per|each|by|every) month)\b|month[- ](over|by)", "quarter": r"\b(quarterly|(per|each|by) quarter)\b", "year": r"\b(yearly|annual(ly)?|(per|each|by) year)\b"}
FLAG_CUES = {
    "write": r"\b(delete|update|insert|drop|truncate|remove|change the|set the|add a|create a)\b",
    "unsupported": r"\b(predict|forecast|correlat\w*|why|recommend|cluster)\b",
    "distribution": r"\b(distribution|histogram)\b",
    "empty_groups": r"\b(including|even|also) (those |ones |the ones )?(with(out)? (no|any|zero)|empty|zero)|\bevery (single )?\w+ (even|including)|\bincluding zero\b|\bzeros?\b",
    "unique": r"\b(distinct|unique|different)\b",
    "single_best": r"\bwhich \w+ (has|have|had|is|was)\b.*\b(most|fewest|highest|lowest|largest|least)\b|\bthe (best|worst|top)[- ]selling\b",
    "compare_year": r"\b(same (period|time) last year|compared (to|with) last year|vs\.? last year|versus last year|year[- ]on[- ]year|yoy)\b",
    "snapshot": r"\b(current|currently|latest|right now|in stock)\b",
    "deleted": r"\b(including deleted|deleted|all ever|ever)\b",
    "newest": r"\b(most recent|latest|newest|oldest|earliest)\b",
    "latest_each": r"\b(latest|most recent|last|newest) \w+ (of|for|per|by) (each|every)\b|\beach \w+'s (latest|last|most recent)\b",
}
# Column names that say little without their table.
GENERIC = frozenset("value amount total price number count cost".split())
_COUNT = r"\b(how many|number of|count of|count|fewest|most)\b"
_LOW = r"\b(lowest|fewest|least|smallest|cheapest|bottom|ascending|oldest|earliest|worst)\b"


def sharp(weights: Answer, temperature: float = 0.7) -> Answer:
    most = max(weights.values())
    return normalized({k: math.exp((w - most) / temperature) for k, w in weights.items()})


def yes(p: float) -> Answer:
    return {"yes": p, "no": 1 - p}


class HeuristicOracle:
    def ask(self, state: dict, questions: Questions) -> dict[str, Answer]:
        r = state["request"]
        return {n: self._answer(n, q, r, state) for n, q in questions.items()}

    def _answer(self, name: str, q: Question, r: str, state: dict) -> Answer:
        kind, _, about = name.partition(":")
        handler = getattr(self, f"_{kind}", None)
        return handler(about, q, r, state) if handler else normalized(dict.fromkeys(q.options, 1.0))

    @staticmethod
    def mention(r: str, name: str, synonyms: tuple[str, ...] = ()) -> float:
        """How well the request names a table or column: share of its words, 0 to 1; run-together names count by parts."""
        said = [stem(w) for w in content(r)]
        wide = {s for w in content(r) for s in alike(w)}
        joined = {a + b for a, b in itertools.pairwise(content(r))}
        best = 0.0
        for form in (name, *synonyms):
            words = [stem(w) for w in humanize(form.rpartition(".")[2]).split() if w not in ("id", "at", "on")]
            if not words:
                continue
            if humanize(form.rpartition(".")[2]) in joined:  # a name that is run together
                return 1.0
            hits = 0.0
            for w in words:
                if w in said:
                    hits += 1
                elif w in wide:
                    hits += 0.8
                elif any(len(s) >= 4 and (s in w or w in s) and len(w) >= 4 for s in said):
                    hits += 0.7
            best = max(best, hits / len(words))
        return best

    def _shape(self, _, q, r, state):
        low, w = re.sub(r"\bmost (?=recent|expensive)", "", r.lower()), dict.fromkeys(q.options, 0.0)
        w["trend"] += 3.5 * any(re.search(p, low) for p in GRAIN_CUES.values()) + 3 * ("over time" in low or "trend" in low)
        w["ranking"] += 2.5 * bool(re.search(r"\b(top|bottom|best|worst|most|fewest|highest|lowest|largest)\b", low))
        w["breakdown"] += 2 * bool(re.search(r"\b(by|per|for each|in each|each)\b", low))
        w["single_value"] += 1.5 * bool(re.search(r"^(how many|how much|what (is|was|were) the|number of|total|average|count)\b", low))
        w["lookup"] += 2 * bool(re.search(r"^(list|show|find|which|who|give me|display)\b", low)) - 1.5 * bool(re.search(_COUNT, low)) - 1.5 * any(re.search(p, low) for p in AGG_CUES.values())
        w["lookup"] += 2 * bool(re.match(r"\s*(please )?list\b", low))
        w["lookup"] += 3 * bool(re.search(FLAG_CUES["latest_each"], low))
        if any(re.search(p, low) for p in DERIVED_CUES.values()):
            w["breakdown"] += 1.5
        elif not re.search(_COUNT, low) and not any(re.search(p, low) for p in AGG_CUES.values()) and max(w.values()) <= 2:
            w["lookup"] += 2.5  # a bare noun phrase lists rows
        w["distribution"] += 5 * bool(re.search(FLAG_CUES["distribution"], low)) - 1
        return sharp(w)

    def _flag(self, about, q, r, state):
        return yes(0.95 if re.search(FLAG_CUES[about], r.lower()) else 0.04)

    def _subject(self, _, q, r, state):
        low, w = r.lower(), {}
        for o in q.options:
            words = stem(humanize(o))
            m = re.search(rf"\b(?:how many|number of|list|show|which|find|count|all|of)\s+(?:\w+\s+)?(\w+)", low)
            w[o] = 3 * self.mention(r, o, tuple(state.get("synonyms", {}).get(o, ()))) + 1.5 * bool(m and words == stem(m[1]))
            at = [i for i, t in enumerate(tokens(r)) if stem(t) == words]
            w[o] += 0.8 / (1 + at[0]) if at else 0
        return sharp(w, 0.5)

    def _quantity(self, _, q, r, state):
        low, w = r.lower(), {}
        counting = bool(re.search(_COUNT, low)) and not re.search(AGG_CUES["avg"] + "|" + AGG_CUES["median"], low)
        for o in q.options:
            kind, _, what = o.partition(":")
            if kind == "none":
                w[o] = 1.0 - 1.5 * counting
            elif kind == "count":
                head = re.search(r"\b(?:how many|number of|count of|count|fewest|most)\s+(?:\w+\s+)?(\w+)", low)
                w[o] = (1.2 if counting else -0.5) + 1.5 * self.mention(r, what) + 1.5 * bool(head and stem(humanize(what)) in (stem(head[1]), *(stem(x) for x in head[0].split()[2:3] if not x.endswith(("ed", "ing")))))
            elif kind == "duration":
                w[o] = 4 * bool(re.search(r"\b(how long|time (to|from|between)|duration|days? to)\b", low)) + self.mention(r, what)
            else:
                table = what.rpartition(".")[0]
                money = o in state.get("money", ())
                w[o] = 2.2 * self.mention(r, what) + 0.7 * self.mention(r, table) + (1.2 if money and re.search(r"\b(revenue|sales|value|spend|spent|worth|amount|turnover)\b", low) else 0) - (0.7 if counting else 0)
                if humanize(what.rpartition(".")[2]) in GENERIC and not self.mention(r, table):
                    w[o] -= 1.5  # "order value" is no other table's value
        return sharp(w, 0.45)

    def _agg(self, _, q, r, state):
        low = re.sub(r"\b(moving|rolling) average\b", "", r.lower())
        w = {o: 2.5 * bool(re.search(AGG_CUES.get(o, r"(?!)"), low)) for o in q.options}
        if "sum" in w and not any(w.values()):
            w["sum"] = 1.5
        if w.get("sum") and (w.get("avg") or w.get("median")):
            w["sum"] -= 2
        if re.search(r"\b(by|top|with the|have the|has the)\b.*", low) and (w.get("max") or w.get("min")) and "sum" in w and not re.search(r"\b(maximum|minimum|max|min)\b", low):
            w["sum"] += 1.5
        return sharp(w, 0.5)

    def _group(self, about, q, r, state):
        table, _, column = about.rpartition(".")
        best = 0.02
        for m in re.finditer(r"\b(?:by|per|for each|in each|of each|for every|each|across|split by|broken down by|and(?= \w+$))\s+((?:[\w-]+\s?){1,4})", r.lower()):
            words = re.split(r"\b(?:in|for|during|last|this|since|with|where|over|from|who|that|including|even|as|placed|and|this)\b", m[1])[0].split()
            head = [stem(w) for w in words]
            if "".join(words) == humanize(column):  # a name that is run together
                best = max(best, 0.95)
            if not head:
                continue
            if not column:  # an entity
                continue
            names = [stem(w) for w in humanize(column).split()]
            near = [stem(w) for w in humanize(table).split()]
            forms = [[stem(x) for x in humanize(s).split()] for s in state.get("synonyms", {}).get(about, ())]
            if head == names or head in forms or (column in state.get("display", {}).get(table, ()) and head == near):
                best = max(best, 0.95)
            elif head[-1:] == names[-1:] and set(head) <= set(names) | set(near):
                best = max(best, 0.93)
            elif len(head) == 1 and len(names) == 1 and len(head[0]) >= 4 and (head[0] in names[0] or names[0] in head[0]) and head[0] != near[0]:
                best = max(best, 0.85)
            elif column in state.get("display", {}).get(table, ()) and head and set(alike(head[-1])) & set(near) and len(head) <= 2:
                best = max(best, 0.9)
        ranked = re.search(r"\b(?:top|bottom)\s+(?:\d+\s+)?(\w+)|\brank\s+(?:the\s+)?(\w+)\s+by\b|\bwhich\s+(\w+)\s+(?:has|have|had|placed|generated)\b|\b(\w+) with the (?:most|fewest|highest|lowest)", r.lower())
        if ranked and column not in state.get("display", {}).get(table, ()) and stem(next(g for g in ranked.groups() if g)) == stem(humanize(column)):
            best = max(best, 0.9)
        if ranked and column in state.get("display", {}).get(table, ()) and stem(next(g for g in ranked.groups() if g)) in {stem(humanize(table)), *alike(humanize(table))}:
            best = max(best, 0.9)
        return yes(best)

    def _grain(self, _, q, r, state):
        return sharp({o: 4.0 * bool(re.search(GRAIN_CUES[o], r.lower())) if o != "none" else 1.5 for o in q.options})

    def _polarity(self, about, q, r, state):
        at = int(about.split("@")[1])
        before = r[max(0, at - 80) : at].lower()
        p = 0.95 if re.search(r"\b(not|excluding|except|without|other than|outside|non|exclude)\W*(?:in|from|for|the|status)?\W*(?:[\w#&-]+\s*(?:,|\band\b|\bor\b)\s*(?:and\s+|or\s+)?)*$", before) else 0.05
        return {"exclude": p, "keep": 1 - p}

    def _number(self, about, q, r, state):
        a, z = map(int, about.split("@")[1].split("-"))
        before, after = r[max(0, a - 25) : a].lower(), re.sub(r"^\s*and\s+[\d,.]+", "", r[z : z + 30].lower())
        w = dict.fromkeys(q.options, 0.0)
        timed = re.match(rf"[\s-]*(?:{'|'.join(UNITS)})s?\b", after)
        w["limit"] += 4 * bool(not timed and re.search(r"\b(top|first|bottom|best|worst|last|largest|highest)\s*$", before) or re.match(r"\s*(most recent|latest|newest|oldest|earliest|largest|biggest|smallest|cheapest|highest|lowest)\b", after))
        over = bool(re.search(r"\b(over|more than|at least|above|under|below|less than|fewer than|at most|exactly|greater than|exceed\w*|minimum|between|and)\W*$", before))
        counted = any(stem(t) in state.get("tables", ()) for t in tokens(after)[:2])
        w["having"] += 3.5 * (over and counted)
        w["threshold"] += 3 * (over and not counted) + 1 * ("$" in r[a:z])
        w["none"] += 1
        return sharp(w, 0.6)

    def _op(self, about, q, r, state):
        a = int(about.split("@")[1].split("-")[0])
        before = r[max(0, a - 20) : a].lower()
        cues = {"gte": r"at least|minimum", "lte": r"at most|up to|no more than|maximum", "gt": r"over|more than|above|greater than|exceed", "lt": r"under|below|less than|fewer than", "eq": r"exactly|equal"}
        return sharp({o: 4.0 * bool(re.search(rf"\b({cues[o]})\w*\W*$", before)) + (0.5 if o == "gt" else 0) for o in q.options})

    def _target(self, about, q, r, state):
        a = int(about.split("@")[1].split("-")[0])
        near = r[max(0, a - 50) : a + 25]
        return sharp({o: 2 * self.mention(near, o) + 0.8 * self.mention(near, o.rpartition(".")[0]) + 1.5 * (f"column:{o}" in state.get("money", ()) and ("$" in near or bool(re.search(r"worth|value", near.lower())))) for o in q.options}, 0.5)

    def _derived(self, _, q, r, state):
        w = {o: 3.5 * bool(re.search(DERIVED_CUES[o], r.lower())) if o != "none" else 1.0 for o in q.options}
        if w.get("pct_change_vs_previous", 0) > 0:
            w["change_vs_previous"] = 0
        return sharp(w, 0.6)

    def _direction(self, _, q, r, state):
        p = 0.93 if re.search(_LOW, r.lower()) else 0.06
        return {"asc": p, "desc": 1 - p}

    def _related(self, low: str, about: str, cue: str) -> float:
        names = "|".join(re.escape(f) for f in {humanize(about), humanize(about) + "s", stem(humanize(about)), stem(humanize(about)) + "s"})
        return 0.92 if re.search(rf"\b{cue}\s+(?:\w+\s+){{0,2}}?(?:{names})\b", low) else 0.03

    def _absent(self, about, q, r, state):
        verb = rf"\bnever\b.*\b{stem(humanize(about))[:5]}"
        return yes(max(self._related(r.lower(), about, r"(?:without(?: any)?|with no|have no|has no|had no|no|not have(?: any)?|n't have(?: any)?|lacking)"), 0.9 if re.search(verb, r.lower()) else 0))

    def _present(self, about, q, r, state):
        return yes(self._related(r.lower(), about, r"(?:with|who have|that have|having)(?: at least one| an?| any| some)?"))

    def _time(self, _, q, r, state):
        return sharp({o: 2 * self.mention(r, o) + 1.2 * (o == state.get("default_time")) for o in q.options}, 0.5)

    def _path(self, about, q, r, state):
        w = {o: 2.5 * self.mention(r, o) for o in q.options if o != "unclear"}
        w["unclear"] = 1.2
        return sharp(w, 0.6)

    def _saved(self, _, q, r, state):
        said = set(map(stem, content(r)))
        w = {o: 4 * len(said & set(map(stem, content(o)))) / max(1, len(set(content(o)))) if o != "none" else 2.2 for o in q.options}
        return sharp(w, 0.5)

    def _followup(self, _, q, r, state):
        return yes(0.9 if re.match(r"\s*(and|now|what about|how about|only|just|same|but|instead|also)\b", r.lower()) else 0.05)

    def _also(self, about, q, r, state):
        return self._quantity(about, q, r, state)

    def _alsoagg(self, about, q, r, state):
        return self._agg(about, q, r, state)

    def _show(self, about, q, r, state):
        table, _, column = about.rpartition(".")
        m = re.match(r"\s*(?:please\s+)?(?:list|show|display|give|find|get)\s+(?:me\s+)?(?:the\s+)?(.+?)\s+(?:of|for)\s+(?:all\s+|each\s+|the\s+|every\s+)*(\w+)", r.lower())
        if not m or stem(m[2]) not in {stem(humanize(table)), *alike(humanize(table))}:
            return yes(0.02)
        items = re.split(r",\s*(?:and\s+)?|\s+and\s+", m[1])
        return yes(0.93 if any(re.fullmatch(rf"(?:the |distinct |unique |different )*(?:{spoken(about, state.get('synonyms', {}).get(about, ()))})s?", i.strip()) for i in items) else 0.02)

    def _null(self, about, q, r, state):
        what = spoken(about, state.get("synonyms", {}).get(about, ()))
        gone = r"no|without(?: an?| any| the)?|missing(?: an?| the)?|lacking(?: an?)?|blank|null|empty|unknown"
        return yes(0.93 if re.search(rf"\b(?:{gone})\s+(?:{what})\b|\b(?:{what})\s+(?:is|are)?\s*(?:missing|null|blank|empty|unknown|not set)\b", r.lower()) else 0.03)

    def _bool(self, about, q, r, state):
        word = re.sub(r"^(is|has|was) ", "", humanize(about.rpartition(".")[2]))
        if re.search(rf"\b(?:by|per) (?:\w+ )?{re.escape(word)}\b", r.lower()):
            return sharp({o: 4.0 * (o == "none") for o in q.options})
        off = bool(re.search(rf"\b(?:not|non|isn't|aren't|in|un)[- ]?(?:been )?{re.escape(word)}\b", r.lower()))
        on = bool(re.search(rf"\b{re.escape(word)}\b", r.lower())) and not off
        return sharp({o: {"yes": 4.0 * on, "no": 4.0 * off, "none": 1.0}[o] for o in q.options})

    def _textmode(self, about, q, r, state):
        before = r[: int(about.split("@")[1])].lower()
        return sharp({o: 4.0 * bool(re.search(TEXT_CUES.get(o, r"(?!)") + r"\W*$", before)) + (o == "exact") for o in q.options})

    def _textcol(self, about, q, r, state):
        at = int(about.split("@")[1])
        near = r[max(0, at - 45) : at]

        def weight(ref: str) -> float:
            table, _, column = ref.rpartition(".")
            return 2 * self.mention(near, ref) + 1.5 * self.mention(r, table) + 0.8 * (column in state.get("display", {}).get(table, ()))

        return sharp({o: weight(o) for o in q.options}, 0.4)

    def _definition(self, about, q, r, state):
        said = set(map(stem, content(r)))
        return yes(0.93 if any(set(map(stem, content(n))) <= said and content(n) for n in state.get("names", ())) else 0.05)

    def _term(self, about, q, r, state):
        return yes(0.9 if about in METRICS else 0.04)

    def _partition(self, _, q, r, state):
        m = re.search(r"\b(?:in|within|for|of|per) (?:each|every) (\w+)|\bper (\w+)", r.lower())
        head = stem(next(g for g in m.groups() if g)) if m else ""
        return sharp({o: 4.0 * (head in {stem(w) for w in humanize(o).split()}) + 0.5 * (i == 0) for i, o in enumerate(q.options)})
