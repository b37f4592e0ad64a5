"""Business rules in prose, compiled. Only active row exclusions change results; everything else is recorded.

A rule is read as a sequence of words, and the contract as an index from words to what it declares. RULE_CLASSES lists
the classes in the order in which they are tried; the first whose reader makes something of the sentence has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import Issue
from tessera.functions.hashing import digest

#: Lifecycle states, and words that stand for them at the head of a rule.
STATES = ("draft", "review", "approved", "active", "deprecated", "superseded", "suspended")
STATE_WORDS = {
    "active": "active", "approve": "approved", "approved": "approved", "review": "review", "in_review": "review", "in-review": "review",
    "deprecate": "deprecated", "deprecated": "deprecated", "depricate": "deprecated", "depricated": "deprecated",
    "suspend": "suspended", "suspended": "suspended", "draft": "draft", "supersede": "superseded", "superseded": "superseded",
}
#: Words that make a rule an exclusion, or only negative.
EXCLUDING = ("ignore", "exclude", "omit", "remove", "drop", "do not include", "don't include", "do not count", "don't count", "blacklist", "blacklisted")
NEGATIVE = ("not", "never", "avoid", "skip", "disregard", "exclude", "ignore", "omit", "remove", "drop", "blacklist", "blacklisted", "leave out", "without")
#: Words that say how something is compared, and those that end the name of a state.
COMPARISONS = {("more", "than"): ">", ("greater", "than"): ">", ("over",): ">", (">",): ">", ("at", "least"): ">="}
STATE_ENDS = frozenset(("until", "on", "and"))
#: Words of a rule that name no value or metric.
STOP_WORDS = frozenset("a an and any are as be by for from in is it must of on only or that the this to unless use used uses using with explicitly asks user analysis metrics metric sales revenue count total".split())
_EDGES = ".,;:!?()[]\"'"


class Word(NamedTuple):
    """A word as written and folded, and whether a clause, or the whole sentence, ends after it."""

    raw: str
    low: str
    last: bool
    full_stop: bool


def _words(text: str) -> Iterator[Word]:
    for piece in text.replace(">", " > ").split():
        if bare := piece.strip(_EDGES):
            yield Word(bare, bare.casefold(), piece[-1] in ".,;:", piece[-1] == ".")


def _plain(text: str) -> list[str]:
    """Folded words of letters; underscores and other marks separate words."""
    return "".join(c if c.isalpha() else " " for c in text.casefold()).split()


def _singular(word: str) -> str:
    return word.removesuffix("s") if len(word) > 3 else word


@dataclass(frozen=True)
class Sentence:
    """A rule's text by words."""

    text: str

    @cached_property
    def words(self) -> list[Word]:
        return list(_words(self.text))

    def find(self, *phrases: str) -> int | None:
        """Position of the first word of a phrase that occurs, the phrases being tried in turn."""
        low = [w.low for w in self.words]
        for parts in map(str.split, phrases):
            for k in range(len(low) - len(parts) + 1):
                if low[k : k + len(parts)] == parts:
                    return k
        return None

    def has(self, *phrases: str) -> bool:
        return self.find(*phrases) is not None

    @cached_property
    def value(self) -> int | None:
        """Position of the first word that looks like an identifier's value: capitals, digits and hyphens (P003, SKU-9)."""
        for k, w in enumerate(self.words):
            letters = w.raw.replace("-", "").replace("_", "")
            named = letters.isascii() and letters.isalnum() and letters.upper() == letters and w.raw[0].isalpha()
            if named and (len(w.raw) > 2 or len(w.raw) == 2 and not w.raw.isalpha()):
                return k
        return None


class Vocabulary:
    """What a contract declares, by word."""

    def __init__(self, contract: Mapping[str, Any]):
        self.fields: dict[str, Mapping[str, Any]] = {**contract["dimensions"], **contract["measures"]}
        self.described: dict[str, list[str]] = {}
        self.columns: dict[str, list[str]] = {}
        for k, f in self.fields.items():
            self.columns.setdefault(f["column"].casefold(), []).append(k)
            for word in dict.fromkeys(_plain(f["description"])):
                self.described.setdefault(word, []).append(k)
        labels = {k: {_singular(w) for w in _plain(m["label"]) if w not in STOP_WORDS} for k, m in contract["metrics"].items()}
        self.labels = {k: words for k, words in labels.items() if words}

    def of_entity(self, entity: str) -> list[str]:
        """Fields that identify an entity, in all sources: their column is its name, alone or with _id."""
        return [k for k in self.fields if self.fields[k]["column"] in (entity, f"{entity}_id")]

    def metric(self, s: Sentence) -> str | None:
        """The metric of whose label's telling words the sentence has the largest share, and more than half."""
        there = {_singular(w) for w in _plain(s.text)}
        share = {k: len(words & there) / len(words) for k, words in self.labels.items()}
        best = max(share, key=share.__getitem__, default=None)
        return best if best is not None and share[best] > 0.5 else None

    def field(self, s: Sentence) -> str | None:
        """The field that the sentence names: by its id, by its column (as one word or several), or by the words that
        the description of no other field has, the field with most of them."""
        for w in s.words:
            if found := next((k for k in self.fields if k.casefold() == w.low), None):
                return found
        for column, owners in self.columns.items():
            if s.has(column, column.replace("_", " ")):
                return owners[0]
        votes: dict[str, int] = {}
        for word in dict.fromkeys(_plain(s.text)):
            owners = self.described.get(word, ())
            if word not in STOP_WORDS and len(owners) == 1:
                votes[owners[0]] = votes.get(owners[0], 0) + 1
        return max(votes, key=votes.__getitem__, default=None)

    def value(self, s: Sentence) -> tuple[str, str] | None:
        """The first word that a field's description has, and the field."""
        return next(((w, self.described[w][0]) for w in _plain(s.text) if w not in STOP_WORDS and w in self.described), None)


#: What a reader makes of a sentence: the compiled policy (None if it couldn't be resolved) and further entries.
Reading = tuple[dict[str, Any] | None, dict[str, Any]]


def _read_exclusion(s: Sentence, v: Vocabulary) -> Reading | None:
    if s.value is None or not s.has(*EXCLUDING):
        return None
    value, entity = s.words[s.value].raw, s.words[s.value - 1].low if s.value else None
    targets = [{"field_id": k, **{x: v.fields[k][x] for x in ("source", "table", "column")}} for k in v.of_entity(entity or "")]
    policy = {"scope": "all_calculations", "operator": "!=", "value": value, "targets": targets}
    return policy if targets else None, {"entity": entity, "value": value}


def _read_precedence(s: Sentence, v: Vocabulary) -> Reading | None:
    start = s.find("not")
    if start is None:
        return None
    end = next((k for k in range(start, len(s.words)) if s.words[k].full_stop), len(s.words))
    binds = any(w.low.startswith("overrid") for w in s.words[start : end + 1])
    return ({"directive": "must_not_override", "text": s.text}, {}) if binds else None


def _read_threshold(s: Sentence, v: Vocabulary) -> Reading | None:
    for phrase, operator in COMPARISONS.items():
        k = s.find(" ".join(phrase))
        number = s.words[k + len(phrase)].raw if k is not None and k + len(phrase) < len(s.words) else ""
        if not number.isdecimal():
            continue
        state, at = [], s.find("under")
        for w in s.words[at + 1 :] if at is not None else ():
            if w.low in STATE_ENDS:
                break
            state.append(w.low)
            if w.last:
                break
        name = "_".join(state[1:] if state[:1] == ["a"] else state)
        return {"subject_metric": v.metric(s), "operator": operator, "value": int(number), "state": name or None}, {}
    return None


def _read_default_filter(s: Sentence, v: Vocabulary) -> Reading | None:
    if not (s.has("use", "using") and s.has("only")):
        return None
    found = v.value(s)
    return {"directive": "default_filter", **({"value": found[0], "field_id": found[1], "operator": "="} if found else {})}, {}


def _read_binding(s: Sentence, v: Vocabulary) -> Reading | None:
    field = v.field(s) if s.has("use", "using", "must be", "based on") else None
    return ({"directive": "must_use", "field_id": field}, {}) if field else None


class RuleClass(NamedTuple):
    name: str
    effect: str
    scope: str
    read: Callable[[Sentence, Vocabulary], Reading | None]


RULE_CLASSES = (
    RuleClass("row_exclusion", "exclude", "all_calculations", _read_exclusion),
    RuleClass("precedence", "reasoning_precedence", "global", _read_precedence),
    RuleClass("threshold_state", "state_classification", "metric", _read_threshold),
    RuleClass("metric_default_filter", "metric_scope", "metric", _read_default_filter),
    RuleClass("metric_field_binding", "field_binding", "metric", _read_binding),
    RuleClass("advisory", "advisory", "global", lambda s, v: ({"note": s.text}, {})),
)


def rule_id(text: str) -> str:
    """Content-addressed: white space and case don't count, the place in the file neither."""
    return "sha256:" + digest(" ".join(text.split()).casefold())


def split_state(line: str) -> tuple[str | None, str]:
    """The lifecycle state that heads a rule's line, if one does, and the bare rule."""
    head, colon, rest = line.partition(":")
    state = STATE_WORDS.get(head.strip().casefold()) if colon else None
    return (state, rest.strip()) if state else (None, line)


def classify(text: str, vocabulary: Vocabulary) -> dict[str, Any]:
    """The first class whose reader takes the sentence; the last one takes any."""
    sentence = Sentence(text)
    made = ((c, c.read(sentence, vocabulary)) for c in RULE_CLASSES)
    c, (policy, more) = next((c, reading) for c, reading in made if reading is not None)
    return {"rule_type": c.name, "effect": c.effect, "scope": c.scope, "compiled_policy": policy, **more}


def _mode(rule: Mapping[str, Any]) -> str:
    if rule["status"] != "active" or rule["rule_type"] != "row_exclusion":
        return "recorded_only"
    return "enforced" if rule["compiled_policy"] else "unresolved"


def _findings(rule: Mapping[str, Any]) -> Iterator[Issue]:
    if rule["status"] == "unstatused":
        yield Issue("rule_status_required", "rules", rule["text"])
    if rule["application_mode"] == "unresolved":
        yield Issue("enforceable_rule_not_compiled", "rules", rule["text"])
    if rule["status"] == "active" and rule["rule_type"] == "advisory":
        s = Sentence(rule["text"])
        meant = s.value is not None and s.has(*NEGATIVE)
        yield Issue("ambiguous_enforcement_rule" if meant else "active_advisory_unstructured", "rules", rule["text"], "warning")


def compile_rules(raw: list[tuple[str, str | None]], sectioned: bool, contract: dict[str, Any]) -> list[Issue]:
    """Put the compiled rules, and the exclusions in force, into the contract. raw: texts and states as far as given."""
    vocabulary, missing = Vocabulary(contract), "unstatused" if sectioned else "active"
    kept = ("rule_type", "effect", "scope", "compiled_policy")
    rules = [{"rule_id": rule_id(text), "text": text, "status": state or missing, **{k: made[k] for k in kept}} for text, state in raw for made in [classify(text, vocabulary)]]
    rules = [{**r, "application_mode": _mode(r)} for r in rules]
    contract["rules"] = rules
    exclusions: dict[tuple[str, str], dict[str, Any]] = {}
    for r in rules:
        if r["application_mode"] == "enforced":
            policy = r["compiled_policy"]
            for t in policy["targets"]:
                entry = {**t, "operator": "!=", "value": policy["value"], "rule_id": r["rule_id"], "reason": r["text"], "application_mode": "enforced"}
                exclusions.setdefault((t["field_id"], policy["value"]), entry)
    if exclusions:
        contract["exclusions"] = list(exclusions.values())
    return [issue for r in rules for issue in _findings(r)]


def exclusions_of(contract: Mapping[str, Any], table: str) -> list[dict[str, Any]]:
    return [x for x in contract.get("exclusions", ()) if x["table"] == table]


def exclude(df: DataFrame, contract: Mapping[str, Any], table: str, keep_missing: bool = False) -> DataFrame:
    """df without the rows that active rules exclude. Structured queries drop nulls as SQL's != does; document and text
    queries keep them (``keep_missing``). As plain filters on columns they reach the scan."""
    for x in exclusions_of(contract, table):
        value = F.lit(x["value"])
        df = df.where(~F.col(x["column"]).eqNullSafe(value) if keep_missing else F.col(x["column"]) != value)
    return df


def recorded(contract: Mapping[str, Any], fields: set[str] | None = None) -> list[dict[str, Any]]:
    """Active rules that aren't enforced; with ``fields``, those that name one of them or none at all."""
    active = [r for r in contract["rules"] if r["status"] == "active" and r["application_mode"] != "enforced"]
    named = lambda r: (r["compiled_policy"] or {}).get("field_id")
    return [r for r in active if fields is None or named(r) is None or named(r) in fields]
