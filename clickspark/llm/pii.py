"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs
the labelers, and a span classifier trained on the weighed votes decides.

Text is only touched by SQL functions. What reaches the driver are counts of vote patterns, of which
there are at most as many as combinations of five kinds, three three-valued votes and three flags. The
trained weights go back into SQL and score every candidate, also with votes that no fitted span had.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.llm.storage import materialise

#: Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone", "secret")

# -- fixed patterns of the base kinds ---------------------------------------------------------------
# Possessive quantifiers and a look behind keep them linear on very long runs of one class; they match
# what the plain patterns match, since no run that fails from its start matches from within.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

# -- candidates beyond the base ---------------------------------------------------------------------
# What may be personal, wide on purpose: the votes decide. No length is capped; every pattern starts at
# the first character of its run only and takes runs possessively, so it is linear on any text.
_AT = r"(?: ?@ ?| ?[(\[](?i:at)[)\]] ?)"
_DOT = r"(?:\.| ?[(\[](?i:dot)[)\]] ?)"
_PART = r"(?:\.| ?[(\[](?:\.|(?i:dot))[)\]] ?)"
_HEX = "[0-9A-Fa-f]{1,4}"
CANDIDATE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_PART}[0-9]{{1,3}}){{3}}(?![0-9.])"
          rf"|(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}}+)?+::(?:{_HEX}(?::{_HEX}){{0,6}}+)?+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+",
}

# regex labeler: what a well-formed span looks like
WELL_FORMED = {
    "email": rf"^[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++$(?<=[A-Za-z]{{2}})",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})$",
    "secret": r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|(?:gh[pousr]|sk|pk)[_-][A-Za-z0-9_-]{16,})$",
}
# gazetteer labeler. Card issuers, E.164 country codes, area codes of +1, generic and national
# top-level domains, special networks, prefixes of issued keys, names under which secrets are stored
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|3(?:0[0-5]|[689])|35|6(?:011|4|5|2))"
CALLING_CODE = (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
                r"|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9])")
AREA_CODE = r"^(?:1[ .-])?\(?[2-9][0-8][0-9]\)?[ .-]"
TOP_DOMAIN = (r"(?i)\b(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|io|ai|co|me|tv|eu"
              r"|ae|ar|at|au|be|bg|br|ca|ch|cl|cn|cz|de|dk|ee|es|fi|fr|gr|hk|hr|hu|id|ie|il|in|is|it|jp|ke|kr|lt|lu|lv|ma|mx|my"
              r"|ng|nl|no|nz|pe|ph|pk|pl|pt|ro|rs|ru|sa|se|sg|si|sk|th|tr|tw|ua|uk|us|ve|vn|za)$")
NETWORK = r"(?i)^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|[23][0-9a-f]{3}:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"
NO_HOST = r"(?i)^(?:0\.|127\.|22[4-9]\.|2[3-5][0-9]\.|::1?$|ff[0-9a-f]{2}:)"
KEY_PREFIX = (r"^(?:AKIA|ASIA|AIza|ya29|eyJ|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[spr]k[_-]|npm_|pypi-|hf_|dop_v1_|shp(?:at|ss)_|whsec_)")
SECRET_NAME = r"(?i)(?:password|passwd|passphrase|pwd|token|secret|credential|api[_-]?key|key|bearer|auth)"
# context labeler: words that announce a kind, close before the span
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|reach)\W{0,6}$",
    "ip": r"(?i)(?:\bip(?:v[46])?|addr(?:ess)?|host|server|client|peer|ping|from)\W{0,6}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit)\W{0,6}(?:no\.?|number)?\W{0,6}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp)\W{0,6}$",
    "secret": r"(?i)[=:]\s{0,3}[\"'`]?$",
}
COUNTER_CUE = r"(?i)(?:order|isbn|version|invoice|build|commit|sha|\bid)\W{0,4}$"

_BLOCK = 256
_SPAN = "struct<at:int,stop:int,match:string,before:string,after:string>"


# -- spans of a pattern ------------------------------------------------------------------------------

def with_spans(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For every name in ``patterns`` a column of all its leftmost matches in column ``text``.

    SQL finds matches and the pieces between them but no positions, so positions are sums of piece
    and match lengths; sums over blocks of matches keep that near linear for any number of matches.
    Positions count code points. ``before`` and ``after`` hold up to 24 and 8 characters of the
    neighbouring pieces.
    """
    kept = rows.columns
    names = list(patterns)
    c = F.col
    rows = rows.select(*kept, *[F.regexp_extract_all(text, F.lit(patterns[n]), F.lit(0)).alias(f"_m_{n}") for n in names],
                       *[F.split(text, patterns[n], -1).alias(f"_p_{n}") for n in names])
    length = lambda n: F.transform(c(f"_m_{n}"), lambda m, i: F.length(m) + F.length(c(f"_p_{n}")[i]))
    rows = rows.select(*rows.columns, *[length(n).alias(f"_l_{n}") for n in names])
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(f"_m_{n}") / _BLOCK).cast("int")),
                                 lambda b: total(F.slice(f"_l_{n}", 1, b * _BLOCK)))
    rows = rows.select(*rows.columns, *[F.when(F.size(f"_m_{n}") > 0, sums(n)).alias(f"_s_{n}") for n in names])

    def spans(n: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            at = c(f"_s_{n}")[block] + total(F.slice(f"_l_{n}", block * _BLOCK + 1, i - block * _BLOCK)) + F.length(c(f"_p_{n}")[i])
            return F.struct(at.alias("at"), (at + F.length(m)).alias("stop"), m.alias("match"),
                            F.right(c(f"_p_{n}")[i], F.lit(24)).alias("before"), F.left(c(f"_p_{n}")[i + 1], F.lit(8)).alias("after"))
        return F.when(F.size(f"_m_{n}") > 0, F.transform(c(f"_m_{n}"), one)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return rows.select(*kept, *[spans(n).alias(n) for n in names])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def is_card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def base_valid(kind: str, match: Column) -> Column:
    """The check that follows the base pattern of a kind."""
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return is_card(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


# -- labelers ----------------------------------------------------------------------------------------

def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0 for no opinion."""
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, -1)).otherwise(0)


def votes(kind: str, span: Column) -> dict[str, Column]:
    """Votes of the three labelers and the flags of the classifier for one candidate span."""
    match, before, after = span["match"], span["before"], span["after"]
    if kind == "card":
        regex, gazetteer = _vote(is_card(match), ~is_card(match)), _vote(match.rlike(ISSUER), ~match.rlike(ISSUER))
    elif kind == "phone":
        regex, gazetteer = _vote(match.rlike(WELL_FORMED[kind]), match.rlike("^[0-9]+$")), _vote(match.rlike(CALLING_CODE) | match.rlike(AREA_CODE))
    elif kind == "ip":
        plain = F.regexp_replace(match, _PART, ".")
        v4 = ~match.contains(":")
        regex = _vote(F.when(v4, base_valid("ip", plain)).otherwise(match.rlike("^[0-9A-Fa-f]+:.*[0-9A-Fa-f]$") & match.rlike("[0-9]")), v4)
        gazetteer = _vote(plain.rlike(NETWORK), plain.rlike(NO_HOST))
    elif kind == "email":
        regex, gazetteer = _vote(match.rlike(WELL_FORMED[kind])), _vote(match.rlike(TOP_DOMAIN))
    else:
        regex = _vote(match.rlike(WELL_FORMED[kind]), ~match.rlike("[0-9].*[0-9].*[0-9]"))
        gazetteer = _vote(match.rlike(KEY_PREFIX) | before.rlike(SECRET_NAME))
    joined = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    return {"regex": regex, "gazetteer": gazetteer,
            "context": _vote(before.rlike(CUES[kind]), joined | before.rlike(COUNTER_CUE)),
            "glued": joined.cast("int"), "long": (F.length(match) >= 20).cast("int"), "bare": match.rlike("^[0-9]+$").cast("int")}


VOTES = ("regex", "gazetteer", "context")
FLAGS = ("glued", "long", "bare")


def features(kind: str, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in votes(kind, span).items()])


# -- label model and classifier (over counts) -----------------------------------------------------------

@dataclass(frozen=True)
class SpanModel:
    """``reliability[kind][labeler][vote]`` = (chance if not personal, chance if personal); the classifier's
    weights by feature, which decide on every span; ``accepted`` lists the fitted combinations that they
    call personal, to look at. A model without weights accepts nothing."""

    reliability: dict
    weights: dict
    accepted: frozenset

    def personal(self, pattern: tuple) -> bool:
        """Whether (kind, votes..., flags...) is personal: one half or more, and some labeler spoke for it."""
        return bool(self.weights) and sum(self.weights.get(f, 0.0) for f in _encode(pattern)) >= 0 and any(v > 0 for v in pattern[1:1 + len(VOTES)])

    def score(self, kind: str, said: dict[str, Column]) -> Column:
        """:meth:`personal` in SQL, from the votes and flags of a span of ``kind``."""
        if not self.weights:
            return F.lit(False)
        w = lambda f: self.weights.get(f, 0.0)
        total = F.lit(w("bias") + w(f"kind={kind}"))
        for v in VOTES:
            for x in (1, -1):
                total = total + F.when(said[v] == x, w(f"{v}={x}") + w(f"{kind},{v}={x}")).otherwise(0.0)
        for flag in FLAGS:
            total = total + said[flag] * w(f"{flag}=1")
        return (total >= 0) & (F.greatest(*[said[v] for v in VOTES]) > 0)


#: Counts that the pooled reliabilities weigh in a kind's own: kinds with few candidates lean on the others.
_POOLED = 10.0


#: Share of the classifier's fit that goes to all vote patterns alike.
_ANY = 0.2


def _posterior(pattern: tuple, prior: tuple | list, table: dict) -> float:
    """Chance that a span with these votes is personal, given the weights of both truths in its kind."""
    odds = math.log(prior[1] / prior[0])
    odds += sum(math.log(table[pattern[0]][v][x][1] / table[pattern[0]][v][x][0]) for v, x in zip(VOTES, pattern[1:], strict=False))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def posteriors(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], dict]:
    """Expectation-maximisation over vote patterns (kind, votes...): chance that a span is personal,
    and each labeler's reliabilities for each kind. It starts from the majority vote; labelers are
    independent given the truth; a kind's reliabilities are drawn towards those over all kinds as by
    ten spans more, and these have a count of one on every vote, so chances are never 0 or 1."""
    chance = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:1 + len(VOTES)]) + 0.1)) for p in counts}
    sides = (-1, 0, 1)
    table: dict = {}
    for _ in range(rounds):
        prior = {k: [1.0, 1.0] for k in KINDS}
        seen = {k: {v: {x: [0.0, 0.0] for x in sides} for v in VOTES} for k in KINDS}
        for p, n in counts.items():
            for truth, weight in ((0, n * (1 - chance[p])), (1, n * chance[p])):
                prior[p[0]][truth] += weight
                for v, x in zip(VOTES, p[1:], strict=False):
                    seen[p[0]][v][x][truth] += weight
        for v in VOTES:
            pooled = {x: [1.0 + sum(seen[k][v][x][t] for k in KINDS) for t in (0, 1)] for x in sides}
            pooled[1][1] += 2  # a labeler is better than chance before any count
            pooled[-1][0] += 2
            whole = [sum(pooled[x][t] for x in sides) for t in (0, 1)]
            for k in KINDS:
                own = [sum(seen[k][v][x][t] for x in sides) for t in (0, 1)]
                table.setdefault(k, {})[v] = {
                    x: tuple((seen[k][v][x][t] + _POOLED * pooled[x][t] / whole[t]) / (own[t] + _POOLED) for t in (0, 1)) for x in sides}
        for p in counts:
            chance[p] = _posterior(p, prior[p[0]], table)
    return chance, table


def _encode(p: tuple) -> list[str]:
    kind, *values = p
    named = zip((*VOTES, *FLAGS), values, strict=True)
    return ["bias", f"kind={kind}", *[f"{k}={v}" for k, v in named if v], *[f"{kind},{k}={v}" for k, v in zip(VOTES, values, strict=False) if v]]


def train(counts: dict[tuple, int], steps: int = 400, l2: float = 1e-3) -> SpanModel:
    """The classifier is a logistic regression on kind, votes and flags, fitted to the posteriors of
    the label model by full gradient steps. A fixed share of the fit goes to all vote patterns alike, with
    what the label model says of them, so a vote that the counted spans never show has its weight as well."""
    if not counts:
        return SpanModel({}, {}, frozenset())
    by_votes: dict[tuple, int] = {}
    for p, n in counts.items():
        by_votes[p[:1 + len(VOTES)]] = by_votes.get(p[:1 + len(VOTES)], 0) + n
    chance, table = posteriors(by_votes)
    total = sum(counts.values())
    rows = [(_encode(p), (1 - _ANY) * n / total, chance[p[:1 + len(VOTES)]]) for p, n in sorted(counts.items())]
    every = [(k, *said) for k in KINDS for said in itertools.product((-1, 0, 1), repeat=len(VOTES))]
    prior = {k: [1.0, 1.0] for k in KINDS}
    for p, n in by_votes.items():
        prior[p[0]][0] += n * (1 - chance[p])
        prior[p[0]][1] += n * chance[p]
    rows += [(_encode((*p, *[0] * len(FLAGS))), _ANY / len(every), _posterior(p, prior[p[0]], table)) for p in every]
    weights = {f: 0.0 for fs, _, _ in rows for f in fs}
    memory = dict.fromkeys(weights, 1e-8)
    score = lambda fs: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs)))))
    for _ in range(steps):
        slope = {f: l2 * w for f, w in weights.items()}
        for fs, share, target in rows:
            error = share * (score(fs) - target)
            for f in fs:
                slope[f] += error
        for f, g in slope.items():  # steps scaled by past slopes
            memory[f] += g * g
            weights[f] -= 0.5 * g / math.sqrt(memory[f])
    model = SpanModel(table, weights, frozenset())
    return replace(model, accepted=frozenset(p for p in counts if model.personal(p)))


# -- the operator ----------------------------------------------------------------------------------------

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts without a digit, an at sign or two colons hold nothing to find and are not searched."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(text.rlike(r"[0-9@]|::|[(\[](?i:at)[)\]]"), text).otherwise("").alias("t"))


def fit_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Count the vote patterns of all candidates in ``docs`` and train on the counts."""
    found = with_spans(_texts(docs, id_col, text_col).select("t").filter("t <> ''"), "t", CANDIDATE)
    each = F.concat(*[F.transform(k, lambda s: features(k, s)) for k in CANDIDATE])
    names = ["kind", *VOTES, *FLAGS]
    counted = materialise(found.select(F.explode(each).alias("f")).select("f.*").groupBy(*names).count(), "votes")
    return train({tuple(r[n] for n in names): r["count"] for r in counted.collect()})


def find_pii(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (kind, at, stop, match), positions in code points.

    ``base`` holds the matches of the base patterns that pass their checks, ``spans`` also the
    candidates that the model accepts and that no base span of their kind touches. Both are sorted by
    kind as in KINDS, then position. A null or empty text has empty arrays; repeated rows and null
    ids come back as they are; an empty table gives no rows. Without a model one is fitted on ``docs``.
    Only the two named columns are read.
    """
    model = model or fit_spans(docs, id_col, text_col)
    patterns = {f"base_{k}": p for k, p in BASE.items()} | {f"more_{k}": p for k, p in CANDIDATE.items()}
    found = with_spans(_texts(docs, id_col, text_col), "t", patterns)
    row = lambda k, s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["at"].alias("at"), s["stop"].alias("stop"), s["match"].alias("match"))
    found = found.select("doc_id", *[F.filter(f"base_{k}", lambda s: base_valid(k, s["match"])).alias(f"base_{k}") for k in BASE],
                         *[f"more_{k}" for k in CANDIDATE])

    def accepted(kind: str) -> Column:
        def keep(s: Column) -> Column:
            free = F.lit(True)
            if kind in BASE:
                free = ~F.exists(f"base_{kind}", lambda b: (b["at"] < s["stop"]) & (s["at"] < b["stop"]))
            return free & model.score(kind, votes(kind, s))
        return F.transform(F.filter(f"more_{kind}", keep), lambda s: row(kind, s))

    base = F.concat(*[F.transform(f"base_{k}", lambda s: row(k, s)) for k in BASE])
    named = lambda a: F.transform(F.array_sort(a), lambda s: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["at"].alias("at"), s["stop"].alias("stop"), s["match"].alias("match")))
    return found.select("doc_id", base.alias("b"), *[accepted(k).alias(f"a_{k}") for k in CANDIDATE]).select(
        "doc_id", named(F.col("b")).alias("base"), named(F.concat("b", *[f"a_{k}" for k in CANDIDATE])).alias("spans"))


def spelled(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["stop"].cast("string"))), ",")
