"""Personal data in texts: certain patterns, and spans that boosted trees add to them.

Generators of high recall propose spans that may overlap. A candidate's features, of its format and of its
context, take few values each, so all candidates of the corpus are counted on a grid of bounded size, and
the trees are fitted to the counts. A candidate counts as positive if a certain span of its kind meets it; no feature
tells what makes a span certain (the plus sign, the at sign, single separators), so forms that the patterns miss score
like those they catch. A fifth of the candidates, by a hash of their text, is held out: it calibrates
the scores and sets each kind's threshold. Main path: column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Quantifiers are possessive and starts are bound to the beginning of a run where that finds
#: the same spans, so a long run of one class is read once, not once for each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What proposes candidates.
PROPOSED = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+(?:\s?(?:@|\(at\)|\[at\]|\{at\})\s?[\p{L}\p{N}-]{1,63}+"
    r"(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?| dot )[\p{L}\p{N}-]{1,63}+)++| at [\p{L}\p{N}-]{1,63}+(?: dot [\p{L}\p{N}-]{1,63}+)++)",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\s?[.,:-]\s?[0-9]{1,3}+){3,7}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}+[0-9]){11,22}+(?![0-9])",
    "phone": r"(?<![0-9+])\+?\(?[0-9](?:[ ()./-]{0,3}+[0-9]){6,17}+(?![0-9])",
}
#: Words before a span that speak for its kind.
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|login|adress|address",
    "card": "card|visa|master|karte|carte|tarjeta|pay",
    "phone": "tel|phone|call|fax|mobil|whatsapp|numéro|nummer",
}
#: The features and how many values each has: the grid has 36,864 cells a kind.
FEATURES = {"before": 4, "after": 4, "cue": 2, "digits": 8, "runs": 6, "valid": 2, "distinct": 3, "marks": 4}
HELD_OUT = 5
TREES, DEPTH, RATE, RIDGE = 24, 3, 0.3, 1.0
#: Of the held-out candidates at or above a kind's threshold, so many must be positive.
PRECISION = 0.95


def _scan(a: Column, size: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Prefix sums (or maxima) of an array by doubling: as many rounds as its size has bits."""
    rounds = F.when(size > 1, F.sequence(F.lit(0), F.ceil(F.log2(size.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    shifted = lambda acc, r: F.concat(F.array_repeat(zero, F.pow(F.lit(2), r).cast("int")), acc)
    return F.aggregate(rounds, a, lambda acc, r: F.slice(F.zip_with(acc, shifted(acc, r), op), 1, size))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 30 digits pass Luhn's check; the digits of a doubled digit add up as the table says."""
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    add = lambda acc, i: acc + F.substr(F.when(i % 2 == 0, twice).otherwise(back), i, F.lit(1)).cast("int")
    return F.length(digits).between(1, 30) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


_OCTETS = r"^\D*(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\D+|$)){4}$"


def _certain(kind: str, hit: Column) -> Column:
    """Whether a hit of a base pattern holds."""
    if kind == "ip":
        return hit.rlike(_OCTETS)
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _beside(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _features(kind: str, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    digits = _digits(hit)
    n = F.length(digits)
    runs = F.size(F.split(F.trim(F.regexp_replace(hit, "[^0-9]+", " ")), " "))
    valid = {"card": _luhn(digits), "ip": hit.rlike(_OCTETS), "phone": n.between(9, 15), "email": hit.rlike(r"[A-Za-z]{2,24}$")}[kind]
    kinds = F.size(F.array_distinct(F.split(digits, "")))
    marks = (
        F.when(hit.rlike(r"[()]"), 3).when(hit.rlike(r"^\+?[0-9.]*$") & F.contains(hit, F.lit(".")), 1).when(hit.rlike(r"^\+?[0-9]*$"), 0).otherwise(2)
        if kind != "email" else F.least(F.size(F.split(F.regexp_replace(hit, r"[^._+-]", ""), "")) - 1, F.lit(3))
    )
    return {
        "before": _beside(F.right(before, F.lit(1))),
        "after": _beside(F.left(after, F.lit(1))),
        "cue": F.lower(before).rlike(CUES[kind]).cast("int"),
        "digits": F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 13, 3).when(n < 16, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7),
        "runs": F.least(runs, F.lit(5)),
        "valid": valid.cast("int"),
        "distinct": F.when(kinds < 2, 0).when(kinds < 5, 1).otherwise(2),
        "marks": F.greatest(marks, F.lit(0)),
    }


_SPAN = "array<struct<start:bigint,stop:bigint>>"


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, base_<kind>, cand_<kind>): the certain spans and the candidates of each text, by column expressions alone.
    Lengths are of code points. The gaps between the hits give their places, so a text is read as often as there are patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    patterns = [(f"base_{k}", BASE[k], k) for k in KINDS] + [(f"cand_{k}", PROPOSED[k], k) for k in KINDS]
    needs = {"base_email": "@", "base_phone": "+"}
    has_digit = F.col("text").rlike("[0-9]")

    def guarded(name: str, found: Column) -> Column:
        may = F.contains("text", F.lit(needs[name])) if name in needs else has_digit if name != "cand_email" else F.col("text").rlike(r"@|[(\[{]at|\bat ")
        return F.when(may, found).otherwise(F.array().cast("array<string>"))

    rows = rows.select("doc_id", *[c for name, p, _ in patterns for c in (
        guarded(name, F.split("text", p, -1)).alias(f"{name}_gaps"), guarded(name, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"{name}_hits"))])
    n = {name: F.size(f"{name}_hits") for name, _, _ in patterns}
    first = lambda name: F.slice(f"{name}_gaps", 1, n[name])
    steps = [F.zip_with(first(name), f"{name}_hits", lambda g, h: (F.length(g) + F.length(h)).cast("long")).alias(f"{name}_steps") for name, _, _ in patterns]
    around = [
        F.zip_with(first(name), F.slice(f"{name}_gaps", 2, n[name]), lambda b, a: F.struct(F.right(b, F.lit(24)).alias("before"), F.left(a, F.lit(4)).alias("after"))).alias(f"{name}_around")
        for name, _, _ in patterns if name.startswith("cand")
    ]
    rows = rows.select("doc_id", *[f"{name}_hits" for name, _, _ in patterns], *steps, *around)
    ends = [_scan(F.col(f"{name}_steps"), n[name], lambda x, y: x + y, F.lit(0).cast("long")).alias(f"{name}_ends") for name, _, _ in patterns]
    rows = rows.select("doc_id", *[c for c in rows.columns if c.endswith(("_hits", "_around"))], *ends)

    def base(name: str, kind: str) -> Column:
        found = F.zip_with(f"{name}_ends", f"{name}_hits", lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("stop"), _certain(kind, h).alias("holds")))
        return F.transform(F.filter(found, lambda s: s["holds"]), lambda s: F.struct(s["start"], s["stop"])).cast(_SPAN).alias(name)

    def candidates(name: str, kind: str) -> Column:
        found = F.zip_with(F.zip_with(f"{name}_ends", f"{name}_hits", lambda e, h: F.struct(e.alias("e"), h.alias("h"))), f"{name}_around", lambda s, c: F.struct(s["e"].alias("e"), s["h"].alias("h"), c.alias("c")))

        def described(s: Column) -> Column:
            values = _features(kind, s["h"], s["c"]["before"], s["c"]["after"])
            held = F.pmod(F.xxhash64(s["h"]), F.lit(HELD_OUT)) == 0
            return F.struct((s["e"] - F.length(s["h"])).alias("start"), s["e"].alias("stop"), held.alias("held"), *[v.cast("tinyint").alias(f) for f, v in values.items()])

        return F.transform(found, described).alias(name)

    return rows.select("doc_id", *[base(name, k) if name.startswith("base") else candidates(name, k) for name, _, k in patterns])


def _met(rows: DataFrame, asked: str, spans: str, out: str) -> DataFrame:
    """``out``: for each span of the array ``asked`` whether one of ``spans`` meets it. Both are merged by start; prefix maxima
    of the ends and suffix minima of the starts of ``spans`` decide, so long arrays cost their size times its bits."""
    mark = lambda name, tag: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(tag).alias("asked"), s["stop"].alias("stop")))
    least, most = F.lit(-1).cast("long"), F.lit(2**62).cast("long")
    kept = [c for c in rows.columns if c != out]
    rows = rows.select(*kept, F.array_sort(F.concat(mark(spans, 0), mark(asked, 1))).alias("m"))
    rows = rows.select(
        *kept, "m", F.transform("m", lambda s: F.when(s["asked"] == 0, s["stop"]).otherwise(least)).alias("ends"),
        F.reverse(F.transform("m", lambda s: F.when(s["asked"] == 0, s["start"]).otherwise(most))).alias("starts"),
    )
    n = F.size("m")
    rows = rows.select(*kept, "m", _scan(F.col("ends"), n, lambda x, y: F.greatest(x, y), least).alias("reach"), F.reverse(_scan(F.col("starts"), n, lambda x, y: F.least(x, y), most)).alias("next"))
    told = F.zip_with(F.zip_with("m", "reach", lambda s, r: F.struct(s.alias("s"), r.alias("r"))), "next", lambda p, x: F.struct(
        p["s"]["asked"].alias("asked"), ((p["r"] > p["s"]["start"]) | (x < p["s"]["stop"])).alias("met")))
    return rows.select(*kept, F.transform(F.filter(told, lambda t: t["asked"] == 1), lambda t: t["met"]).alias(out))


@dataclass(frozen=True)
class Model:
    """Boosted trees of one kind: each a nested (feature, cut, left, right) or a number; ``slope`` and ``shift`` calibrate."""

    trees: tuple
    slope: float
    shift: float
    threshold: float

    def probability(self, of: Callable[[str], Column]) -> Column:
        total = F.lit(self.shift)
        for tree in self.trees:
            total = total + _branch(tree, of) * self.slope
        return 1 / (1 + F.exp(-total))


def _branch(tree: tuple | float, of: Callable[[str], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, cut, low, high = tree
    return F.when(of(name) <= cut, _branch(low, of)).otherwise(_branch(high, of))


def _grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple | float:
    """A tree of second-order boosting on cells with gradients ``g`` and curvatures ``h``."""
    worth = lambda a, b: a * a / (b + RIDGE)
    best = (1e-6, None, None)
    if depth and len(x):
        for f, (_, size) in enumerate(FEATURES.items()):
            gs, hs = np.cumsum(np.bincount(x[:, f], g, size)), np.cumsum(np.bincount(x[:, f], h, size))
            gain = worth(gs, hs) + worth(gs[-1] - gs, hs[-1] - hs) - worth(gs[-1], hs[-1])
            cut = int(np.argmax(gain[:-1]))
            if gain[cut] > best[0]:
                best = (gain[cut], f, cut)
    if best[1] is None:
        return float(-RATE * g.sum() / (h.sum() + RIDGE))
    low = x[:, best[1]] <= best[2]
    return (list(FEATURES)[best[1]], best[2], _grown(x[low], g[low], h[low], depth - 1), _grown(x[~low], g[~low], h[~low], depth - 1))


def _value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    low = x[:, list(FEATURES).index(tree[0])] <= tree[1]
    return np.where(low, _value(tree[2], x), _value(tree[3], x))


def fit_cells(x: np.ndarray, bad: np.ndarray, good: np.ndarray, held_bad: np.ndarray, held_good: np.ndarray) -> Model:
    """The model of counts by cell. Without a positive on either side nothing is ever selected."""
    never = Model((), 0.0, -50.0, 2.0)
    if not good.sum() or not held_good.sum():
        return never
    score, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grown(x, p * (bad + good) - good, p * (1 - p) * (bad + good), DEPTH)
        trees.append(tree)
        score = score + _value(tree, x)
    slope, shift = 1.0, 0.0
    total = held_bad + held_good
    for _ in range(30):  # Platt's logistic fit, with one candidate of each sort added at score 0
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -30, 30)))
        w = total * p * (1 - p)
        grad = np.array([((p * total - held_good) * score).sum() + 1e-3 * (slope - 1), (p * total - held_good).sum() + 1e-3 * shift])
        hess = np.array([[(w * score**2).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    if slope <= 0:
        return never
    p = 1 / (1 + np.exp(-(slope * score + shift)))
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum(held_good[order]), np.cumsum(total[order])
    last = np.append(p[order][1:] < p[order][:-1], True)  # cells of one probability stand or fall together
    fine = last & (hit >= PRECISION * np.maximum(all_, 1)) & (p[order] >= 0.5)
    if not fine.any():
        return never
    at = np.flatnonzero(fine)[-1]  # the threshold lies midway to the next cell, by log odds
    logit = lambda q: float(np.log(q / (1 - q)))
    least = max(p[order][at + 1], 0.5) if at + 1 < len(p) else 0.5
    middle = (logit(np.clip(p[order][at], 1e-12, 1 - 1e-12)) + logit(np.clip(least, 1e-12, 1 - 1e-12))) / 2
    return Model(tuple(trees), float(slope), float(shift), float(1 / (1 + np.exp(-middle))))


def fit(found: DataFrame) -> dict[str, Model]:
    """A model a kind, fitted to all candidates of ``found``. What reaches the driver are counts on
    the grid: at most 36,864 cells a kind, whatever the corpus."""
    models = {}
    for kind in KINDS:
        rows = _met(found.select(f"cand_{kind}", f"base_{kind}"), f"cand_{kind}", f"base_{kind}", "met")
        flat = rows.where(F.size(f"cand_{kind}") > 0).select(F.explode(F.zip_with(f"cand_{kind}", "met", lambda c, m: F.struct(c.alias("c"), m.alias("y")))).alias("r"))
        keys = [F.col(f"r.c.{f}").alias(f) for f in FEATURES]
        one = lambda held, y: F.sum(((F.col("r.c.held") == held) & (F.col("r.y") == y)).cast("long"))
        cells = flat.groupBy(*keys).agg(one(False, False).alias("a"), one(False, True).alias("b"), one(True, False).alias("c"), one(True, True).alias("d"))
        cells = sorted(tuple(c) for c in cells.collect())
        grid = np.array(cells, dtype=np.int64).reshape(len(cells), len(FEATURES) + 4)
        k = len(FEATURES)
        models[kind] = fit_cells(grid[:, :k], *(grid[:, k + i].astype(float) for i in range(4)))
    return models


def select(found: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(doc_id, base_<kind>, more_<kind>): of the candidates that no certain span meets, and whose format is valid (a domain that
    ends in letters, parts of at most 255, Luhn, 9 to 15 digits), those at or above their kind's threshold; of selected candidates that meet each other, the one of the kind that is listed first."""
    rows = found.withColumn("taken", F.array_sort(F.concat(*[f"base_{k}" for k in KINDS])))
    for kind in KINDS:
        m = models[kind]
        rows = _met(rows, f"cand_{kind}", "taken", "met")
        free = F.filter(F.zip_with(f"cand_{kind}", "met", lambda c, b: F.struct(c.alias("c"), b.alias("b"))), lambda r: ~r["b"])
        chosen = F.filter(free, lambda r: (r["c"]["valid"] == 1) & (m.probability(lambda f: r["c"][f]) >= m.threshold)) if m.trees else F.slice(free, 1, 0)
        rows = rows.withColumn(f"more_{kind}", F.transform(chosen, lambda r: F.struct(r["c"]["start"].alias("start"), r["c"]["stop"].alias("stop"))).cast(_SPAN))
        rows = rows.withColumn("taken", F.concat("taken", f"more_{kind}"))
    return rows.select("doc_id", *[f"base_{k}" for k in KINDS], *[f"more_{k}" for k in KINDS])


def _written(kinds: Sequence[str], name: Callable[[str], Column]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(name(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in kinds]), ",")


def find(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (certain spans), n_added, base_sha256, spans.

    A null or empty text has no span: counts of 0, the hash of the empty string, empty ``spans``. Rows are independent, so null and
    repeated doc_ids each keep their row, and other columns take no part, whatever their names. Texts
    are read whole. An empty table, or one without certain spans of a kind, fits nothing and adds nothing. Spans (without
    texts) are written once to the shared folder, where the result is read from."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.put(spans_of(docs), "spans")
    try:
        rows = select(found, fit(found))
    except BaseException:
        scratch.clear()
        raise
    both = lambda k: F.array_sort(F.concat(f"base_{k}", f"more_{k}"))
    return rows.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        sum((F.size(f"more_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_added"),
        F.sha2(_written(KINDS, lambda k: F.col(f"base_{k}")), 256).alias("base_sha256"), _written(KINDS, both).alias("spans"),
    )
