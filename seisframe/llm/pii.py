"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Base patterns (e-mail, IP, card, phone) always count. High-recall generators,
two for each kind, propose further, overlapping spans: spelled or bracketed
signs, other separators, no country code, any grouping. Candidates are
described by format and context, never by a validity test or by the generator
that found them, and trees boosted on log loss score them.

No table has span labels. Positives are the base spans of all documents,
described as they would look in damaged form (``damaged``: signs
spelled out, separators changed, prefix dropped) in their own context; what
the generators propose elsewhere in these documents is unlabelled and counts
as negative, so a candidate is added only if its format and context are those
of real spans. A held-out fold calibrates, for each kind, the lowest score
from which on at least ``PRECISION`` of all candidates are positives.

Everything that touches a text is a DataFrame expression, and all steps are
linear (or n log n) in a text's spans. The driver fits the trees on a tally of
all candidates by their small, integer features.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans. Guards in front let a search skip the inside
# of a run it has already failed on, and possessive loops neither backtrack nor
# recurse on very long runs; they don't change what is found, but that card also
# matches single digits, which its test drops.
_RUN, _DIGIT = r"(?:(?<![A-Za-z0-9._%+-])|\G)", r"(?:(?<![0-9])|\G)"
BASE = {
    "email": _RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _DIGIT + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: two for each kind, whose spans may overlap.
LOOSE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[\.\]|\[dot\]|\(dot\)|\{dot\}|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}){1,8}",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|(?<= )dot(?= )) ?[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9])[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}(?![0-9])",
    ),
    "card": (
        r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,19}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2,3}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,6}\)?){1,6}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])(?:\+|0)[0-9]{8,14}(?![0-9A-Za-z])",
    ),
}
_OCTET = r"0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: What announces a kind, near the end of the text before a span.
CUES = (
    r"(mail|contact|kontakt|correo|courriel|write|reach)[^0-9]{0,12}$",
    r"(tel|phone|call|fax|mobil|handy|whatsapp|ruf)[^0-9]{0,12}$",
    r"(card|visa|master|amex|carte|tarjeta|karte|credit|kredit)[^0-9]{0,12}$",
    r"(host|server|addr|adress|\bip|login|ping)[^0-9]{0,12}$",
)

#: Boosting rounds, step, and the precision at which a kind's threshold is set.
ROUNDS, STEP, PRECISION = 16, 0.4, 0.9
FEATURES = ("digits", "letters", "signs", "groups", "opens", "cue", "edges", "length", "mark")
#: Characters of context before a candidate, and of the parts that a redacted text is put together from.
CONTEXT, PART = 24, 256
SPAN = "struct<s:int,e:int,t:string,b:string,a:string>"


def _with(test: Callable[..., Column], *fixed) -> Callable[[Column], Column]:
    """A one-argument lambda for a higher-order function."""
    return lambda x: test(x, *fixed)


def running(values: Column, combine: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """Running totals of an array under an associative operation, by doubling: each step combines values twice as far apart."""

    def step(a: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(F.concat(F.array_repeat(nothing, far), F.slice(a, F.lit(1), F.size(a) - far)), a, combine)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
    return F.when(F.size(values) > 1, F.aggregate(steps, values, step)).otherwise(values)


def running_sum(values: Column) -> Column:
    return running(values, lambda x, y: x + y, F.lit(0))


def running_max(values: Column) -> Column:
    return running(values, lambda x, y: F.greatest(x, y), F.lit(-1))


def _apart(spans: Column, fixed: Column) -> Column:
    """The spans that overlap none of ``fixed``, which don't overlap each other.

    All ends of spans and starts of fixed ones are sorted together; a span is
    apart if no fixed one that starts before its end ends after its start.
    """
    none = F.lit(None).cast(SPAN)
    ends = F.transform(spans, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("fixed"), F.lit(-1).alias("end"), x.alias("x")))
    starts = F.transform(fixed, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("fixed"), x["e"].alias("end"), none.alias("x")))
    events = F.sort_array(F.concat(ends, starts))
    kept = F.zip_with(events, running_max(F.transform(events, lambda v: v["end"])), lambda v, end: F.when((v["fixed"] == 0) & (end <= v["x"]["s"]), v["x"]))
    return F.when((F.size(spans) == 0) | (F.size(fixed) == 0), spans).otherwise(F.filter(kept, lambda x: x.isNotNull()))


def _once(name: str) -> Column:
    """The different spans of a sorted array."""

    def new(x: Column, i: Column) -> Column:
        last = F.get(name, i - 1)
        return (i == 0) | (x["s"] != last["s"]) | (x["e"] != last["e"])

    return F.filter(name, new)


def _before(values: Column) -> Column:
    """Each place's running maximum of the values before it, -1 for the first."""
    return F.concat(F.array(F.lit(-1)), F.slice(running_max(values), F.lit(1), F.size(values) - 1))


def _foremost(spans: Column) -> Column:
    """The spans that no other overlaps that starts earlier, or there and is longer; equal ones once."""
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x.alias("x"))))
    kept = F.zip_with(order, _before(F.transform(order, lambda v: -v["back"])), lambda v, end: F.when(end <= v["s"], v["x"]))
    return F.when(F.size(spans) < 2, spans).otherwise(F.filter(kept, lambda x: x.isNotNull()))


def luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _octets(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\[dot\]|\(\.\)|\[\.\]", "."), " ", "").rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.lit(True),
    "ip": _octets,
    "card": lambda t: F.when(_between(F.length(_digits(t)), 13, 19), luhn(_digits(t))).otherwise(False),
    "phone": lambda t: _between(F.length(_digits(t)), 9, 15),
}


def _guard(kind: str, loose: bool) -> Column:
    """False only where the pattern can't match."""
    text = F.col("__text")
    if kind != "email":
        return text.contains("+") if kind == "phone" and not loose else text.rlike("[0-9]")
    return text.contains("@") if not loose else text.rlike(r"@|[\[({]at[\])}]| at ")


def _located(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add, for each name, the array of SPANs of its pattern's leftmost non-overlapping matches: start, end (code points), text, and the context on both sides."""
    text = F.col("__text")
    none, spans = F.array().cast("array<string>"), F.array().cast(f"array<{SPAN}>")
    rows = rows.withColumns({f"{n}_m": F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, (p, guard) in patterns.items()})
    rows = rows.withColumns({f"{n}_g": F.when(F.size(f"{n}_m") > 0, F.split(text, p, -1)).otherwise(none) for n, (p, _) in patterns.items()})
    steps = {n: F.zip_with(F.slice(f"{n}_g", F.lit(1), F.size(f"{n}_m")), F.col(f"{n}_m"), lambda g, m: F.length(g) + F.length(m)) for n in patterns}
    rows = rows.withColumns({f"{n}_e": F.when(F.size(f"{n}_m") > 0, running_sum(steps[n])).otherwise(F.array().cast("array<int>")) for n in patterns})

    def span(m: Column, i: Column, n: str) -> Column:
        gaps, matches, end = F.col(f"{n}_g"), F.col(f"{n}_m"), F.get(f"{n}_e", i)
        near = lambda k: F.right(F.coalesce(k, F.lit("")), F.lit(CONTEXT))
        first = lambda k: F.left(F.coalesce(k, F.lit("")), F.lit(2))
        before = F.right(F.concat(near(F.when(i > 0, F.get(matches, i - 1))), near(F.get(gaps, i))), F.lit(CONTEXT))
        after = F.left(F.concat(first(F.get(gaps, i + 1)), first(F.get(matches, i + 1))), F.lit(2))
        return F.struct((end - F.length(m)).alias("s"), end.alias("e"), m.alias("t"), before.alias("b"), after.alias("a"))

    def placed(n: str) -> Column:
        return F.transform(f"{n}_m", lambda m, i: span(m, i, n))

    rows = rows.withColumns({n: F.when(F.size(f"{n}_m") > 0, placed(n)).otherwise(spans) for n in patterns})
    return rows.drop(*(f"{n}_{x}" for n in patterns for x in "mge"))


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __text, and for each kind base_<kind> (valid base spans) and more_<kind> (other candidates, which may overlap)."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    loose = {f"__l{i}_{k}": (p, _guard(k, True)) for k in KINDS for i, p in enumerate(LOOSE[k])}
    rows = _located(rows, {f"__b_{k}": (BASE[k], _guard(k, False)) for k in KINDS} | loose)
    rows = rows.withColumns({f"base_{k}": F.filter(f"__b_{k}", _with(lambda x, k: VALID[k](x["t"]), k)) for k in KINDS})
    # a base match that fails its test is a candidate like others, if it is no single digit
    found = {f"__c_{k}": F.sort_array(F.concat(*(F.col(n) for n in loose if n.endswith(k)), F.filter(f"__b_{k}", lambda x: F.length(x["t"]) > 6))) for k in KINDS}
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"__c_{k}": _once(f"__c_{k}") for k in KINDS})
    rows = rows.withColumns({f"more_{k}": _apart(F.col(f"__c_{k}"), F.col(f"base_{k}")) for k in KINDS})
    rows = rows.drop(*loose, *(f"__{x}_{k}" for x in "bc" for k in KINDS))
    # filters on results are not pushed below this node; they would repeat all expressions above many times over
    return rows.observe(f"spans-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("documents"))


def features(t: Column, before: Column, after: Column) -> list[Column]:
    """Small integers that describe a candidate's format and context, in the order of FEATURES."""
    low = F.lower(before)
    cue = F.coalesce(*(F.when(low.rlike(p), F.lit(i)) for i, p in enumerate(CUES, 1)), F.lit(0))
    mark = F.when(before.rlike(r"[:=(<\"'] ?$"), 1).when(before.rlike(r"[#$€£%] ?$"), 2).when(after.rlike(r"^ ?[$€£%]"), 3).otherwise(0)
    opens = F.when(t.startswith("+"), 1).when(t.startswith("("), 2).when(t.startswith("00"), 3).when(t.startswith("0"), 4).otherwise(0)
    return [
        F.least(F.length(_digits(t)), F.lit(20)),
        F.least(F.floor(F.length(F.regexp_replace(t, "[^A-Za-z]", "")) / 2).cast("int"), F.lit(15)),
        F.least(F.length(F.regexp_replace(t, "[0-9A-Za-z ]", "")), F.lit(9)),
        F.least(F.length(F.regexp_replace(F.regexp_replace(t, "[0-9A-Za-z]+", "x"), "[^x]", "")), F.lit(9)),
        opens,
        cue,
        before.rlike("[0-9A-Za-z]$").cast("int") + 2 * after.rlike("^[0-9A-Za-z]").cast("int"),
        F.least(F.floor(F.length(t) / 4), F.lit(15)).cast("int"),
        mark,
    ]


def damaged(kind: str, t: Column) -> Column:
    """A base span as it would look in another form; which one follows from its text."""
    form = F.pmod(F.xxhash64(t), F.lit(4))

    def first(*changes: Column) -> Column:
        out = changes[-1]
        for k in range(len(changes) - 2, -1, -1):
            out = F.when(form == k, changes[k]).otherwise(out)
        return out

    sub = lambda x, a, b: F.regexp_replace(x, a, b)
    if kind == "email":
        return first(sub(sub(t, "@", " at "), r"\.", " dot "), sub(sub(t, "@", " [at] "), r"\.", " [dot] "), sub(t, "@", "(at)"), sub(t, "@", " at "))
    if kind == "ip":
        return first(sub(t, r"\.", "[.]"), sub(t, r"\.", " dot "), sub(t, r"\.", "-"), sub(t, r"\.", ","))
    if kind == "card":
        digits = _digits(t)
        return first(sub(digits, r"(....)(?=.)", "$1."), sub(digits, r"(....)(?=.)", "$1/"), sub(digits, r"(....)(?=.)", "$1  "), digits)
    local = sub(t, r"^\+[0-9]{1,2}[ .-]*", "")
    plain = sub(local, "[()]", "")
    return first(sub(t, r"^\+", "00"), local, sub(plain, "[ .-]+", "."), sub(plain, "[ .-]+", " "))


@dataclass(frozen=True)
class Tree:
    """Depth two: a test, and a test below each side."""

    feature: int
    cut: int
    below: tuple[tuple[int, int, float, float], tuple[int, int, float, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        sides = [np.where(x[:, f] <= c, a, b) for f, c, a, b in self.below]
        return np.where(x[:, self.feature] <= self.cut, *sides)

    def column(self, x: list[Column]) -> Column:
        sides = [F.when(x[f] <= c, F.lit(a)).otherwise(F.lit(b)) for f, c, a, b in self.below]
        return F.when(x[self.feature] <= self.cut, sides[0]).otherwise(sides[1])


@dataclass(frozen=True)
class KindModel:
    bias: float
    trees: tuple[Tree, ...]
    #: None: no candidate is ever added
    threshold: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.score(x) for t in self.trees), np.zeros(len(x)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, float, float]:
    """Best (gain, feature, cut, value at or below, value above) for gradients g and curvatures h."""
    leaf = lambda gs, hs: gs / (hs + 1.0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    best = (0.0, 0, 1 << 30, STEP * leaf(g.sum(), h.sum()), 0.0)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= c
            a, b, p, q = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            gain = a * a / (b + 1.0) + p * p / (q + 1.0) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, int(c), STEP * leaf(a, b), STEP * leaf(p, q))
    return best


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = ROUNDS) -> tuple[float, tuple[Tree, ...]]:
    """Trees on log loss for rows of n candidates each, of which ``positive`` are."""
    rate = np.clip(positive.sum() / max(1, n.sum()), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    score, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - n * p, n * p * (1 - p)
        _, feature, cut, _, _ = _split(x, g, h)
        low = x[:, feature] <= cut
        below = []
        for side in (low, ~low):
            below.append(_split(x[side], g[side], h[side])[1:] if side.any() else (0, 1 << 30, 0.0, 0.0))
        trees.append(Tree(feature, cut, tuple((int(f), int(c), float(a), float(b)) for f, c, a, b in below)))
        score = score + trees[-1].score(x)
    return bias, tuple(trees)


def calibrated(score: np.ndarray, n: np.ndarray, positive: np.ndarray, precision: float = PRECISION) -> float | None:
    """The lowest score from which on candidates are positive at the given rate, one negative more than seen supposed; None if there is none."""
    best = None
    for s in np.unique(score)[::-1]:
        at = score >= s
        if positive[at].sum() >= precision * (n[at].sum() + 1):
            best = float(s)
    return best


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_col, __id) of all documents; __id is a hash of id and text, which deals them to folds."""
    return docs.select(F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__id"))


def train(rows: DataFrame) -> dict[str, KindModel]:
    """Fit all kinds on the tally of candidates of ``spans``' result."""
    fold = F.pmod("__id", F.lit(5)) == 0

    def one(c: Column, k: str, y: int) -> Column:
        x = features(damaged(k, c["t"]) if y else c["t"], c["b"], c["a"])
        return F.struct(F.lit(k).alias("kind"), F.lit(y).alias("y"), *(v.alias(n) for v, n in zip(x, FEATURES, strict=True)))

    marked = F.concat(*(F.transform(f"{x}_{k}", _with(one, k, y)) for k in KINDS for x, y in (("base", 1), ("more", 0))))
    # an outer explode: for an inner one Spark would infer a filter that evaluates all patterns once more
    each = rows.select(fold.alias("fold"), F.explode_outer(marked).alias("c")).where("c.kind is not null").select("fold", "c.*")
    tally = each.groupBy("kind", "fold", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive")).collect()  # feature combinations, bounded by the ranges of the features
    models = {}
    for k in KINDS:
        own = sorted((r for r in tally if r["kind"] == k), key=lambda r: tuple(r))
        table = np.array([[r[f] for f in (*FEATURES, "n", "positive", "fold")] for r in own], dtype=np.int64).reshape(len(own), len(FEATURES) + 3)
        x, n, positive, held = table[:, : len(FEATURES)], table[:, -3], table[:, -2], table[:, -1] == 1
        if not positive[~held].sum():
            models[k] = KindModel(0.0, (), None)
            continue
        bias, trees = boost(x[~held], n[~held], positive[~held])
        score = KindModel(bias, trees, None).score(x)
        models[k] = KindModel(bias, trees, calibrated(score[held], n[held], positive[held]))
    return models


def fitted(docs: DataFrame, id_col: str, text_col: str) -> dict[str, KindModel]:
    return train(spans(numbered(docs, id_col, text_col), text_col))


def found(rows: DataFrame, models: dict[str, KindModel]) -> DataFrame:
    """Add added_<kind> to ``spans``' result: candidates that reach the threshold; of overlapping ones the first and longest."""
    added = {}
    for k in KINDS:
        model = models[k]
        if model.threshold is None:
            added[f"added_{k}"] = F.array().cast(f"array<{SPAN}>")
            continue

        def described(c: Column) -> Column:
            return F.struct(c.alias("c"), *(v.alias(n) for v, n in zip(features(c["t"], c["b"], c["a"]), FEATURES, strict=True)))

        def good(x: Column, model: KindModel) -> Column:
            total = F.lit(model.bias)
            for tree in model.trees:
                total = total + tree.column([x[n] for n in FEATURES])
            return total >= model.threshold - 1e-9

        chosen = F.filter(F.transform(f"more_{k}", described), _with(good, model))
        added[f"added_{k}"] = F.when(F.size(f"more_{k}") > 0, F.transform(chosen, lambda x: x["c"])).otherwise(F.col(f"more_{k}"))
    rows = rows.withColumns(added)
    return rows.withColumns({f"added_{k}": _foremost(F.col(f"added_{k}")) for k in KINDS})


def _listed(parts: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""
    each = (F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["s"], x["e"]))), _with(lambda x, k: F.concat_ws(":", F.lit(k), x["s"], x["e"]), k)) for k, a in parts)
    return F.concat_ws(",", F.flatten(F.array(*each)))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Null text counts as empty: no spans. Rows with a null or repeated id are
    treated like others; columns besides id and text are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = found(spans(docs), fitted(docs, "doc_id", "text"))
    return rows.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed([(k, F.col(f"base_{k}")) for k in KINDS]), 256).alias("base_sha256"),
        _listed([(k, F.concat(f"base_{k}", f"added_{k}")) for k in KINDS]).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones together) replaced by [EMAIL], [IP], [CARD] or [PHONE]; the first kind names the whole. A column n_chars follows the new text."""
    names = docs.columns
    rows = found(spans(docs, text_col), fitted(docs, id_col, text_col))
    every = F.sort_array(F.flatten(F.array(*(F.transform(F.concat(f"base_{k}", f"added_{k}"), _with(lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k.upper()).alias("k")), k)) for k in KINDS))))
    rows = rows.withColumn("__all", every)
    # where a span begins that none before it reaches, a run of overlapping spans begins; the run before it ends where the spans before it do
    begun = F.zip_with("__all", _before(F.col("__all")["e"]), lambda x, end: F.when(end <= x["s"], F.struct(x["s"].alias("s"), end.alias("end"), x["k"].alias("k"))))
    rows = rows.withColumn("__runs", F.when(F.size("__all") > 0, F.filter(begun, lambda x: x.isNotNull())))
    # a piece is put together from short parts of the text, so that none is counted off from the text's beginning
    rows = rows.withColumn("__parts", F.when(F.size("__all") > 0, F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        parts = F.transform(F.sequence(F.floor(a / PART), F.floor((b - 1) / PART)), lambda i: F.get("__parts", i.cast("int")))
        return F.when(a < b, F.substring(F.array_join(parts, ""), a % PART + 1, b - a)).otherwise("")

    kept = F.transform("__runs", lambda x: F.concat(piece(F.greatest(x["end"], F.lit(0)), x["s"]), F.lit("["), x["k"], F.lit("]")))
    new = F.concat(F.array_join(kept, ""), piece(F.array_max(F.col("__all")["e"]), F.length("__text")))
    rows = rows.withColumn(text_col, F.when(F.size("__all") > 0, new).otherwise(F.col(text_col)))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.size("__all") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*names)
