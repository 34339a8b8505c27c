"""Personal data: candidate spans found and scored by gradient-boosted trees in Spark SQL functions only.

Four base kinds (email, ip, card, phone) are found by fixed patterns and
checks; they always stay.  High-recall generators propose further spans that
may overlap them and each other: long digit groups, written-out mail
addresses, assigned secrets, long mixed strings.  Each candidate gets format
features (length, digits, separators, variety of characters, checksum) and
context features (what stands before and after it).  Secrets and mixed
strings may have any length.  Boosted trees, trained
here on a bounded sample of candidates, score them; the threshold is
calibrated on held-out candidates; the scored trees are one SQL expression.

Labels are weak: a candidate is positive when a strict rule vouches for it
(a base kind's check, or an assignment to a name such as "token" of a long
value with letters and digits), else negative.  Of the checks only the digits'
checksum is a feature; the others are not, so what the trees learn extends to
spans no rule covers.

Spark has no function for positions of matches: a text split by a pattern and
the pattern's matches interleave, and prefix sums of their lengths are the
positions, in code points.  Patterns are possessive where that changes no
match, so very long runs take linear time.

Defined results: null and empty texts have no spans; repeated rows get equal
results; texts are searched whole; the order of spans is kind, start.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import need

LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in their order.  A leading guard stops matches from being tried inside a run already refused.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of further candidates, by kind.
GENERATORS = {
    "mail_text": rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+ ?[\[(](?:at|@)[\])] ?[a-z0-9-]{{1,63}}(?: ?[\[(](?:dot|\.)[\])] ?[a-z0-9-]{{1,63}}|\.[a-z0-9-]{{1,63}}){{1,6}}",
    "number": r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,24}+(?![0-9A-Za-z])",
    "secret": r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']? ?[=:] ?["']?[A-Za-z0-9+/_-]{12,}+["']?""",
    "code": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+",
}
GENERATORS |= {f"{k}_like": BASE[k] for k in ("ip", "card", "phone")}
#: Cheap conditions without which a pattern can't match.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ip_like": ".", "phone_like": "+"}
KINDS = [*BASE, *GENERATORS]
#: What every generator's matches contain.
TRIGGER = r"[0-9][^A-Za-z]{0,6}[0-9]|[A-Za-z0-9+/_-]{12}|(?i)[\[(](?:at|@)[\])]"
FEATURES = ("kind", "length", "digits", "letters", "upper", "separators", "groups", "variety", "luhn", "digit_before",
            "word_before", "cue_before", "quote_after", "letter_after")
CONTEXT_CHARS = 24
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
#: A feature's code is the number of its quantiles below it, at most BINS - 1.
QUANTILES = np.arange(BINS - 1) / (BINS - 1)
#: Sums are in whole steps of 1 / _STEPS; margins are compared in steps of 1 / GRID, and none reaches _TOP of them.
_STEPS, GRID = 1 << 20, 64
_TOP = GRID * (4 * TREES + 8)
#: Least precision of added spans on held-out candidates.
PRECISION = 0.98
_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even where a lambda uses it often."""
    return F.transform(F.array(value), body).getItem(0)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(lengths: Column) -> Column:
    """For each place of an array of longs, the sum of what stands before it; chunked, so long arrays stay cheap."""
    def chunked(xs: Column) -> Column:
        n_chunks = F.ceil(F.size(xs) / _CHUNK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda j: _sum(F.slice(xs, j * _CHUNK + 1, _CHUNK)))
        def spread(s: Column) -> Column:
            heads = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda j: _sum(F.slice(s, F.lit(1), j)))
            return let(heads, lambda h: F.transform(xs, lambda _, i: h[(i / _CHUNK).cast("int")]
                                                    + _sum(F.slice(xs, (i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))))
        return let(sums, spread)
    return let(lengths, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(chunked(xs)))


def find(text: Column, pattern: str, kind: str, hint: str | None = None) -> Column:
    """Matches of ``pattern``: array of (kind, start, end, value, before, after), positions in code points, end exclusive."""
    shape = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"

    def build(hits: Column) -> Column:
        def placed(parts: Column) -> Column:
            step = F.transform(hits, lambda h, i: (F.length(parts[i]) + F.length(h)).cast("long"))
            return let(sums_before(step), lambda at: F.transform(hits, lambda h, i: let(
                at[i] + F.length(parts[i]), lambda s: F.struct(
                    F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(h)).alias("end"), h.alias("value"),
                    F.right(parts[i], F.lit(CONTEXT_CHARS)).alias("before"),
                    F.left(parts[i + 1], F.lit(CONTEXT_CHARS)).alias("after")))))
        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(shape))

    none = F.array().cast(shape)
    there = text.isNotNull() if hint is None else text.contains(hint)
    return F.when(there, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)).otherwise(none)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the checksum of card numbers."""
    each = F.transform(F.split(F.reverse(only_digits(value)), ""), lambda d, i: let(
        d.cast("int") * (F.lit(1) + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0, F.lit(False))


def passes(kind: str, span: Column) -> Column:
    """The base kinds' checks."""
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(
            F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) <= 3) & F.coalesce(x.try_cast("int") <= 255, F.lit(True))))
    if kind == "card":
        return F.when(F.length(only_digits(value)).between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(only_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    check = lambda k: lambda s: passes(k, s)
    return {k: F.filter(find(text, p, k, HINTS.get(k)), check(k)) for k, p in BASE.items()}


def candidates(text: Column) -> Column:
    """All proposals of the generators; base patterns without their checks are among them."""
    some = F.when(text.rlike(TRIGGER), text)
    return F.concat(*[find(some, p, k, HINTS.get(k)) for k, p in GENERATORS.items()])


def features(span: Column) -> dict[str, Column]:
    v, before, after = span["value"], span["before"], span["after"]
    head = F.left(v, F.lit(64))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), span["kind"])
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    cue = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|account|iban|ssn|token|secret|password|key|ip|host|address)\W{0,4}$"
    return {
        "kind": kind, "length": F.length(v), "digits": digits, "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")),
        "upper": F.length(F.regexp_replace(v, "[^A-Z]", "")), "separators": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        "groups": F.size(F.split(v, "[^A-Za-z0-9]+")), "variety": F.size(F.array_distinct(F.split(head, ""))),
        "luhn": F.when(digits.between(2, 40), luhn(v)).otherwise(False), "digit_before": before.rlike("[0-9]$"),
        "word_before": before.rlike("[A-Za-z]\\W?$"), "cue_before": before.rlike(cue), "quote_after": after.rlike("^[\"']"),
        "letter_after": after.rlike("^\\W?[A-Za-z]"),
    }


def vouched(span: Column) -> Column:
    """The weak label: a strict rule holds."""
    v = span["value"]
    rules = {f"{k}_like": passes(k, span) for k in ("ip", "card", "phone")}
    rules["code"] = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & span["before"].rlike("[=:] ?[\"']?$")
    rules["secret"] = v.rlike(r"(?i)[=:] ?[\"']?(?=[a-z0-9+/_-]*[0-9])(?=[a-z0-9+/_-]*[a-z])[a-z0-9+/_-]{20,}[\"']?$")
    rules["mail_text"] = v.rlike(r"(?i)(?:dot|\.)[\])]? ?[a-z]{2,}$")
    rules["number"] = v.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$") | v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    out = F.lit(False)
    for k, ok in rules.items():
        out = F.when(span["kind"] == k, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _as_double(xs: dict[str, Column]) -> Column:
    return F.array(*[F.coalesce(xs[f].cast("double"), F.lit(0.0)) for f in FEATURES])


def _edges(quantiles: np.ndarray) -> np.ndarray:
    return np.unique(np.asarray(quantiles, dtype=float))


def _node(splits: dict[int, tuple[int, int]], codes: np.ndarray) -> np.ndarray:
    """The node (1 the root, 2i and 2i + 1 the sides of i) that each row of ``codes`` comes to."""
    at = np.ones(len(codes), np.int64)
    for i in sorted(splits):
        j, k = splits[i]
        here = np.flatnonzero(at == i)
        at[here] = 2 * i + (codes[here, j] > k)
    return at


def _margin(start: float, trees: list, codes: np.ndarray) -> np.ndarray:
    f = np.full(len(codes), start)
    for splits, values in trees:
        by_node = np.zeros(2 << DEPTH)
        by_node[list(values)] = list(values.values())
        f = f + by_node[_node(splits, codes)]
    return f


def _sums(start: float, trees: list, splits: dict, level: int, codes: np.ndarray, n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """(gradient, curvature, candidates) by node of a level, feature and code, in whole steps: the same in any order of adding."""
    q = 1 / (1 + np.exp(-_margin(start, trees, codes)))
    at = _node(splits, codes) - (1 << level)
    here = at >= 0
    width = codes.shape[1]
    cell = ((at[here, None] * width + np.arange(width)) * BINS + codes[here]).ravel()
    each = [np.rint((positive - q * n) * _STEPS), np.rint(q * (1 - q) * n * _STEPS), n]
    return np.stack([np.bincount(cell, np.repeat(v[here], width), (width * BINS) << level) for v in each]).reshape(3, 1 << level, width, BINS)


class Trees:
    """Boosted regression trees on the logistic loss.  They are grown from sums over all rows, wherever those are."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [_edges(np.quantile(x[:, j], QUANTILES)) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
        self._grow(edges, len(y), y.sum(), lambda *state: _sums(*state, codes, np.ones(len(y)), y))

    @classmethod
    def grown(cls, edges: list[np.ndarray], n: int, positive: int, sums: Callable[..., np.ndarray]) -> "Trees":
        """From ``sums(start, trees, splits, level)``, the total of ``_sums`` over all rows."""
        out = cls.__new__(cls)
        out._grow(edges, n, positive, sums)
        return out

    def _grow(self, edges, n, positive, sums):
        self.edges, p = edges, np.clip(positive / n, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        for _ in range(TREES):
            splits, values = {}, {}
            for level in range(DEPTH):
                total = sums(self.start, self.trees, splits, level)
                for i in range(1 << level):
                    node = (1 << level) + i
                    if node == 1 or node // 2 in splits:
                        self._split(node, total[:, i], splits, values)
                if not any(node >= 1 << level for node in splits):
                    break
            self.trees.append((splits, values))

    def _split(self, node: int, cells: np.ndarray, splits: dict, values: dict) -> None:
        """Split ``node`` where most is won; ``values`` gets what stays a leaf."""
        g, h = cells[0] / _STEPS, cells[1] / _STEPS
        whole = [v[0].sum() for v in (g, h, cells[2])]
        left = [v.cumsum(axis=1) for v in (g, h, cells[2])]
        right = [w - v for w, v in zip(whole, left, strict=True)]
        gain = lambda a, b: a * a / (b + 1.0)
        won = gain(left[0], left[1]) + gain(right[0], right[1]) - gain(whole[0], whole[1])
        open_ = (left[2] >= 4) & (right[2] >= 4) & (np.arange(BINS) < np.array([len(e) for e in self.edges])[:, None])
        won = np.where(open_, won, 0.0)
        value = lambda a, b: float(np.clip(RATE * a / (b + 1.0), -4, 4))
        j, k = np.unravel_index(int(np.argmax(won)), won.shape)
        if won[j, k] <= 1e-6:
            values[node] = value(whole[0], whole[1])
            return
        splits[node] = int(j), int(k)
        values.pop(node, None)
        if 2 * node >= 1 << DEPTH:
            values[2 * node], values[2 * node + 1] = (value(s[0][j, k], s[1][j, k]) for s in (left, right))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _margin(self.start, self.trees, np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1))

    def column(self, xs: Column) -> Column:
        """The margin as a SQL expression over an array of features."""
        def walk(splits, values, node) -> Column:
            if node not in splits:
                return F.lit(values[node])
            j, k = splits[node]
            return F.when(xs.getItem(j) <= float(self.edges[j][k]), walk(splits, values, 2 * node)).otherwise(walk(splits, values, 2 * node + 1))
        out = F.lit(self.start)
        for splits, values in self.trees:
            out = out + walk(splits, values, 1)
        return out


class Model:
    """Trees and the margin from which a candidate is redacted."""

    def __init__(self, trees: Trees | None, threshold: float):
        self.trees, self.threshold = trees, threshold


def _code(j: int) -> str:
    return f"shiftright(code, {4 * j}) & 15"


def _walk(splits: dict, leaf: Callable[[int], str], node: int = 1) -> str:
    """``leaf`` of the node that a coded row comes to, in SQL."""
    if node not in splits:
        return leaf(node)
    j, k = splits[node]
    return f"IF(({_code(j)}) <= {k}, {_walk(splits, leaf, 2 * node)}, {_walk(splits, leaf, 2 * node + 1)})"


def _coded_margin(start: float, trees: list) -> Column:
    return F.expr(" + ".join([f"{start!r}D", *[_walk(splits, lambda i, v=values: f"{v[i]!r}D") for splits, values in trees]]))


def _table_sums(coded: DataFrame, start: float, trees: list, splits: dict, level: int) -> np.ndarray:
    """``_sums`` of a table of coded rows: one aggregate, at most a row for each node, feature and code."""
    q = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    rows = (coded.select("*", _coded_margin(start, trees).alias("margin"), F.expr(_walk(splits, str)).alias("node")).where(F.col("node") >= 1 << level)
            .select("*", q.alias("q"))
            .select("node", F.rint((F.col("positive") - F.col("q") * F.col("n")) * _STEPS).cast("bigint").alias("g"),
                    F.rint(F.col("q") * (F.lit(1.0) - F.col("q")) * F.col("n") * _STEPS).cast("bigint").alias("h"), "n",
                    F.posexplode(F.expr(f"array({', '.join(map(_code, range(len(FEATURES))))})")).alias("j", "c")))
    out = np.zeros((3, 1 << level, len(FEATURES), BINS))
    for r in rows.groupBy("node", "j", "c").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
        out[:, r.node - (1 << level), r.j, r.c] = r.g, r.h, r.n
    return out


def labelled(df: DataFrame, text: str = "text") -> DataFrame:
    """(x, y, held, n): features and weak label of every candidate of every text, equal ones counted.

    A fifth of the candidates, chosen by hash of what they read, is held out.
    """
    s = F.col("s")
    spans = df.select(F.explode(candidates(F.col(text))).alias("s"))
    each = spans.select(_as_double(features(s)).alias("x"), vouched(s).alias("y"), (F.pmod(F.xxhash64(s["value"]), F.lit(5)) == 4).alias("held"))
    return each.groupBy("x", "y", "held").agg(F.count(F.lit(1)).alias("n"))


def fit(df: DataFrame, text: str = "text") -> Model:
    """Train on all candidates of all documents.

    Candidates with equal features are counted together, and each feature is
    coded by its quantiles over all training candidates, so trees are grown
    from sums over a table of distinct codes: one aggregate a level.  The held-out candidates set the lowest margin
    (in steps of 1 / GRID) whose precision is at least PRECISION; without such
    a margin, or without both labels, no candidate beyond the base kinds is
    redacted.
    """
    need(df, text)
    rows = cut_lineage(labelled(df.select(text), text), "candidates")
    counts = rows.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (~F.col("held"), ~F.col("held") & F.col("y"), F.col("held"))]).first()
    n, positive, held = counts
    if n + held < 40 or not 0 < positive < n or not held:
        return Model(None, float("inf"))
    values = (rows.where("NOT held").select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", "v").agg(F.sum("n").alias("n"))
              .groupBy("j").agg(F.percentile("v", [float(q) for q in QUANTILES], F.col("n")).alias("q")).collect())
    edges = [_edges(r.q) for r in sorted(values, key=lambda r: r.j)]
    above = lambda own, v: F.size(F.filter(F.array(*[F.lit(float(e)) for e in own]), lambda e: e < v)).cast("bigint")
    code = F.lit(0).cast("bigint")
    for j, own in enumerate(edges):
        code = code + F.shiftleft(above(own, F.col("x")[j]), 4 * j)
    coded = cut_lineage(rows.select(code.alias("code"), "held", "y", "n").groupBy("code", "held").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("positive")), "candidate-codes")

    trees = Trees.grown(edges, n, positive, lambda *state: _table_sums(coded.where("NOT held"), *state))
    at = F.greatest(F.floor(_coded_margin(trees.start, trees.trees) * GRID), F.lit(0)).cast("int")
    seen, right = np.zeros((2, _TOP))
    for r in coded.where("held").groupBy(at.alias("at")).agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect():
        seen[r.at], right[r.at] = r.n, r.positive
    above, right = (np.cumsum(v[::-1])[::-1] for v in (seen, right))
    good = np.flatnonzero((seen > 0) & (np.arange(_TOP) > 0) & (right >= PRECISION * above))
    return Model(trees, good[0] / GRID if len(good) else float("inf"))


def detect(df: DataFrame, model: Model, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``spans``: array of (kind, start, end), base kinds first, then accepted candidates that no base span holds."""
    need(df, text)
    found = base_spans(F.col(text))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.concat(*[F.transform(x, bare) for x in found.values()])
    if model.trees is None:
        return df.withColumn(spans, base)
    good = lambda s: let(_as_double(features(s)), lambda xs: model.trees.column(xs) >= model.threshold)
    more = F.filter(candidates(F.col(text)), lambda s: good(s))
    out = let(base, lambda b: F.concat(b, F.array_distinct(F.transform(F.array_sort(F.filter(more, lambda s: ~F.exists(
        b, lambda x: (x["start"] <= s["start"]) & (s["end"] <= x["end"]))), _by_kind), bare))))
    return df.withColumn(spans, out)


def _by_kind(a: Column, b: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]) * (1 << 40) + s["start"]
    return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0).cast("int")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``text`` where every span's characters are replaced by its kind in brackets; overlapping spans become one."""
    by_start = F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                            .when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0).cast("int"))
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] < acc["at"], longer).otherwise(new)

    rest = lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(F.col(text))))
    done = F.aggregate(by_start, first, step, rest)
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs, fit(docs))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
