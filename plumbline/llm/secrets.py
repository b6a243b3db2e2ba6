"""Secret scans: patterns of known kinds, and character Markov models for random strings.

Base kinds are patterns, found from left to right without overlaps, each kind on its own. The model adds strings that
no pattern names: runs of RUN or more characters of ALPHABET that overlap no base span, whose log-likelihood ratio under
two first-order Markov models of characters, one of random strings and one of ordinary identifiers, is at least LEAST.

The models are trained from a labelled sample: in about SAMPLE documents (all, if there are fewer; picked by a hash of the
text) the values in base spans are random strings, and words of letters, digits and underscores are ordinary ones. The
counts are added up in Spark; the driver gets one number per pair of characters, at most len(ALPHABET)**2 + len(ALPHABET)
per model.

Everything is DataFrame or SQL functions. Offsets count code points, the end exclusive. Null texts count as empty and
hold nothing. Rows do not depend on each other once the model is trained, so repeated rows get equal spans. Without any
labelled string both models are uniform and add nothing. An empty table gives an empty result; other columns stay, but
one named like the output is replaced. The time for a text grows with its length and, but for a small part (a PART-th squared), with
the number of its spans.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Patterns of the base kinds, in their order, and the group that holds the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 2), ("access", r"AKIA[A-Z0-9]{16,}", 0), ("hex", r"[0-9a-f]{24,}", 0))
SHORTEST_VALUE = 6
RUN = 20
LEAST = 12.0
SAMPLE = 5_000
SMOOTHING = 0.5
#: Numbers whose running totals are built up one by one.
PART = 64
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _totals(values: Column, join) -> Column:
    """Running totals of an array of numbers, by join(total so far, number)."""

    def grown(totals: Column, v: Column) -> Column:
        return F.concat(totals, F.array(F.when(F.size(totals) == 0, v).otherwise(join(F.try_element_at(totals, F.lit(-1)), v))))

    return F.aggregate(values, F.array().cast("array<int>"), grown)


def running(values: Column, join=lambda x, y: x + y) -> Column:
    """Running totals of a long array: of parts of PART numbers, then over the parts' last totals, so that no long array
    is built up number by number."""

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: _totals(F.slice(v, k * PART + 1, F.lit(PART)), join))
        return _bound(parts, lambda p: _bound(_totals(F.transform(p, lambda t: F.element_at(t, -1)), join), lambda before: F.flatten(
            F.transform(p, lambda t, k: F.when(k == 0, t).otherwise(_bound(F.get(before, k - 1), lambda b: F.transform(t, lambda x: join(b, x))))))))

    return _bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(whole(v)))


def _located(text: Column, pattern: str, group: int, kind: int, shortest: int = 0) -> Column:
    """Spans (start, kind, end, value) of a pattern's matches, from the lengths of matches and of what lies between them."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.transform(F.arrays_zip(between.alias("between"), found.alias("found"), values.alias("value")), lambda x: F.struct(
        (F.length(x["between"]) + F.coalesce(F.length(x["found"]), F.lit(0))).alias("step"), F.length(x["found"]).alias("size"), x["value"].alias("value")))
    ends = lambda s: running(F.transform(s, lambda x: x["step"]))
    spans = _bound(sizes, lambda s: F.zip_with(s, ends(s), lambda x, end: F.struct(
        (end - x["size"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))))
    kept = F.filter(spans, lambda x: x["value"].isNotNull() & (F.length(x["value"]) >= shortest))  # what follows the last match stands alone
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), kept).otherwise(F.array().cast(_SPANS))


def _base(text: Column) -> Column:
    return F.sort_array(F.concat(*(_located(text, pattern, group, k, SHORTEST_VALUE if group else 0) for k, (_, pattern, group) in enumerate(PATTERNS))))


def _free(base: Column, runs: Column) -> Column:
    """The runs that overlap no base span. Of all spans by start, a run's must be behind the ends of the base spans before it, and
    if a base span is next, it must not start within the run; runs do not overlap each other."""
    model = len(PATTERNS)

    def chosen(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(s["kind"] < model, s["end"]).otherwise(0)), F.greatest)
        following = F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0)))
        met = F.arrays_zip(spans.alias("span"), ends.alias("behind"), following.alias("next"))
        free = lambda x: (x["span"]["kind"] == model) & (x["behind"] <= x["span"]["start"]) & (
            x["next"].isNull() | (x["next"]["kind"] == model) | (x["next"]["start"] >= x["span"]["end"]))
        return F.transform(F.filter(met, free), lambda x: x["span"])

    return F.when(F.size(base) == 0, runs).otherwise(_bound(F.sort_array(F.concat(base, runs)), chosen))


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """docs with the base spans (start, kind's number, end) of a text, in order."""
    spans = F.transform(_base(F.coalesce(F.col(text), F.lit(""))), lambda x: x.dropFields("value"))
    return docs.withColumn(out, spans)


def _pairs(strings: DataFrame) -> DataFrame:
    """(random, a, b, n): how often character b follows a (empty at the start), from (random, s)."""
    letters = strings.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.struct(
        F.when(i > 1, F.substring(F.col("s"), i - 1, F.lit(1))).otherwise("").alias("a"), F.substring(F.col("s"), i, F.lit(1)).alias("b")))).alias("p"))
    return letters.groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


class Model:
    """Log-likelihood ratios by pair of characters: ratios[(len(ALPHABET) + 1) * i + j - 1] for the j-th character of
    ALPHABET after the i-th, from 1; i is 0 at the start."""

    def __init__(self, ratios: list[float]) -> None:
        self.ratios = ratios

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
        part = min(1.0, sample / max(1, docs.count()))
        plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < part * (1 << 30))
        spans = plain.select(F.explode(_base(F.col("t"))).alias("s"))
        plain_words = plain.select(F.explode(F.regexp_extract_all(F.regexp_replace("t", "|".join(p for _, p, _ in PATTERNS), " "), F.lit(r"[A-Za-z_][A-Za-z0-9_]{5,}"), F.lit(0))).alias("s"))
        strings = spans.select(F.lit(True).alias("random"), F.col("s.value").alias("s")).union(plain_words.select(F.lit(False), "s"))
        counts = {(r.random, r.a, r.b): r.n for r in _pairs(strings.filter("s <> ''")).collect()}
        logs = {kind: [] for kind in (True, False)}
        for kind, out in logs.items():
            for a in ["", *ALPHABET]:
                row = [counts.get((kind, a, b), 0) + SMOOTHING for b in ALPHABET]
                out += [math.log(n / sum(row)) for n in row] + [0.0]
        return cls([x - y for x, y in zip(logs[True], logs[False], strict=True)])

    def ratio(self, run: Column) -> Column:
        """Log-likelihood ratio of a string of ALPHABET's characters."""
        table = F.from_json(F.lit(json.dumps([round(r, 6) for r in self.ratios])), "array<double>")  # folded into one constant
        width = len(ALPHABET) + 1
        numbers = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
        return F.aggregate(numbers, start, lambda s, c: F.when(c == 0, s).otherwise(F.struct(c.alias("last"), (s["sum"] + F.element_at(table, s["last"] * width + c)).alias("sum"))), lambda s: s["sum"])

    def find(self, docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
        """docs with all spans as structs (start, kind's number, end, kind), in order of start and kind."""
        plain, own = F.coalesce(F.col(text), F.lit("")), "_base_and_runs"
        runs = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
        found = docs.withColumn(own, F.struct(_base(plain).alias("base"), _located(plain, runs, 0, len(PATTERNS)).alias("runs")))
        base = F.col(f"{own}.base")
        added = F.filter(_free(base, F.col(f"{own}.runs")), lambda r: self.ratio(r["value"]) >= LEAST)
        names = F.array(*(F.lit(name) for name, _, _ in PATTERNS), F.lit("model"))
        spans = F.transform(F.sort_array(F.concat(base, added)), lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("number"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind")))
        return found.withColumn(out, spans).drop(own)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
