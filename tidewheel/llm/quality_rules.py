"""Quality rules as a learned decision list. DataFrame functions only.

Measures of a text are native expressions. Sequential covering learns, from labelled rows, an ordered list
of conjunctions of thresholds that find bad texts: a rule grows by the condition with the best FOIL gain on
two thirds of the sample, is pruned on the rest, is kept if it is precise there, and what it covers
leaves. Every count is one small aggregation over bucketed measures; the driver sees only counts by measure
and bucket. The list is emitted as one ordered conditional expression.

Learning uses at most ``max_labelled`` labelled rows, those with the smallest hash of the id. Null and
empty texts measure zero everywhere. Labels that are null or lack a document are ignored; without labels of
both kinds the list is empty and keeps all. Repeated rows are measured alike, an empty table gives an empty one, a
text is one row however long. Conditions that gain alike are tried in the order of ``FEATURES`` and borders. An input
column named like an added one is replaced, others stay, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.components import checkpointed

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_SPLIT = "[\\x20\\x09-\\x0D]+"
FEATURES = ("words", "word_length", "symbols", "shouts", "capitals", "digits", "dup_lines", "repeats", "distinct")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct ``m`` of counts; each step names a column that the next reads more than once."""
    kept = [c for c in docs.columns if c != "m"]
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    # the caller's columns travel in one struct, so that none clashes with a name used here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), text.alias("__text"))
    one = own.withColumn("__words", F.array_remove(F.split("__text", _SPLIT), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)
    two = one.withColumn("__lines", lines).withColumn("__n", F.size("__words"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("__n") - 3),
        lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
    )
    three = two.withColumn("__t", F.when(F.col("__n") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    by_hash = F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("__t")) < F.size("__t")
    four = three.withColumn("__s", F.when(some, by_hash).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter(
        "__s",
        lambda x, j: F.coalesce(x["h"] == F.get("__s", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__s", j + 1)["h"], F.lit(False)),
    )
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + 2).alias("end"), (acc["n"] + F.least(F.lit(3), i + 2 - acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    struct = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.translate("__text", SEPARATORS, "")).cast("long").alias("word_chars"),
        _count_of(F.col("__text"), SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        _count_of(F.col("__text"), "!").alias("n_shouts"),
        _count_of(F.col("__text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count_of(F.col("__text"), "0123456789").alias("n_digits"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
    )
    return four.select(*[F.col(f"__row.`{c}`").alias(c) for c in kept], struct.alias("m"))


def features() -> dict[str, Column]:
    """The measures that rules may test, as ratios of the counts in ``m``."""
    n = F.greatest(F.col("m.n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("m.word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("m.n_words").cast("double"),
        "word_length": F.col("m.word_chars") / n,
        "symbols": F.col("m.n_symbols") / n,
        "shouts": F.col("m.n_shouts") / n,
        "capitals": F.col("m.n_capitals") / chars,
        "digits": F.col("m.n_digits") / chars,
        "dup_lines": F.col("m.n_dup_lines") / F.greatest(F.col("m.n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("m.n_repeat_words") / n,
        "distinct": F.col("m.n_distinct") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    #: The bucket border that the threshold stands for, used while learning.
    border: int

    def column(self, value: Column) -> Column:
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def bucket(self, buckets: str = "b") -> Column:
        b = F.col(f"{buckets}.{self.feature}")
        return b >= self.border if self.above else b < self.border

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules; a text that one fits is bad, others are good."""

    rules: list[tuple[Condition, ...]]

    def verdict(self) -> Column:
        """Number of the first rule that fits, from 1; 0 where none does."""
        values, out = features(), None
        for k, rule in enumerate(self.rules, 1):
            fits = F.lit(True)
            for c in rule:
                fits = fits & c.column(values[c.feature])
            out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"bad if {' and '.join(map(str, r))}" for r in self.rules) + "\ngood otherwise"


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    max_labelled: int = 20_000,
    borders: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    least_support: int = 8,
    least_precision: float = 0.9,
) -> DecisionList:
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    picked = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    text = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    joined = text.join(F.broadcast(picked), "id")  # at most max_labelled ids
    values = features()
    sample = checkpointed(
        measure(joined, "text").select(
            (F.col("label") == 0).alias("bad"),
            (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) < 2).alias("grow"),
            F.struct(*[values[f].alias(f) for f in FEATURES]).alias("f"),
        )
    )
    shares = [k / borders for k in range(1, borders)]
    cuts = sample.agg(*[F.percentile(f"f.{f}", F.array(*map(F.lit, shares))).alias(f) for f in FEATURES]).first()
    if cuts["words"] is None:
        return DecisionList([])
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    bucket = {f: F.size(F.filter(F.array(*map(F.lit, edges[f])), _below(f))) for f in FEATURES}
    rows = checkpointed(sample.select("bad", "grow", F.struct(*[bucket[f].alias(f) for f in FEATURES]).alias("b")))

    rules: list[tuple[Condition, ...]] = []
    for _ in range(max_rules):
        left = rows
        for rule in rules:
            left = left.filter(~_all(rule))
        rule = _grow(left.filter("grow"), edges, max_conditions, least_support)
        rule = _prune(left.filter("not grow"), rule) if rule else rule
        if not rule:
            break
        bad, good = _tally(left, [_all(rule)])[0]
        if bad < least_support or bad < least_precision * (bad + good):
            break
        rules.append(rule)
    return DecisionList(rules)


def _below(feature: str):
    return lambda edge: F.col(f"f.{feature}") > edge


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.bucket()
    return out


def _tally(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """Bad and good rows that each test fits."""
    got = rows.agg(
        *[F.count_if(t & F.col("bad")).alias(f"p{k}") for k, t in enumerate(tests)],
        *[F.count_if(t & ~F.col("bad")).alias(f"n{k}") for k, t in enumerate(tests)],
    ).first()
    return [(got[f"p{k}"], got[f"n{k}"]) for k in range(len(tests))]


def _grow(rows: DataFrame, edges: dict, max_conditions: int, least_support: int) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < max_conditions:
        covered = rows.filter(_all(rule))
        cells = covered.select(
            "bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b.{f}").alias("b")) for f in FEATURES])).alias("x")
        )
        counts = cells.groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        table: dict = {}
        for r in counts:
            table.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
        if not table:
            break
        p0, n0 = (sum(x[k] for x in table["words"].values()) for k in (0, 1))
        if p0 < least_support or n0 == 0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (0.0, None)
        for f in FEATURES:
            for border in range(1, len(edges[f]) + 1):
                p, n = (sum(x[k] for b, x in table[f].items() if b >= border) for k in (0, 1))
                for above, a, z in ((True, p, n), (False, p0 - p, n0 - n)):
                    if a >= least_support and (gain := a * (math.log2(a / (a + z)) - before)) > best[0]:
                        best = (gain, Condition(f, above, edges[f][border - 1], border))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The beginning of a rule that is worth most on rows it has not grown on."""
    heads = [rule[:k] for k in range(1, len(rule) + 1)]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in _tally(rows, [_all(h) for h in heads])]
    return heads[max(range(len(heads)), key=lambda k: (worth[k], -k))]


def judge(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """``docs`` with the counts ``m`` and ``rule``, the first rule that fits (0: none)."""
    return measure(docs, text_column).withColumn("rule", rules.verdict())
