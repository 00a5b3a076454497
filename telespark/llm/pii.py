"""Personal data: pattern spans, and more spans chosen by boosted trees.

Everything is a column expression over one row: texts are never exploded or
shuffled.  Positions come from the pieces between matches (``split``) and the
matches (``regexp_extract_all``), whose lengths add up to code point offsets.

Generators with loose patterns propose overlapping candidates (written-out
addresses, numbers with any separators).  Boosted trees, fitted on the
candidates of all texts, score them by format and context; each kind has its
own threshold, calibrated on held-out candidates.  The labels are the pattern spans
themselves; copies of the positive examples without the telling marks (the
plus sign, the at sign) teach the trees the rest of the format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text
from .trees import Leaf, Split, read_tree, value

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and the test for the start of a run change no match;
# they keep long runs linear and long groups off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^(?:0*+(?:(?<=0)|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Generators: pattern and the kinds that it proposes.
LOOSE = (
    (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++", ("email",)),
    (r"(?<![0-9A-Za-z+])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+", ("card", "phone")),
    (r"(?<![0-9.])[0-9]{1,3}(?:[\x20._-][0-9]{1,3}){3}(?![0-9.])", ("ip",)),
)
CUES = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|addr|client|from",
    "card": "card|visa|master|amex|credit|debit|pay|account",
    "phone": "phone|tel|call|fax|mobile|cell|number|whatsapp",
}
#: Characters before a candidate that the context features read.
NEAR = 32
FEATURES = ("kind", "length", "digits", "letters", "gaps", "groups", "checksum", "octets", "cue", "glued_before", "glued_after", "plus", "at")
#: Features that the marked copies of positive examples lose.
MARKS = ("plus", "at")
#: Precision that a threshold has to reach on the held-out fifth (personal
#: data that the patterns miss counts as wrong there, so the true precision is higher), on how many true spans.
PRECISION, LEAST_TRUE = 0.9, 30


def running_totals(a: Column) -> Column:
    """Prefix sums of an array, in blocks so that long arrays stay cheap."""
    size = 128

    def prefix(x: Column, extra: int) -> Column:
        return F.transform(x, lambda _, i: F.aggregate(F.slice(x, 1, i + extra), F.lit(0), lambda s, v: s + v))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / size) - 1, F.lit(0)).cast("int")), lambda b: F.slice(a, b * size + 1, size))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, prefix(sums, 0), lambda x, before: F.transform(prefix(x, 1), lambda v: v + before)))


def _find(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Add ``name``: array of (start, end, m) for the matches of the pattern in ``t``."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(guard, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.size("_m") > 0, F.transform(F.split("t", pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    # The end of match i: all pieces up to it and all matches up to it.
    steps = F.zip_with(F.slice("_gaps", 1, F.size("_m")), "_m", lambda g, m: g + F.length(m))
    df = df.withColumn("_ends", F.when(F.size("_m") > 0, running_totals(steps)).otherwise(F.array().cast("array<int>")))
    found = F.zip_with("_ends", "_m", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))
    return df.withColumn(name, found).drop("_m", "_gaps", "_ends")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(m)

    def checked(p: Column) -> Column:
        def digit(i: Column) -> Column:
            x = F.ascii(p.substr(i, F.lit(1))) - 48
            return F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + digit(i)) % 10 == 0

    # A one-element array gives the padded digits a name inside the expression.
    return F.length(d).between(14, 19) & F.exists(F.array(F.lpad(d, 20, "0")), checked)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_OCTETS),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _with_spans(docs: DataFrame, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """Add ``base``: sorted (start, kind, end) of the pattern spans, and a column of them for each kind."""
    df = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t"), *keep)
    df = df.withColumn("_at", F.contains("t", F.lit("@"))).withColumn("_digit", F.col("t").rlike("[0-9]"))
    for k, kind in enumerate(KINDS):
        df = _find(df, "_found", PATTERNS[kind], F.col("_at" if kind == "email" else "_digit"))
        good = F.filter("_found", lambda s: _VALID[kind](s["m"]))
        df = df.withColumn(f"s_{kind}", F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))).drop("_found")
    return df.withColumn("base", F.array_sort(F.concat(*(f"s_{kind}" for kind in KINDS))))


def _with_candidates(df: DataFrame) -> DataFrame:
    """Add ``found``: (start, kind, end, x) of all proposals; x: their features."""
    parts = []
    at = F.col("_at") | F.col("t").rlike(r"(?i)[\[(]at[\])]")
    for n, (pattern, kinds) in enumerate(LOOSE):
        df = _find(df, f"_loose{n}", pattern, at if "email" in kinds else F.col("_digit"))
        for kind in kinds:
            parts.append(F.transform(f"_loose{n}", lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), _features(s, kind).alias("x"))))
    df = df.withColumn("found", F.concat(*parts))
    return df.drop(*(f"_loose{n}" for n in range(len(LOOSE))))


def _features(s: Column, kind: str) -> Column:
    m, t = s["m"], F.col("t")
    start, one = F.greatest(s["start"] - NEAR, F.lit(0)), F.lit(1)
    before = t.substr(start + 1, s["start"] - start)
    digits = F.length(_digits(m))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    length = F.length(m) - F.when(m.startswith("+"), 1).otherwise(0)  # only "plus" tells the sign
    x = {
        "kind": F.lit(KINDS.index(kind)),
        "length": length,
        "digits": digits,
        "letters": letters,
        "gaps": length - digits - letters,
        "groups": F.size(F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), F.lit(0))),
        "checksum": _luhn(m),
        "octets": F.regexp_replace(m, r"[\x20_-]", ".").rlike(_OCTETS),
        "cue": F.lower(before).rlike(CUES[kind]),
        "glued_before": (s["start"] > 0) & t.substr(s["start"], one).rlike("[A-Za-z0-9]"),
        "glued_after": t.substr(s["end"] + 1, one).rlike("[A-Za-z0-9]"),
        "plus": m.startswith("+"),
        "at": m.contains("@"),
    }
    return F.array(*(F.coalesce(x[f].cast("double"), F.lit(0.0)) for f in FEATURES))


@dataclass
class Booster:
    """Weighted trees with a score threshold for each kind that has one."""

    trees: list[tuple[float, Leaf | Split]]
    thresholds: dict[int, float]

    def score(self, x: Column) -> Column:
        """Probability that a candidate with features x is personal data of its kind."""
        features = [x[i] for i in range(len(FEATURES))]
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * value(tree, features)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    def chosen(self, kind: Column, x: Column) -> Column:
        least = F.lit(2.0)
        for k, threshold in self.thresholds.items():
            least = F.when(kind == k, threshold).otherwise(least)
        return self.score(x) >= least


def fit(docs: DataFrame, rounds: int = 15, depth: int = 3, precision: float = PRECISION, least_true: int = LEAST_TRUE,
        seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Booster:
    """Fit the trees and thresholds on every candidate of every text; a fifth, by a hash of text and place, judges the thresholds.

    Candidates alike in label and features are one weighted row, so what the
    trees pass over many times is a small table of counts.
    Without candidates of both labels there are no trees, and a kind without
    enough true held-out candidates has no threshold: it adds no span.
    """
    df = _with_candidates(_with_spans(docs, id_col, text_col, []))
    # The outer form: for the inner one the planner adds a filter on the candidates, and computes them once more for it.
    df = df.select("t", "base", F.explode_outer("found").alias("c")).where("c IS NOT NULL")
    same = F.array_contains("base", F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end")))
    held_out = F.pmod(F.xxhash64("t", "c.start", "c.kind"), F.lit(5)) == 0
    df = df.select(same.cast("double").alias("label"), "c.x", held_out.alias("held_out"))
    data = materialise(df.groupBy("label", "x", "held_out").agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii")
    marks = [FEATURES.index(m) for m in MARKS]
    bare = data.where("label = 1").withColumn("x", F.transform("x", lambda v, i: F.when(i.isin(marks), 0.0).otherwise(v)))
    training = data.unionByName(bare).where("not held_out").groupBy("label", "x").agg(F.sum("weight").alias("weight"))
    training = training.orderBy("label", "x").select("label", "weight", array_to_vector("x").alias("features"))
    if training.select("label").distinct().count() < 2:
        return Booster([], {})
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, weightCol="weight").fit(training)
    booster = Booster([(float(w), read_tree(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees)], {})
    grid = [g / 20 for g in range(2, 20)]
    judged = data.where("held_out").select("label", "weight", F.col("x")[0].cast("int").alias("kind"), booster.score(F.col("x")).alias("p"))
    judged = judged.withColumn("g", F.explode(F.array(*map(F.lit, grid)))).where("p >= g").groupBy("kind", "g").agg(
        (F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("precision"), F.sum(F.col("label") * F.col("weight")).alias("true"))
    for r in judged.where((F.col("precision") >= precision) & (F.col("true") >= least_true)).collect():  # kinds x grid at most
        booster.thresholds[r["kind"]] = min(r["g"], booster.thresholds.get(r["kind"], 1.0))
    return booster


def scan(docs: DataFrame, model: Booster | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs.

    The counts and ``base_sha256`` are of the pattern spans; ``spans`` also has
    the spans that the model adds: candidates over their kind's threshold that
    overlap no pattern span, of overlapping ones the first and likeliest.
    Spans are ``kind:start:end`` in code points, sorted by start, then kind.
    Rows are independent of each other: repeated rows and ids give repeated
    results.  Null and empty texts have no spans.  An empty table gives an
    empty result; other columns are not read.
    """
    df = _with_spans(docs, id_col, text_col, [])
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if model is None or not model.thresholds:
        df = df.withColumn("added", nothing)
    else:
        df = _with_candidates(df)
        likely = F.filter("found", lambda c: model.chosen(c["kind"], c["x"]) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        ranked = F.array_sort(F.transform(likely, lambda c: F.struct(c["start"].alias("start"), (-model.score(c["x"])).alias("p"), c["kind"].alias("kind"), c["end"].alias("end"))))
        start = F.struct(nothing.alias("taken"), F.lit(0).alias("end"))
        taken = F.aggregate(ranked, start, lambda s, c: F.when(c["start"] >= s["end"], F.struct(
            F.concat(s["taken"], F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))).alias("taken"), c["end"].alias("end"))).otherwise(s))
        df = df.withColumn("added", F.when(F.size("found") > 0, taken["taken"]).otherwise(nothing))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    return df.select("doc_id", *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                     joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
