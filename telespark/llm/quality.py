"""Quality classifier: a sparse ensemble of tree rules in Spark expressions.

Statistics of a text are column expressions.  A random forest on a bounded
sample of labelled rows proposes rules (paths of its trees); a logistic
regression with a lasso penalty weighs them; the rules with a weight are
compiled into one column expression, so scoring is a plain projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, materialise, whole_text, words
from .trees import holds, read_tree, rules

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 20_000
STATISTICS = ["log_chars", "log_words", "word_length", "repeat", "distinct", "caps", "shout", "marks", "bars", "digits", "short", "line_words"]


def statistics(text: Column, prefix: str = "") -> list[tuple[str, Column]]:
    """Steps (name, expression) that add the statistics of a text, in order.

    Later steps use columns that earlier ones add; all shares are of words.
    An empty text has zeros.
    """
    w, n = F.col(f"{prefix}w"), F.col(f"{prefix}n")

    def share(test) -> Column:
        return F.when(n > 0, F.size(F.filter(w, test)) / n).otherwise(0.0)

    return [
        (f"{prefix}w", words(text)),
        (f"{prefix}n", F.size(f"{prefix}w")),
        ("log_chars", F.log1p(F.length(text).cast("double"))),
        ("log_words", F.log1p(n.cast("double"))),
        ("word_length", F.when(n > 0, F.length(text) / n).otherwise(0.0)),
        ("repeat", share(lambda x, i: (i > 0) & (x == F.get(w, i - 1)))),
        ("distinct", F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(0.0)),
        ("caps", share(lambda x: (x == F.upper(x)) & (x != F.lower(x)))),
        ("shout", share(lambda x: x.endswith("!!"))),
        ("marks", share(lambda x: x.rlike(r"[&$#%*~^=<>{}\[\]\\]{2}"))),
        ("bars", share(lambda x: x == "|")),
        ("digits", share(lambda x: x.rlike("[0-9]"))),
        ("short", share(lambda x: F.length(x) <= 3)),
        ("line_words", n / (1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))),
    ]


def with_statistics(df: DataFrame, text: Column) -> DataFrame:
    for name, c in statistics(text, "_"):
        df = df.withColumn(name, c)
    return df.drop("_w", "_n")


@dataclass
class RuleModel:
    """Intercept and weighted rules; ``score`` is the probability of label 1."""

    intercept: float
    weights: list[tuple[float, tuple[tuple[int, str, float], ...]]]

    def score(self, features: list[Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.weights:
            total = total + F.lit(weight) * holds(rule, features)
        return 1.0 / (1.0 + F.exp(-total))


def held_out(id_col: Column) -> Column:
    """Rows that no model is fitted on: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleModel:
    """Fit on at most ``rows`` labelled rows, spread by a hash of the id.

    Held-out ids, null ids and labels other than 0 and 1 are left out; an id
    labelled twice has its larger label.  Without rows of both labels the
    score is constant: the label there is, or 0.5 without any.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
             .where(F.col("label").isin(0.0, 1.0) & F.col("id").isNotNull() & ~held_out(F.col("id"))))
    # `rows` pairs of numbers at most: small enough to broadcast.
    known = materialise(known.groupBy("id").agg(F.max("label").alias("label")), "labelled")
    chosen = known.where(hash_share(F.xxhash64("id"), rows, known.count())).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), "id")
    data = materialise(with_statistics(texts, F.col("text")).select("label", F.array(*STATISTICS).alias("x")), "quality")
    seen = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleModel({0.0: -50.0, 1.0: 50.0}.get(next(iter(seen), None), 0.0), [])
    vectors = data.select("label", array_to_vector("x").alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(vectors)
    found = sorted(set().union(*(rules(read_tree(t.toDebugString)) for t in forest.trees)))
    if not found:
        share = seen[1.0] / (seen[0.0] + seen[1.0])
        return RuleModel(math.log(share / (1 - share)), [])
    x = [F.col("x")[i] for i in range(len(STATISTICS))]
    ruled = data.select("label", array_to_vector(F.array(*(holds(r, x) for r in found))).alias("features"))
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100, standardization=False).fit(ruled.cache())
    ruled.unpersist()
    return RuleModel(lasso_fit.intercept, [(float(c), r) for c, r in zip(lasso_fit.coefficients.toArray(), found) if c != 0.0])


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts have the score of all-zero statistics.  Repeated rows
    are scored alike; other columns, labels among them, are never read.  An
    empty table gives an empty result.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")), F.col("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score([F.col(c) for c in STATISTICS]).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model predicts as label 1, with the columns of docs."""
    rows = with_statistics(docs.select(F.struct(*docs.columns).alias("row"), whole_text(text_col).alias("_text")), F.col("_text"))
    good = model.score([F.col(c) for c in STATISTICS]) >= threshold
    # A filter would be pushed below the statistics, which its every use of them would then compute anew.
    return rows.select(F.explode(F.filter(F.array("row"), lambda _: good)).alias("row")).select("row.*")
