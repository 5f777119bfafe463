"""Ranking of monitoring rules for free-text requirements."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from trustloom.functions.hof import let
from trustloom.functions.text import list_map, words

FEATURES = 1 << 18

# Score weights of the blend and the rank thresholds.
COSINE_WEIGHT, MODEL_WEIGHT = 0.3, 0.7
MIN_SCORE = 0.3

# Synonym groups.
SYNONYM_GROUPS = {
    "compute": ["processing", "capacity", "throughput", "calculation"],
    "network": ["bandwidth", "latency", "throughput", "transmission", "connectivity"],
    "memory": ["ram", "swap", "buffers", "allocation", "storage"],
    "speed": ["latency", "throughput", "performance", "response"],
    "critical": ["emergency", "severe", "alert", "danger"],
    "overload": ["saturation", "maxout", "overutilization"],
}

# Keywords of each rule category.
RULE_CATEGORIES = {
    "cpu": ["cpu", "processing", "core", "load", "compute"],
    "memory": ["memory", "swap", "buffer", "allocation", "free"],
    "network": ["network", "bandwidth", "latency", "packet", "tx", "rx"],
    "hardware": ["temperature", "fan", "speed", "hardware", "metal"],
    "system": ["zombie", "process", "kernel", "dpdk", "ssh"],
}


def synonym_lookup(groups: DataFrame) -> DataFrame:
    """``term, members`` of ``group_no, term, synonyms``; a later group overwrites an earlier."""
    members = F.concat(F.array("term"), F.col("synonyms"))
    return (groups.select("group_no", members.alias("members"), F.explode(members).alias("term"))
            .groupBy("term").agg(F.max_by("members", "group_no").alias("members")))


def synonym_dict(groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The same lookup for a small dictionary."""
    return {word: [head, *rest] for head, rest in groups.items() for word in (head, *rest)}


def encode_texts(rows: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
                 text: str = "text", batch_size: int = 64) -> DataFrame:
    """Add ``vector`` by a pluggable encoder, each distinct text encoded once.

    The join back is on a digest; repeated texts are the many side of it, which
    AQE splits when one text holds very many rows.
    """
    from pyspark.ml.functions import predict_batch_udf
    encode = predict_batch_udf(make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size)
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    unique = keyed.groupBy("_key").agg(F.first(text).alias("_text"))
    vectors = unique.select("_key", encode("_text").alias("vector"))
    return keyed.join(vectors, "_key").drop("_key")


def parse_model_scores(responses: DataFrame, max_rule: int | None = None) -> DataFrame:
    """``query_id, rule_id, score`` of the response lines that name a rule and a score between 0 and 1.

    A line is a rule name (``r`` and a number without leading zeros), a colon and a score of one or two decimals; other lines are
    ignored, and so are numbers above ``max_rule``. The last line about a rule counts.
    """
    lines = responses.select("query_id", F.posexplode(F.split("response", "\r?\n")).alias("pos", "line"))
    halves = lines.select("query_id", "pos", F.split("line", ":").alias("half")).filter(F.size("half") == 2)
    named = halves.select("query_id", "pos", F.get("half", F.lit(0)).alias("rule_id"), F.get("half", F.lit(1)).alias("value"))
    number = F.substring("rule_id", 2, 10).try_cast("int")
    decimals = F.length("value") - F.length(F.substring_index("value", ".", 1)) - 1
    known = (F.concat(F.lit("r"), number.cast("string")) == F.col("rule_id")) & (number >= 1)
    score = F.col("value").try_cast("decimal(4,2)")
    plain = (F.substring_index("value", ".", 1).isin("0", "1")) & decimals.isin(1, 2) & score.between(0, 1)
    if max_rule is not None:
        known = known & (number <= max_rule)
    return (named.filter(known & plain).groupBy("query_id", "rule_id")
            .agg(F.max_by(score.cast("double"), "pos").alias("score")))


def blend(cosine: DataFrame, model: DataFrame, cosine_weight: float = COSINE_WEIGHT,
          model_weight: float = MODEL_WEIGHT, min_score: float = MIN_SCORE) -> DataFrame:
    """Weighted sum of both scores; a missing side counts 0."""
    both = cosine.withColumnRenamed("score", "c").join(
        model.withColumnRenamed("score", "m"), ["query_id", "rule_id"], "full_outer")
    score = (F.coalesce("c", F.lit(0.0)) * cosine_weight
             + F.coalesce("m", F.lit(0.0)) * model_weight)
    return both.select("query_id", "rule_id", score.alias("score")).filter(
        F.col("score") >= min_score)


def invalid_labels(training: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule ids of the training rows that no rule has."""
    used = training.select(F.explode(F.split("rule_ids", ";")).alias("id")).distinct()
    return used.join(rules.select("id"), "id", "left_anti")


def explain_terms(left: Column, right: Column) -> Column:
    """Terms both token lists have, sorted, underscores shown as spaces."""
    return F.transform(F.array_sort(F.array_intersect(left, right)),
                       lambda t: F.replace(t, F.lit("_"), F.lit(" ")))


def label_set(ids: Column) -> Column:
    return F.when(ids == "None", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(ids, ";")))


def evaluate(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 in percent over the queries the truth has."""
    pairs = (predictions.select("query", label_set(F.col("rule_ids")).alias("p"))
             .join(truth.select("query", label_set(F.col("rule_ids")).alias("t")), "query"))
    sums = pairs.agg(F.sum(F.size(F.array_intersect("p", "t"))).alias("tp"),
                     F.sum(F.size(F.array_except("p", "t"))).alias("fp"),
                     F.sum(F.size(F.array_except("t", "p"))).alias("fn"))
    return percentages(sums)


def percentages(sums: DataFrame) -> DataFrame:
    """Precision, recall and F1 of summed ``tp, fp, fn``; 0 where undefined."""
    zero = F.lit(0.0)
    rates = sums.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fp")), zero),
        "recall": F.coalesce(F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fn")), zero)})
    return rates.withColumn("f1", F.coalesce(F.try_divide(
        2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def augment(queries: DataFrame, synonyms: Mapping[str, Sequence[str]], variants: int = 20,
            seed: int = 0) -> DataFrame:
    """The queries and up to ``variants`` copies with one word swapped for a synonym.

    The choice is a seeded hash order over all (word position, synonym) pairs,
    made inside the row, so a rerun gives the same variants.
    """
    tokens = F.split("query", r"\s+")
    table = list_map(synonyms)
    swaps = F.flatten(F.transform(tokens, lambda w, i: F.transform(
        F.coalesce(F.try_element_at(table, F.lower(w)), F.array().cast("array<string>")),
        lambda s: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), s)).alias("h"),
                           i.alias("i"), s.alias("s")))))
    chosen = F.slice(F.array_sort(swaps), 1, variants)
    texts = let(tokens, lambda words_: F.array_distinct(F.transform(
        chosen, lambda c: F.array_join(F.transform(
            words_, lambda w, i: F.when(i == c["i"], c["s"]).otherwise(w)), " "))))
    rest = [c for c in queries.columns if c != "query"]
    copies = queries.select(F.explode(texts).alias("query"), *rest, F.lit(True).alias("augmented"))
    return queries.select("query", *rest, F.lit(False).alias("augmented")).unionByName(copies)


def synonym_table(lexicon: DataFrame) -> DataFrame:
    """Distinct lower-case lemma names per term of a ``term, lemma`` lexicon."""
    return (lexicon.select("term", F.lower("lemma").alias("lemma")).distinct()
            .groupBy("term").agg(F.array_sort(F.collect_list("lemma")).alias("synonyms")))


def recommendation_log(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """``query, rule_ids`` with the ids of each query in rank order, or ``None``."""
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rule_id")))
    ids = scores.groupBy("query_id").agg(F.array_join(
        F.transform(best_first, lambda r: r["rule_id"].cast("string")), ";").alias("rule_ids"))
    return (queries.join(ids, "query_id", "left")
            .select("query", F.coalesce("rule_ids", F.lit("None")).alias("rule_ids")))


def chosen_rules(full_rules: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rule rows of the chosen ids in the rule-file columns."""
    return full_rules.join(chosen.select("id").distinct(), "id", "left_semi").select(
        "name", "path", "severity", "rule")


def label_weights(training: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``label, positives, n, weight_1, weight_0``: weights that balance each label column (0/1); NULL for a class without rows."""
    long = training.unpivot([], list(labels), "label", "value")
    counts = long.groupBy("label").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("bigint").alias("positives"), F.count(F.lit(1)).alias("n"))
    n, positives = F.col("n"), F.col("positives")
    return counts.select("label", "positives", "n", F.try_divide(n, 2.0 * positives).alias("weight_1"), F.try_divide(n, 2.0 * (n - positives)).alias("weight_0"))


def train_classifiers(training: DataFrame, labels: Sequence[str], width: int = FEATURES, text: str = "text", max_iter: int = 50):
    """One balanced logistic regression per label column (0/1) over TF-IDF features of unit length.

    Terms are hashed to ``width`` features, so all terms count and what reaches the driver (a weight per feature and label) has a
    fixed size, however large the vocabulary; terms that share a feature share its weight. Returns a pipeline model that adds
    ``p_<label>`` struct columns through :func:`classify`. The loop is over the label names, not over data.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer
    from pyspark.ml.linalg import Vectors
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=width)
    rows = hashed.transform(training.withColumn("_tokens", words(F.col(text))))
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(rows)
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf", scalingVec=Vectors.dense(idf.idf.toArray() + 1.0))
    features = PipelineModel([hashed, scale, Normalizer(inputCol="_tfidf", outputCol="_features", p=2.0)])
    ready = features.transform(training.withColumn("_tokens", words(F.col(text)))).select("_features", *labels).persist()
    weights = {r["label"]: r for r in label_weights(ready.select(*labels), labels).collect()}  # a row per label
    models = {}
    for label in labels:
        own = weights.get(label)
        if own is None or own["weight_1"] is None or own["weight_0"] is None:
            models[label] = None
            continue
        weight = F.when(F.col(label) == 1, own["weight_1"]).otherwise(own["weight_0"])
        models[label] = LogisticRegression(
            featuresCol="_features", labelCol=label, weightCol="_weight", regParam=1.0 / own["n"],
            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
            probabilityCol=f"_p_{label}", rawPredictionCol=f"_r_{label}",
            predictionCol=f"_c_{label}").fit(ready.withColumn("_weight", weight))
    ready.unpersist()
    return features, models


def classify(rows: DataFrame, trained, key: str, text: str = "text") -> DataFrame:
    """Probability of every trained label per row as ``p_<label>``; NULL for one-sided labels."""
    from pyspark.ml.functions import vector_to_array
    features, models = trained
    out = features.transform(rows.withColumn("_tokens", words(F.col(text))))
    for model in models.values():
        if model is not None:
            out = model.transform(out)
    return out.select(key, *[
        (vector_to_array(F.col(f"_p_{label}"))[1] if model is not None
         else F.lit(None).cast("double")).alias(f"p_{label}") for label, model in models.items()])


def masked_scores(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """Classifier scores of the (query, rule) pairs that passed the similarity threshold."""
    return scores.join(mask.select("query_id", "rule_id"), ["query_id", "rule_id"], "left_semi")
