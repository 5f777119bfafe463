"""Text similarity between documents (requirements) and benchmark items (rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions.text import category, normalize, ngrams, term_counts, words
from trustloom.operators import recommend, similarity
from trustloom.plans.tables import table

STOP = ("the", "and", "for", "que", "les", "der", "die", "und")
SYNONYMS = {"the": ["das"], "and": ["und", "plus"], "der": ["the"], "than": ["alas", "then"], "que": ["what"]}
PHRASES = ("de la", "in the")
CATEGORIES = {"one": ["the", "and", "in"], "two": ["de", "la", "que"], "three": ["der", "und", "die"]}


def _documents(spark, folder):
    return table(spark, folder, "documents")


def text_tokens(spark, folder):
    """Normalised tokens of all benchmark items: phrases, synonyms, filters."""
    tokens = normalize(F.col("text"), PHRASES, {"than": ["than", "alas", "then"]}, STOP)
    return table(spark, folder, "benchmark").select("item_id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


def term_frequencies(spark, folder):
    rows = _documents(spark, folder).select("lang", F.explode(term_counts(words(F.col("text")))).alias("t"))
    return rows.groupBy("lang", "t.term").agg(F.sum("t.tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def phrase_counts(spark, folder):
    """Two-word runs of the conversations that are phrases."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", words(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", F.explode(ngrams(F.col("w"), 2)).alias("phrase")).filter(
        F.col("phrase").isin(*PHRASES)).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def category_assign(spark, folder):
    return _documents(spark, folder).select("doc_id", category(words(F.col("text")), CATEGORIES).alias("category"))


def _vocabulary(spark, folder, limit=None):
    return similarity.vocabulary(table(spark, folder, "benchmark"), words(F.col("text")), limit)


def vocabulary_idf(spark, folder):
    return _vocabulary(spark, folder).select("term", F.round("idf", 9).alias("idf"))


def vocabulary_top(spark, folder):
    """The 300 most frequent terms: the vocabulary with its size limit."""
    return _vocabulary(spark, folder, 300).select("term", F.round("idf", 9).alias("idf"))


def _cosine(spark, folder, min_score=0.3, k=None):
    terms = _vocabulary(spark, folder)
    rules = table(spark, folder, "benchmark").withColumnRenamed("item_id", "rule_id")
    queries = _documents(spark, folder).withColumnRenamed("doc_id", "query_id")
    return similarity.similar_pairs(*(similarity.text_vectors(rows, key, words(F.col("text")), terms)
                                      for rows, key in ((queries, "query_id"), (rules, "rule_id"))), min_score, k)


def tfidf_cosine(spark, folder):
    return _cosine(spark, folder).select("query_id", "rule_id", F.round("score", 7).alias("score"))


def topk_rules(spark, folder):
    scores = _cosine(spark, folder, k=3).withColumn("score", F.round("score", 7))
    return similarity.ranked(scores, 3).select("query_id", "rule_id", "rank", "score")


def recommendation_log(spark, folder):
    scores = _cosine(spark, folder, 0.5).withColumn("score", F.round("score", 7))
    queries = _documents(spark, folder).select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("query"))
    return recommend.recommendation_log(queries, scores)


def explain_terms(spark, folder):
    """Shared terms of each conversation turn with the same-numbered benchmark item."""
    items = table(spark, folder, "benchmark").select("item_id", words(F.col("text")).alias("b"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", words(F.col("text")).alias("a"))
    return turns.join(items, F.col("conv_id") == F.col("item_id")).select(
        "conv_id", "turn", F.array_join(recommend.explain_terms(F.col("a"), F.col("b")), ",").alias("terms"))


def dense_cosine_topk(spark, folder):
    """The three labels whose mean vector is nearest to each vector."""
    vectors = table(spark, folder, "embeddings")
    rows = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg("x").alias("x")).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector"))
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rules = means.withColumnRenamed("label", "rule_id")
    scores = similarity.similar_pairs(similarity.dense_vectors(queries, "query_id"), similarity.dense_vectors(rules, "rule_id"), None, k=3)
    return similarity.ranked(scores.withColumn("score", F.round("score", 6)), 3)


def _hybrid_side(spark, folder, name, key, vec_id, tokens, terms):
    """Vectors of the texts of a table, each with the embedding that its id names among all."""
    vectors = table(spark, folder, "embeddings")
    rows = table(spark, folder, name).crossJoin(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n"))))  # one row
    dense = rows.select(F.col(name_id(name)).alias(key), (vec_id % F.col("n")).alias("vec_id")).join(vectors, "vec_id").select(key, F.col("embedding").alias("vector"))
    texts = table(spark, folder, name).withColumnRenamed(name_id(name), key)
    return similarity.hybrid_vectors(similarity.text_vectors(texts, key, tokens, terms), dense, key)


def name_id(name):
    return {"documents": "doc_id", "benchmark": "item_id"}[name]


def hybrid_topk(spark, folder):
    """The recommender end to end: normalised text and dense part, the three best rules of at least 0.3, and the terms they share."""
    tokens = normalize(F.col("text"), PHRASES, {"than": ["than", "alas", "then"]}, STOP)
    terms = similarity.vocabulary(table(spark, folder, "benchmark"), tokens)
    queries = _hybrid_side(spark, folder, "documents", "query_id", F.col("doc_id"), tokens, terms)
    rules = _hybrid_side(spark, folder, "benchmark", "rule_id", F.col("item_id") * 7 + 3, tokens, terms)
    scores = similarity.similar_pairs(queries, rules, 0.3, k=3).withColumn("score", F.round("score", 6))
    best = similarity.ranked(scores, 3)
    left = _documents(spark, folder).select(F.col("doc_id").alias("query_id"), tokens.alias("a"))
    right = table(spark, folder, "benchmark").select(F.col("item_id").alias("rule_id"), tokens.alias("b"))
    shared = F.array_join(recommend.explain_terms(F.col("a"), F.col("b")), ",")
    return best.join(left, "query_id").join(right, "rule_id").select("query_id", "rule_id", "rank", "score", shared.alias("terms"))


def _vowel_encoder():
    """An encoder that counts vowels: what a sentence model would be plugged in as."""
    import numpy as np

    def encode(texts):
        return np.array([[t.count(v) for v in "aeiou"] for t in texts.ravel()], dtype=np.float32)
    return encode


def encoded_texts(spark, folder):
    """Vectors of all conversation turns by a pluggable encoder, each distinct text encoded once."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    coded = recommend.encode_texts(rows, _vowel_encoder)
    return coded.select("conv_id", "turn", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def model_scores(spark, folder):
    """Scores parsed from response lines rendered from the events."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    text = F.concat(F.lit("Here:\nr"), (k % 40).cast("string"), F.lit(":0."), F.lpad(k.cast("string"), 2, "0"), F.lit("\nr1:1.00\nr2: 0.5\n"))
    rows = table(spark, folder, "events").select(F.col("event_id").alias("query_id"), text.alias("response"))
    return recommend.parse_model_scores(rows, max_rule=33)


def score_blend(spark, folder):
    pairs = table(spark, folder, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("rule_id"), "value", "event_id")
    cosine = pairs.filter("rule_id <> 'view'").groupBy("query_id", "rule_id").agg((F.max("value") / 500).alias("score"))
    model = pairs.filter("rule_id <> 'click'").groupBy("query_id", "rule_id").agg((F.min("value") / 10).alias("score"))
    return recommend.blend(cosine, model).withColumn("score", F.round("score", 9))


def label_sets(spark, folder):
    """Truth and prediction texts per user, as in the evaluation files."""
    events = table(spark, folder, "events").select("user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))

    def ids(df):
        return df.groupBy(F.col("user_id").cast("string").alias("query")).agg(
            F.array_join(F.array_sort(F.collect_list("event_type")), ";").alias("rule_ids"))
    return ids(events.filter("v > 30")), ids(events.filter("v > 40 AND user_id % 3 <> 0 OR event_type = 'view'"))


def eval_micro_f1(spark, folder):
    truth, predicted = label_sets(spark, folder)
    out = recommend.evaluate(truth, predicted)
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def invalid_labels(spark, folder):
    truth, _ = label_sets(spark, folder)
    rules = table(spark, folder, "events").filter("value > 480").select(F.col("event_type").alias("id")).distinct()
    return recommend.invalid_labels(truth, rules)


def query_augmentation(spark, folder):
    rows = table(spark, folder, "benchmark").select(F.regexp_replace("text", r"\s+", " ").alias("query"), F.col("item_id").cast("string").alias("rule_ids"))
    return recommend.augment(rows, SYNONYMS, variants=20, seed=7)


def synonym_lookup(spark, folder):
    """Nations of a region as a synonym group; every member maps to its group."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    groups = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(
        F.array_sort(F.collect_list("n_name")).alias("synonyms")).select(
        F.col("r_regionkey").alias("group_no"), F.col("r_name").alias("term"), "synonyms")
    return recommend.synonym_lookup(groups).select("term", F.array_join("members", ",").alias("members"))


def synonym_table(spark, folder):
    lexicon = table(spark, folder, "part").select(F.split("p_name", " ")[1].alias("term"), F.upper(F.split("p_name", " ")[0]).alias("lemma"))
    return recommend.synonym_table(lexicon).select("term", F.array_join("synonyms", ",").alias("synonyms"))


def chosen_rules(spark, folder):
    rules = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("/node/bm").alias("path"),
                                                F.col("p_brand").alias("severity"), F.col("p_type").alias("rule"))
    chosen = table(spark, folder, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return recommend.chosen_rules(rules, chosen)


def _training(spark, folder):
    return _documents(spark, folder).select("doc_id", "text").join(table(spark, folder, "labels"), "doc_id")


def label_features(spark, folder):
    """TF-IDF features of all labelled documents, summed up per document."""
    rows, tokens = _training(spark, folder), words(F.col("text"))
    terms = similarity.vocabulary(rows, tokens)
    vectors = similarity.text_vectors(rows, "doc_id", tokens, terms)
    weights = F.col("weights")
    return vectors.select("doc_id", F.size("nos").alias("terms"), F.round(F.array_max(weights), 9).alias("largest"),
                          F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 9).alias("sum"))


def label_weights(spark, folder):
    out = recommend.label_weights(_training(spark, folder).select("quality", "toxic"), ["quality", "toxic"])
    return out.select("label", "positives", "n", F.round("weight_1", 12).alias("weight_1"), F.round("weight_0", 12).alias("weight_0"))


def masked_scores(spark, folder):
    """Scores of two rules per document, kept where the texts are similar as well."""
    n = table(spark, folder, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    pairs = table(spark, folder, "documents").select("doc_id").crossJoin(F.broadcast(n)).select(  # one row
        F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(F.array(F.col("doc_id") % F.col("n"), (F.col("doc_id") * 7 + 1) % F.col("n")))).alias("rule_id"),
        (F.col("doc_id") % 100 / 100).alias("score"))
    return recommend.masked_scores(pairs, _cosine(spark, folder))


def label_classifier(spark, folder):
    """Probabilities of the two labels for every document."""
    trained = recommend.train_classifiers(_training(spark, folder), ["quality", "toxic"], max_iter=20)
    return recommend.classify(_documents(spark, folder).select("doc_id", "text"), trained, "doc_id")


QUERIES = {f.__name__: f for f in (
    text_tokens, term_frequencies, phrase_counts, category_assign, vocabulary_idf, vocabulary_top, tfidf_cosine, topk_rules, recommendation_log,
    explain_terms, dense_cosine_topk, hybrid_topk, encoded_texts, model_scores, score_blend, eval_micro_f1, invalid_labels, query_augmentation, synonym_lookup,
    synonym_table, chosen_rules, label_features, label_weights, masked_scores, label_classifier)}

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
COS = f"""WITH bt AS (SELECT item_id, unnest({TOK}) AS term FROM benchmark), bc AS (SELECT item_id, term, count(*) AS tf FROM bt GROUP BY 1, 2),
    v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM bc WHERE length(term) >= 2
          GROUP BY 1),
    bw AS (SELECT item_id, term, tf * idf AS w FROM bc JOIN v USING (term)),
    bn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM bw GROUP BY 1),
    dt AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), dc AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
    dw AS (SELECT doc_id, term, tf * idf AS w FROM dc JOIN v USING (term)),
    dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1),
    sc AS (SELECT doc_id AS query_id, item_id AS rule_id, sum(dw.w * bw.w) AS dot FROM dw JOIN bw USING (term) GROUP BY 1, 2),
    cs AS (SELECT query_id, rule_id, dot / dn.n / bn.n AS score FROM sc JOIN dn ON dn.doc_id = query_id JOIN bn ON bn.item_id = rule_id)"""
HITS = " ".join(f", len(list_filter(w, lambda t: list_contains({ks}, t))) AS {c}" for c, ks in CATEGORIES.items())

IDF = f"""WITH t AS (SELECT item_id, unnest({TOK}) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
    SELECT term, round(ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1, 9) AS idf FROM c WHERE length(term) >= 2"""



def NORMAL(name, key):
    """Normalised tokens of a table as rows ``key, tok``."""
    return f"""
        SELECT {key}, tok FROM (
            SELECT {key}, replace(w[i] || ' ' || w[i + 1], ' ', '_') AS tok FROM (SELECT {key}, {TOK} AS w, unnest(range(1, len(w))) AS i FROM {name})
            WHERE w[i] || ' ' || w[i + 1] IN ('de la', 'in the')
            UNION ALL SELECT {key}, unnest(CASE WHEN tok = 'than' THEN ['than', 'alas', 'then'] ELSE [tok] END)
                      FROM (SELECT {key}, unnest({TOK}) AS tok FROM {name}))
        WHERE length(tok) > 2 AND NOT regexp_full_match(tok, '\\d+') AND tok NOT IN {STOP}"""


HYBRID = f"""WITH bt AS ({NORMAL("benchmark", "item_id")}), dt AS ({NORMAL("documents", "doc_id")}),
    bc AS (SELECT item_id, tok, count(*) AS tf FROM bt GROUP BY 1, 2), dc AS (SELECT doc_id, tok, count(*) AS tf FROM dt GROUP BY 1, 2),
    v AS (SELECT tok, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM bc GROUP BY 1),
    bw AS (SELECT item_id, tok, tf * idf AS w FROM bc JOIN v USING (tok)), dw AS (SELECT doc_id, tok, tf * idf AS w FROM dc JOIN v USING (tok)),
    bn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM bw GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1),
    tx AS (SELECT doc_id, item_id, sum(dw.w * bw.w) AS dot FROM dw JOIN bw USING (tok) GROUP BY 1, 2),
    k AS (SELECT count(*) AS k FROM embeddings), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    q AS (SELECT doc_id, e, n, sqrt(list_inner_product(e, e) + CASE WHEN n IS NULL THEN 0 ELSE 1 END) AS len
          FROM documents CROSS JOIN k JOIN e ON vec_id = doc_id % k LEFT JOIN dn USING (doc_id)),
    r AS (SELECT item_id, e, n, sqrt(list_inner_product(e, e) + CASE WHEN n IS NULL THEN 0 ELSE 1 END) AS len
          FROM benchmark CROSS JOIN k JOIN e ON vec_id = (item_id * 7 + 3) % k LEFT JOIN bn USING (item_id)),
    s AS (SELECT doc_id AS query_id, item_id AS rule_id, round((coalesce(dot / q.n / r.n, 0) + list_inner_product(q.e, r.e)) / q.len / r.len, 6) AS score,
                 (coalesce(dot / q.n / r.n, 0) + list_inner_product(q.e, r.e)) / q.len / r.len AS exact
          FROM q CROSS JOIN r LEFT JOIN tx USING (doc_id, item_id)),
    b AS (SELECT query_id, rule_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rule_id) AS INTEGER) AS rank
          FROM s WHERE exact >= 0.3),
    top AS (SELECT * FROM b WHERE rank <= 3),
    sh AS (SELECT query_id, rule_id, string_agg(replace(tok, '_', ' '), ',' ORDER BY tok) AS terms
           FROM top JOIN dc ON doc_id = query_id JOIN bc USING (tok) WHERE item_id = rule_id GROUP BY 1, 2)
    SELECT query_id, rule_id, rank, score, coalesce(terms, '') AS terms FROM top LEFT JOIN sh USING (query_id, rule_id)"""

ORACLE = {
    "hybrid_topk": HYBRID,
    "encoded_texts": """
        SELECT conv_id, turn, array_to_string(list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: length(text) - length(replace(text, v, ''))), ',') AS vector
        FROM conversations""",
    "label_features": f"""
        WITH d AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id)), t AS (SELECT doc_id, unnest({TOK}) AS term FROM d),
        c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
        v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM c WHERE length(term) >= 2 GROUP BY 1),
        w AS (SELECT doc_id, tf * idf AS w FROM c JOIN v USING (term))
        SELECT doc_id, count(*)::INTEGER AS terms, round(max(w) / sqrt(sum(w * w)), 9) AS largest, round(sum(w) / sqrt(sum(w * w)), 9) AS sum FROM w GROUP BY 1""",
    "label_weights": """
        WITH d AS (SELECT quality, toxic FROM documents JOIN labels USING (doc_id)), l AS (SELECT 'quality' AS label, quality AS v FROM d UNION ALL SELECT 'toxic', toxic FROM d),
        c AS (SELECT label, coalesce(sum(v), 0)::BIGINT AS positives, count(*) AS n FROM l GROUP BY 1)
        SELECT label, positives, n, round(n / nullif(2.0::DOUBLE * positives, 0), 12) AS weight_1, round(n / nullif(2.0::DOUBLE * (n - positives), 0), 12) AS weight_0 FROM c""",
    "masked_scores": f"""{COS}, b AS (SELECT count(*) AS n FROM benchmark),
        p AS (SELECT doc_id AS query_id, unnest(list_distinct([doc_id % n, (doc_id * 7 + 1) % n])) AS rule_id, doc_id % 100 / 100 AS score FROM documents, b)
        SELECT query_id, rule_id, p.score FROM p SEMI JOIN (SELECT query_id, rule_id FROM cs WHERE score >= 0.3) m USING (query_id, rule_id)""",
    "text_tokens": f"""
        WITH t AS (SELECT item_id, {TOK} AS w FROM benchmark),
        p AS (SELECT item_id, unnest(range(1, len(w))) AS i, w FROM t),
        x AS (SELECT item_id, replace(w[i] || ' ' || w[i + 1], ' ', '_') AS tok FROM p WHERE w[i] || ' ' || w[i + 1] IN ('de la', 'in the')
              UNION ALL SELECT item_id, unnest(CASE WHEN tok = 'than' THEN ['than', 'alas', 'then'] ELSE [tok] END)
                        FROM (SELECT item_id, unnest(w) AS tok FROM t)),
        f AS (SELECT * FROM x WHERE length(tok) > 2 AND NOT regexp_full_match(tok, '\\d+') AND tok NOT IN {STOP})
        SELECT b.item_id, coalesce(string_agg(tok, ' ' ORDER BY tok), '') AS tokens FROM benchmark b LEFT JOIN f USING (item_id) GROUP BY 1""",
    "term_frequencies": f"""
        WITH t AS (SELECT doc_id, lang, unnest({TOK}) AS term FROM documents)
        SELECT lang, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1, 2""",
    "phrase_counts": f"""
        WITH t AS (SELECT {TOK} AS w FROM conversations), p AS (SELECT w, unnest(range(1, len(w))) AS i FROM t)
        SELECT w[i] || ' ' || w[i + 1] AS phrase, count(*) AS n FROM p WHERE w[i] || ' ' || w[i + 1] IN ('de la', 'in the') GROUP BY 1""",
    "category_assign": f"""
        WITH t AS (SELECT doc_id, {TOK} AS w FROM documents), h AS (SELECT doc_id {HITS} FROM t)
        SELECT doc_id, CASE WHEN greatest(one, two, three) = 0 THEN 'other' WHEN one = greatest(one, two, three) THEN 'one'
               WHEN two = greatest(one, two, three) THEN 'two' ELSE 'three' END AS category FROM h""",
    "vocabulary_idf": f"{IDF} GROUP BY 1",
    "vocabulary_top": f"{IDF} GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 300",
    "tfidf_cosine": f"{COS} SELECT query_id, rule_id, round(score, 7) AS score FROM cs WHERE score >= 0.3",
    "topk_rules": f"""{COS}, r AS (SELECT query_id, rule_id, round(score, 7) AS score FROM cs WHERE score >= 0.3)
        SELECT query_id, rule_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM r WINDOW w AS (
            PARTITION BY query_id ORDER BY score DESC, rule_id) QUALIFY row_number() OVER w <= 3""",
    "recommendation_log": f"""{COS}, r AS (SELECT query_id, rule_id, round(score, 7) AS score FROM cs WHERE score >= 0.5),
        g AS (SELECT query_id, string_agg(CAST(rule_id AS VARCHAR), ';' ORDER BY score DESC, rule_id) AS ids FROM r GROUP BY 1)
        SELECT CAST(doc_id AS VARCHAR) AS query, coalesce(ids, 'None') AS rule_ids FROM documents LEFT JOIN g ON query_id = doc_id""",
    "explain_terms": f"""
        WITH b AS (SELECT item_id, {TOK} AS b FROM benchmark), c AS (SELECT conv_id, turn, {TOK} AS a FROM conversations)
        SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), ',') AS terms
        FROM c JOIN b ON conv_id = item_id""",
    "dense_cosine_topk": """
        WITH p AS (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings),
        m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM p GROUP BY 1, 2), v AS (SELECT label AS rule_id, list(x ORDER BY i) AS c FROM m GROUP BY 1),
        s AS (SELECT vec_id AS query_id, rule_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings, v)
        SELECT query_id, rule_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (
            PARTITION BY query_id ORDER BY score DESC, rule_id) QUALIFY row_number() OVER w <= 3""",
    "model_scores": """
        WITH e AS (SELECT event_id AS query_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT query_id, 'r1' AS rule_id, 1.0::DOUBLE AS score FROM e
        UNION ALL SELECT query_id, 'r' || (k % 40), CAST('0.' || lpad(CAST(k AS VARCHAR), 2, '0') AS DOUBLE) FROM e
                  WHERE k % 40 BETWEEN 2 AND 33 AND k < 100""",
    "score_blend": """
        WITH c AS (SELECT user_id AS query_id, event_type AS rule_id, max(value) / 500 AS c FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
        m AS (SELECT user_id AS query_id, event_type AS rule_id, min(value) / 10 AS m FROM events WHERE event_type <> 'click' GROUP BY 1, 2),
        b AS (SELECT query_id, rule_id, coalesce(c, 0) * 0.3::DOUBLE + coalesce(m, 0) * 0.7::DOUBLE AS s FROM c FULL JOIN m USING (query_id, rule_id))
        SELECT query_id, rule_id, round(s, 9) AS score FROM b WHERE s >= 0.3""",
    "eval_micro_f1": """
        WITH e AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2), t AS (SELECT * FROM e WHERE v > 30),
        p AS (SELECT * FROM e WHERE v > 40 AND user_id % 3 <> 0 OR event_type = 'view'),
        b AS (SELECT DISTINCT user_id FROM t WHERE user_id IN (SELECT user_id FROM p)),
        s AS (SELECT (SELECT count(*) FROM t SEMI JOIN p USING (user_id, event_type)) AS tp,
                     (SELECT count(*) FROM p ANTI JOIN t USING (user_id, event_type) WHERE user_id IN (SELECT user_id FROM b)) AS fp,
                     (SELECT count(*) FROM t ANTI JOIN p USING (user_id, event_type) WHERE user_id IN (SELECT user_id FROM b)) AS fn),
        r AS (SELECT *, tp * 100.0::DOUBLE / (tp + fp) AS precision, tp * 100.0::DOUBLE / (tp + fn) AS recall FROM s)
        SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2.0 * precision * recall / (precision + recall), 9) AS f1 FROM r""",
    "invalid_labels": """
        SELECT event_type AS id FROM events GROUP BY 1 HAVING max(value) > 30 AND max(value) <= 480""",
    "query_augmentation": """
        WITH q AS (SELECT regexp_replace(text, '\\s+', ' ', 'g') AS query, CAST(item_id AS VARCHAR) AS rule_ids FROM benchmark),
        w AS (SELECT *, regexp_split_to_array(query, '\\s+') AS ws FROM q), i AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w),
        s AS (SELECT *, unnest(CASE lower(ws[i]) WHEN 'the' THEN ['das'] WHEN 'and' THEN ['und', 'plus'] WHEN 'der' THEN ['the']
              WHEN 'than' THEN ['alas', 'then'] WHEN 'que' THEN ['what'] ELSE []::VARCHAR[] END) AS s FROM i),
        k AS (SELECT *, row_number() OVER (PARTITION BY rule_ids, query ORDER BY md5('7|' || (i - 1) || '|' || s), i, s) AS n FROM s)
        SELECT query, rule_ids, false AS augmented FROM q
        UNION ALL SELECT DISTINCT array_to_string(list_concat(list_append(ws[1:i - 1], s), ws[i + 1:]), ' '), rule_ids, true FROM k WHERE n <= 20""",
    "synonym_lookup": """
        WITH g AS (SELECT r_regionkey, r_name, list(n_name ORDER BY n_name) AS s FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
        m AS (SELECT r_regionkey, list_prepend(r_name, s) AS members FROM g), u AS (SELECT r_regionkey, members, unnest(members) AS term FROM m)
        SELECT term, array_to_string(max_by(members, r_regionkey), ',') AS members FROM u GROUP BY 1""",
    "synonym_table": """
        SELECT term, string_agg(s, ',' ORDER BY s) AS synonyms FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS term, split_part(p_name, ' ', 1) AS s FROM part)
        GROUP BY 1""",
    "chosen_rules": """
        SELECT p_name AS name, '/node/bm' AS path, p_brand AS severity, p_type AS rule FROM part
        WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""",
}
