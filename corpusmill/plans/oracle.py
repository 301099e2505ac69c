"""DuckDB SQL equal in meaning to each registered query.

Views ``img``/``txt``/... of the bindings are written inline as CTEs so each
statement runs on the raw test tables.  Vectors are cast to DOUBLE[] before any
arithmetic; ranks use scores rounded to 9 decimals, outputs 6.
"""

from __future__ import annotations

from corpusmill.operators.metrics import DATASET_METRIC

# ---- binding CTEs (same definitions as plans/views.py)
IMG = "img AS (SELECT vec_id // 6 AS image_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 6 = 0)"
TXT = ("txt AS (SELECT vec_id AS text_id, vec_id // 6 AS image_id, vec_id % 6 - 1 AS pos, "
       "CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 6 <> 0)")
IMGN = ("imgn AS (SELECT image_id, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y))))"
        " AS vec FROM img)")
TXTN = ("txtn AS (SELECT text_id, image_id, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y))))"
        " AS vec FROM txt)")

SCORES = ("s AS (SELECT t.text_id, t.image_id AS t_img, i.image_id, "
          "list_dot_product(t.vec, i.vec) AS score FROM txtn t, imgn i)")

T2I = ("t2i AS (SELECT text_id, image_id, t_img, row_number() OVER (PARTITION BY text_id "
       "ORDER BY round(score, 9) DESC, image_id) AS rnk FROM s)")
I2T = ("i2t AS (SELECT image_id, text_id, t_img, row_number() OVER (PARTITION BY image_id "
       "ORDER BY round(score, 9) DESC, text_id) AS rnk FROM s)")
KS = "ks AS (SELECT unnest([1, 5, 10])::BIGINT AS k)"

RECALL = f"""
WITH {IMG}, {TXT}, {IMGN}, {TXTN}, {SCORES}, {T2I}, {I2T}, {KS},
a AS (SELECT 'image_retrieval' AS direction, k,
             avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END) AS recall
      FROM (SELECT t.text_id, min(CASE WHEN x.t_img = x.image_id THEN x.rnk END) AS best
            FROM txt t LEFT JOIN t2i x ON x.text_id = t.text_id GROUP BY t.text_id) q, ks GROUP BY k),
b AS (SELECT 'text_retrieval' AS direction, k,
             avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END) AS recall
      FROM (SELECT i.image_id, min(CASE WHEN x.t_img = x.image_id THEN x.rnk END) AS best
            FROM img i LEFT JOIN i2t x ON x.image_id = i.image_id GROUP BY i.image_id) q, ks GROUP BY k),
rep AS (SELECT * FROM a UNION ALL SELECT * FROM b)
"""

ORACLE: dict[str, str] = {}

ORACLE["e10_retrieval_recall"] = RECALL + "SELECT direction, k, round(recall, 6) AS recall FROM rep"

ORACLE["e11_mean_recall"] = RECALL + \
    "SELECT direction, round(avg(recall), 6) AS mean_recall FROM rep GROUP BY direction"

ORACLE["e9_true_recall"] = f"""
WITH {IMG}, {TXT}, {IMGN}, {TXTN}, {SCORES}, {I2T}, {KS},
npos AS (SELECT image_id, count(*) AS n_pos FROM txt GROUP BY image_id),
tp AS (SELECT x.image_id, ks.k, count(*) AS tp FROM i2t x, ks
       WHERE x.t_img = x.image_id AND x.rnk <= ks.k GROUP BY x.image_id, ks.k)
SELECT i.image_id, ks.k,
       round(CAST(coalesce(tp.tp, 0) AS DOUBLE) / CAST(n.n_pos AS DOUBLE), 6) AS recall
FROM img i CROSS JOIN ks
LEFT JOIN npos n ON n.image_id = i.image_id
LEFT JOIN tp ON tp.image_id = i.image_id AND tp.k = ks.k
"""

# ---------------------------------------------------------------- D
CAP = ("cap AS (SELECT t.vec_id AS text_id, t.vec_id // 6 AS image_id, t.vec_id % 6 - 1 AS pos, d.text, "
       "CAST(t.embedding AS DOUBLE[]) AS vec FROM embeddings t LEFT JOIN documents d ON d.doc_id = t.vec_id "
       "WHERE t.vec_id % 6 <> 0)")
D3 = ("d3 AS (SELECT c.image_id, c.pos, c.text, list_dot_product(c.vec, i.vec) / "
      "(sqrt(list_dot_product(c.vec, c.vec)) * sqrt(list_dot_product(i.vec, i.vec))) AS sim "
      "FROM cap c JOIN img i ON i.image_id = c.image_id)")
PAIRS = ("pi AS (SELECT vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 0), "
         "pt AS (SELECT vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 1), "
         "pc AS (SELECT pi.pair_id, list_dot_product(pi.vec, pt.vec) / (sqrt(list_dot_product(pi.vec, pi.vec)) * "
         "sqrt(list_dot_product(pt.vec, pt.vec))) AS sim FROM pi JOIN pt ON pi.pair_id = pt.pair_id)")
CAPS = ("caps AS (SELECT doc_id AS image, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, "
        "unnest(string_split(text, chr(10))) AS text FROM documents), "
        "capsx AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY pos) - 1 AS pos, text "
        "FROM caps WHERE text <> '')")
# TF-IDF over the captions ``capsx`` of each image
WEIGHTS = ("ndocs AS (SELECT image, count(*) AS n FROM capsx GROUP BY image), "
         "tok AS (SELECT image, pos, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM capsx), "
         "tf AS (SELECT image, pos, token, count(*) AS tf FROM tok GROUP BY ALL), "
         "dfq AS (SELECT image, token, count(*) AS df FROM tf GROUP BY ALL), "
         "raw AS (SELECT tf.image, tf.pos, tf.token, tf.tf * (ln((1.0 + n.n) / (1.0 + dfq.df)) + 1.0) AS raw "
         "FROM tf JOIN dfq USING (image, token) JOIN ndocs n USING (image)), "
         "nrm AS (SELECT image, pos, sqrt(sum(raw * raw)) AS nrm FROM raw GROUP BY ALL), "
         "w AS (SELECT raw.image, raw.pos, raw.token, raw.raw / nrm.nrm AS w FROM raw JOIN nrm USING (image, pos))")
TFIDF = f"{CAPS}, {WEIGHTS}"

# Greedy pruning over ``capsx`` and ``w``, one removal a step: ``alive`` has the captions left after each step.
PRUNE = ("sims AS (SELECT a.image, a.pos AS u, b.pos AS v, sum(a.w * b.w) AS sim FROM w a JOIN w b "
         "ON a.image = b.image AND a.token = b.token AND a.pos <> b.pos GROUP BY ALL), "
         "bare AS (SELECT image, pos FROM capsx EXCEPT SELECT image, pos FROM w), "
         "alive AS (SELECT image, pos, 0 AS step FROM capsx "
         "UNION ALL SELECT image, pos, step + 1 FROM ("
         "SELECT image, pos, step, strong, count(*) OVER (PARTITION BY image) AS n, "
         "row_number() OVER (PARTITION BY image ORDER BY round(cost, 9) DESC, pos) AS rn FROM ("
         "SELECT image, pos, step, cost, sum(near) OVER (PARTITION BY image) AS strong FROM ("
         "SELECT a.image, a.pos, a.step, coalesce(sum(s.sim) FILTER (WHERE b.pos IS NOT NULL), 0) "
         "- max(CASE WHEN e.pos IS NULL THEN 0 ELSE 1 END) AS cost, "
         "count(*) FILTER (WHERE b.pos IS NOT NULL AND s.sim > 0.3) AS near FROM alive a "
         "LEFT JOIN sims s ON s.image = a.image AND s.u = a.pos "
         "LEFT JOIN alive b ON b.image = s.image AND b.pos = s.v "
         "LEFT JOIN bare e ON e.image = a.image AND e.pos = a.pos GROUP BY a.image, a.pos, a.step))) "
         "WHERE strong > 0 AND n > 3 AND rn > 1), "
         "kept AS (SELECT image, pos FROM (SELECT *, max(step) OVER (PARTITION BY image) AS last FROM alive) WHERE step = last)")

ORACLE["d1_l2_normalize"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
x AS (SELECT vec_id, nrm, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM n)
SELECT vec_id, dim, CASE WHEN nrm > 0 THEN round(x / nrm, 6) END AS x, nrm = 0 AS is_zero FROM x
"""

ORACLE["d2_paired_cosine"] = f"WITH {PAIRS} SELECT pair_id, round(sim, 6) AS sim FROM pc"

ORACLE["d3_one_to_many_cosine"] = f"WITH {IMG}, {CAP}, {D3} SELECT image_id, pos, round(sim, 6) AS sim FROM d3"

ORACLE["d4_filter_pairs"] = f"""
WITH {PAIRS}
SELECT row_number() OVER (ORDER BY pair_id) - 1 AS idx, pair_id, round(sim, 6) AS sim
FROM pc WHERE round(sim, 9) >= 0.2
"""

ORACLE["d5_caption_pool"] = f"""
WITH {IMG}, {CAP}, {D3},
lists AS (SELECT image_id, list(text ORDER BY pos) FILTER (WHERE pos < 2) AS orig,
                 list(text ORDER BY pos) FILTER (WHERE pos >= 2) AS gen FROM d3 GROUP BY image_id),
pool AS (SELECT image_id, list_concat(coalesce(orig, []), coalesce(gen[1:2], [])) AS pool FROM lists)
SELECT image_id, generate_subscripts(pool, 1) - 1 AS idx, unnest(pool) AS text FROM pool
"""

ORACLE["d6_filter_by_ranking"] = f"""
WITH {IMG}, {CAP}, {D3},
r AS (SELECT image_id, pos, row_number() OVER (PARTITION BY image_id ORDER BY round(sim, 9) DESC, pos DESC) AS rn,
             least(3, count(*) OVER (PARTITION BY image_id)) AS m FROM d3)
SELECT image_id, m - rn AS out_pos, pos AS src_pos FROM r WHERE rn <= 3
"""

ORACLE["d7_filter_by_threshold"] = f"""
WITH {IMG}, {CAP}, {D3}
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1 AS out_pos, pos AS src_pos
FROM d3 WHERE round(sim, 9) >= 0.2
"""

ORACLE["d12_drop_empty"] = f"""
WITH {IMG}, {CAP}, {D3}
SELECT image_id, count(*) AS n_kept FROM d3 WHERE round(sim, 9) >= 0.2 GROUP BY image_id
"""

ORACLE["d13_random_caption"] = f"""
WITH {IMG}, {CAP}, {D3},
n AS (SELECT image_id, count(*) AS n FROM d3 GROUP BY image_id)
SELECT image_id, n, ('0x' || substr(md5(concat_ws('|', image_id, 7, 1)), 1, 8))::BIGINT % n AS pick FROM n
"""

ORACLE["d8_tfidf"] = f"WITH {TFIDF} SELECT image, pos, token, round(w, 6) AS w FROM w"

ORACLE["d9_caption_pair_similarity"] = f"""
WITH {TFIDF}
SELECT a.image, a.pos AS pos_a, b.pos AS pos_b, round(sum(a.w * b.w), 6) AS sim
FROM w a JOIN w b ON a.image = b.image AND a.token = b.token AND a.pos < b.pos
GROUP BY a.image, a.pos, b.pos
"""

ORACLE["d9_similar_pairs"] = f"""
WITH {TFIDF}
SELECT a.image, a.pos AS pos_a, b.pos AS pos_b, round(sum(a.w * b.w), 6) AS sim
FROM w a JOIN w b ON a.image = b.image AND a.token = b.token AND a.pos < b.pos
GROUP BY a.image, a.pos, b.pos HAVING sum(a.w * b.w) > 0.3
"""

ORACLE["d10_diversity_pruning"] = f"WITH RECURSIVE {TFIDF}, {PRUNE} SELECT image, pos FROM kept"

ORACLE["d11_threshold_diversity"] = f"""
WITH RECURSIVE {IMG}, {CAP}, {D3}, capsx AS (SELECT image_id AS image, pos, text FROM d3 WHERE round(sim, 9) >= 0.15),
{WEIGHTS}, {PRUNE} SELECT image, pos FROM kept
"""

ORACLE["d15_batches"] = """
WITH h AS (SELECT doc_id, ('0x' || substr(md5(concat_ws('|', doc_id, 3, 0)), 1, 8))::BIGINT AS h FROM documents),
i AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS idx FROM h)
SELECT doc_id, idx, idx // 64 AS batch_id, idx % 64 AS slot FROM i
"""

# One recursion step is one round; a number that is too large after the last round goes on with the first.
ORACLE["d15_permuted_batches"] = """
WITH RECURSIVE i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
c AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
s AS (SELECT n, a, (n + a - 1) // a AS b FROM c),
k AS (SELECT j, ('0x' || substr(md5('3|2|' || j), 1, 8))::BIGINT % 2147483647 AS key FROM (SELECT unnest(range(0, 8)) AS j)),
w AS (
  SELECT doc_id, idx, idx % a AS l, idx // a AS r, 0 AS round, n, a, b FROM i, s
  UNION ALL
  SELECT doc_id, idx, CASE WHEN j % 2 = 0 THEN (l + f) % a ELSE l END, CASE WHEN j % 2 = 1 THEN (r + f) % b ELSE r END, j + 1, n, a, b
  FROM (SELECT *, (xor(z, z >> 15) * 69621) % 2147483647 AS f
        FROM (SELECT w.*, k.j, ((CASE WHEN k.j % 2 = 0 THEN r ELSE l END) * 48271 + key) % 2147483647 AS z
              FROM w JOIN k ON k.j = w.round % 8 WHERE NOT (w.round = 8 AND l + a * r < n))))
SELECT doc_id, idx, l + a * r AS place, (l + a * r) // 64 AS batch_id, (l + a * r) % 64 AS slot
FROM w WHERE round = 8 AND l + a * r < n
"""

# ---------------------------------------------------------------- E / F
PR = "pr AS (SELECT vec_id AS prompt_id, CAST(label AS BIGINT) AS class_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 5 = 0)"
TI = ("ti AS (SELECT vec_id AS image_id, CAST(label AS BIGINT) AS target, CAST(embedding AS DOUBLE[]) AS vec "
      "FROM embeddings WHERE vec_id % 5 <> 0)")
TIN = "tin AS (SELECT image_id, target, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM ti)"


def proto_cte(variant: str, src: str = "pr", name: str = "proto", keys: str = "class_idx") -> str:
    """Prototype CTEs: a = normalise, mean, normalise; b = mean, normalise
    unless one prompt; c = mean, normalise."""
    if variant == "a":
        first = f"{name}_n AS (SELECT {keys}, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS v FROM {src})"
    else:
        first = f"{name}_n AS (SELECT {keys}, vec AS v FROM {src})"
    body = (f"{first}, "
            f"{name}_d AS (SELECT {keys}, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM {name}_n), "
            f"{name}_m AS (SELECT {keys}, dim, avg(x) AS m, count(*) AS cnt FROM {name}_d GROUP BY ALL), "
            f"{name}_l AS (SELECT {keys}, list(m ORDER BY dim) AS v, max(cnt) AS n_prompts FROM {name}_m GROUP BY ALL), ")
    if variant == "b":
        out = (f"{name} AS (SELECT {keys}, CASE WHEN n_prompts = 1 THEN v ELSE "
               f"list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS vec FROM {name}_l)")
    else:
        out = f"{name} AS (SELECT {keys}, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM {name}_l)"
    return body + out


CLS = (f"{PR}, {TI}, {TIN}, {proto_cte('a')}, "
       "sc AS (SELECT t.image_id, p.class_idx, 100.0 * list_dot_product(t.vec, p.vec) AS logit FROM tin t, proto p), "
       "scr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(logit, 9) DESC, class_idx) AS rnk FROM sc), "
       "pb AS (SELECT image_id, class_idx, logit, logit - max(logit) OVER (PARTITION BY image_id) AS sh FROM sc), "
       "probs AS (SELECT image_id, class_idx, logit, exp(sh) / sum(exp(sh)) OVER (PARTITION BY image_id) AS prob, "
       "sh - ln(sum(exp(sh)) OVER (PARTITION BY image_id)) AS log_prob FROM pb), "
       "preds AS (SELECT p.image_id, arg_max(p.class_idx, (round(p.prob, 9), -p.class_idx)) AS pred, max(p.prob) AS confidence, "
       "any_value(t.target) AS target FROM probs p JOIN ti t USING (image_id) GROUP BY p.image_id)")

MAP = ("lab AS (SELECT p.image_id, p.class_idx, p.log_prob, CASE WHEN p.class_idx = t.target THEN 1 ELSE 0 END AS present "
       "FROM probs p JOIN ti t USING (image_id)), "
       "o AS (SELECT class_idx, row_number() OVER w AS rnk, sum(present) OVER w AS tp, "
       "sum(present) OVER (PARTITION BY class_idx) AS npos FROM lab "
       "WINDOW w AS (PARTITION BY class_idx ORDER BY round(log_prob, 9) DESC, image_id ROWS UNBOUNDED PRECEDING)), "
       "r AS (SELECT class_idx, CAST(tp AS DOUBLE) / rnk AS prec, (tp * 10) // npos AS tmax FROM o WHERE npos > 0), "
       "ts AS (SELECT unnest(range(0, 11)) AS i), "
       "ip AS (SELECT r.class_idx, ts.i, max(prec) AS p FROM r JOIN ts ON r.tmax >= ts.i GROUP BY ALL), "
       "ap AS (SELECT class_idx, sum(p) / 11.0 AS ap FROM ip GROUP BY class_idx), "
       "mapr AS (SELECT avg(ap) AS map, count(*) AS classes FROM ap)")

BIN = "bin AS (SELECT l.doc_id, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))"
AUC = (f"{BIN}, g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, "
       "sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n FROM bin GROUP BY score), "
       "cg AS (SELECT p, n, sum(n) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn FROM g), "
       "aucr AS (SELECT sum(p * (cn - n + n / 2.0)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM cg)")

ORACLE["e1_prompt_expansion"] = """
WITH c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS class_idx
           FROM (SELECT DISTINCT event_type AS name FROM events)),
t AS (SELECT generate_subscripts(l, 1) - 1 AS tpl_idx, unnest(l) AS template
      FROM (SELECT ['an event of type {}', 'one [CLASS] in the log', 'someone triggered {} today.'] AS l))
SELECT c.class_idx, t.tpl_idx, replace(replace(t.template, '{}', c.name), '[CLASS]', c.name) AS prompt FROM c, t
"""

ORACLE["e2_first_alias"] = "SELECT item_id AS class_idx, string_split(text, ' ')[1] AS name FROM benchmark"

ORACLE["e3_class_prototypes"] = f"""
WITH {PR}, {proto_cte('a', name='pa')}, {proto_cte('b', name='pb')}, {proto_cte('c', name='pc')},
u AS (SELECT class_idx, 'a' AS variant, vec FROM pa UNION ALL SELECT class_idx, 'b', vec FROM pb
      UNION ALL SELECT class_idx, 'c', vec FROM pc)
SELECT class_idx, variant, generate_subscripts(vec, 1) - 1 AS dim, round(unnest(vec), 6) AS x FROM u
"""

ORACLE["e4_scaled_logits"] = f"WITH {CLS} SELECT image_id, class_idx, round(logit, 6) AS logit FROM sc"
ORACLE["e5_softmax"] = f"WITH {CLS} SELECT image_id, class_idx, round(prob, 6) AS prob FROM probs"
ORACLE["e5_predictions"] = f"WITH {CLS} SELECT image_id, pred, round(confidence, 6) AS confidence, target FROM preds"
ORACLE["e6_topk_classes"] = f"WITH {CLS} SELECT image_id, rnk AS rank, class_idx FROM scr WHERE rnk <= 5"

ORACLE["e7_text_to_image"] = f"""
WITH {IMG}, {TXT}, {IMGN}, {TXTN}, {SCORES},
r AS (SELECT text_id, image_id, score, row_number() OVER (PARTITION BY text_id ORDER BY round(score, 9) DESC, image_id) AS rnk FROM s)
SELECT text_id, rnk AS rank, image_id, round(score, 6) AS score FROM r WHERE rnk <= 5
"""

ORACLE["e8_image_to_text"] = f"""
WITH {IMG}, {TXT}, {IMGN}, {TXTN}, {SCORES},
r AS (SELECT image_id, text_id, score, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, text_id) AS rnk FROM s)
SELECT image_id, rnk AS rank, text_id, round(score, 6) AS score FROM r WHERE rnk <= 5
"""

ORACLE["e7_text_to_image_pruned"] = ORACLE["e7_text_to_image"]
ORACLE["e8_image_to_text_pruned"] = ORACLE["e8_image_to_text"]

ORACLE["e12_topk_accuracy"] = f"""
WITH {CLS}, ks AS (SELECT unnest([1, 5, 10])::BIGINT AS k),
h AS (SELECT t.image_id, s.rnk FROM ti t LEFT JOIN scr s ON s.image_id = t.image_id AND s.class_idx = t.target),
pk AS (SELECT k, avg(CASE WHEN rnk <= k THEN 1.0 ELSE 0.0 END) AS accuracy FROM h, ks GROUP BY k)
SELECT k, round(accuracy, 6) AS accuracy FROM pk
UNION ALL SELECT 0::BIGINT AS k, round(avg(accuracy), 6) FROM pk
"""

ORACLE["e13_class_subset"] = f"""
WITH {PR}, {TI}, sub AS (SELECT generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS class_idx FROM (SELECT [2, 4, 6, 8] AS l)),
tis AS (SELECT t.image_id, s.pos AS target, list_transform(t.vec, lambda x: x / sqrt(list_dot_product(t.vec, t.vec))) AS vec
        FROM ti t JOIN sub s ON t.target = s.class_idx),
prs AS (SELECT s.pos AS class_idx, p.vec FROM pr p JOIN sub s ON p.class_idx = s.class_idx),
{proto_cte('a', src='prs')},
sc AS (SELECT t.image_id, t.target, p.class_idx, 100.0 * list_dot_product(t.vec, p.vec) AS logit FROM tis t, proto p),
top1 AS (SELECT image_id, target, class_idx, row_number() OVER (PARTITION BY image_id ORDER BY round(logit, 9) DESC, class_idx) AS rnk FROM sc)
SELECT round(CAST(sum(CASE WHEN class_idx = target THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS accuracy, count(*) AS n_images
FROM top1 WHERE rnk = 1
"""

SWEEP = (f"{PR}, {TI}, lg AS (SELECT doc_id AS vec_id, lang FROM documents), "
         "pre AS (SELECT lg.lang, p.prompt_id, p.class_idx, p.vec FROM pr p JOIN lg ON lg.vec_id = p.prompt_id), "
         "prl AS (SELECT lang, 'ensemble' AS prompt_set, class_idx, vec FROM pre UNION ALL "
         "SELECT lang, 'label', class_idx, arg_min(vec, prompt_id) FROM pre GROUP BY lang, class_idx), "
         "til AS (SELECT lg.lang, ps.prompt_set, t.image_id, t.target, "
         "list_transform(t.vec, lambda x: x / sqrt(list_dot_product(t.vec, t.vec))) AS vec FROM ti t JOIN lg ON lg.vec_id = t.image_id "
         "CROSS JOIN (SELECT unnest(['ensemble', 'label']) AS prompt_set) ps), "
         f"{proto_cte('a', src='prl', keys='lang, prompt_set, class_idx')}")

ORACLE["e14_sweep_accuracy"] = f"""
WITH {SWEEP},
sc AS (SELECT t.lang, t.prompt_set, t.image_id, t.target, p.class_idx,
              row_number() OVER (PARTITION BY t.lang, t.prompt_set, t.image_id
                                 ORDER BY round(100.0 * list_dot_product(t.vec, p.vec), 9) DESC, p.class_idx) AS rnk
       FROM til t JOIN proto p ON p.lang = t.lang AND p.prompt_set = t.prompt_set),
h AS (SELECT t.lang, t.prompt_set, t.image_id, s.rnk FROM til t
      LEFT JOIN sc s ON s.lang = t.lang AND s.prompt_set = t.prompt_set AND s.image_id = t.image_id AND s.class_idx = t.target),
ks AS (SELECT unnest([1, 5])::BIGINT AS k),
pk AS (SELECT lang, prompt_set, k, avg(CASE WHEN rnk <= k THEN 1.0 ELSE 0.0 END) AS accuracy FROM h, ks GROUP BY ALL)
SELECT lang, prompt_set, k, round(accuracy, 6) AS accuracy FROM pk
UNION ALL SELECT lang, prompt_set, 0::BIGINT, round(avg(accuracy), 6) FROM pk GROUP BY lang, prompt_set
"""

ORACLE["e14_sweep_skipped"] = f"""
WITH {SWEEP}, req AS (SELECT l.lang, p.prompt_set FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'pt']) AS lang) l
                      CROSS JOIN (SELECT unnest(['ensemble', 'label']) AS prompt_set) p)
SELECT r.lang, r.prompt_set FROM req r WHERE NOT EXISTS (SELECT 1 FROM prl p WHERE p.lang = r.lang AND p.prompt_set = r.prompt_set)
"""

ORACLE["e15_vocabulary"] = """
WITH r AS (SELECT conv_id, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations)
SELECT conv_id AS class_id, arg_max(role, pos) AS name, min(pos) AS first_pos FROM r GROUP BY conv_id
"""

ORACLE["e16_gather"] = """
WITH idx AS (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos, doc_id AS idx FROM labels)
SELECT i.pos, d.doc_id, d.lang FROM idx i JOIN documents d ON d.doc_id = i.idx
"""

ORACLE["e17_multi_hot"] = """
WITH c AS (SELECT class_name, row_number() OVER (ORDER BY class_name) - 1 AS class_idx
           FROM (SELECT DISTINCT event_type AS class_name FROM events)),
im AS (SELECT DISTINCT user_id AS image FROM events),
p AS (SELECT DISTINCT user_id AS image, event_type AS class_name FROM events)
SELECT im.image, c.class_idx, c.class_name, CASE WHEN p.image IS NULL THEN 0 ELSE 1 END::BIGINT AS present
FROM im CROSS JOIN c LEFT JOIN p ON p.image = im.image AND p.class_name = c.class_name
"""

ORACLE["f1_accuracy"] = f"WITH {CLS} SELECT round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds"

ORACLE["f2_mean_per_class"] = f"""
WITH {CLS}, pc AS (SELECT target, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS r FROM preds GROUP BY target)
SELECT round(avg(r), 6) AS mean_per_class FROM pc
"""

ORACLE["f3_map_11_point"] = f"WITH {CLS}, {MAP} SELECT round(map, 6) AS map, classes FROM mapr"

ORACLE["f4_roc_auc"] = f"WITH {AUC} SELECT round(auc, 6) AS auc FROM aucr"

# The metric of each dataset, as in operators/metrics.py.
METRIC_OF = ("meta AS (SELECT unnest(map_keys(m)) AS dataset, unnest(map_values(m)) AS metric FROM (SELECT MAP {"
             + ", ".join(f"'{k}': '{v}'" for k, v in sorted(DATASET_METRIC.items())) + "} AS m))")
NAMES = "[" + ", ".join(f"'{k}'" for k in sorted(DATASET_METRIC)) + "]"
BY_DATASET = (f"{METRIC_OF}, {PR}, {TI}, prd AS (SELECT *, {NAMES}[(prompt_id // 5) % 20 + 1] AS dataset FROM pr), "
              f"tid AS (SELECT image_id, target, {NAMES}[(image_id // 5) % 20 + 1] AS dataset, "
              "list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM ti), "
              f"{proto_cte('a', src='prd', keys='dataset, class_idx')}, "
              "sc AS (SELECT t.dataset, t.image_id, t.target, p.class_idx, 100.0 * list_dot_product(t.vec, p.vec) AS logit "
              "FROM tid t JOIN proto p ON p.dataset = t.dataset), "
              "pd AS (SELECT dataset, image_id, any_value(target) AS target, "
              "arg_max(class_idx, (round(logit, 9), -class_idx)) AS pred FROM sc GROUP BY dataset, image_id), "
              "lp AS (SELECT *, logit - max(logit) OVER w - ln(sum(exp(logit - 100.0)) OVER w) - 100.0 + max(logit) OVER w AS log_prob "
              "FROM sc WINDOW w AS (PARTITION BY dataset, image_id)), "
              "lab AS (SELECT dataset, image_id, class_idx, log_prob, CASE WHEN class_idx = target THEN 1 ELSE 0 END AS present FROM lp), "
              "o AS (SELECT dataset, class_idx, row_number() OVER w AS rnk, sum(present) OVER w AS tp, "
              "sum(present) OVER (PARTITION BY dataset, class_idx) AS npos FROM lab "
              "WINDOW w AS (PARTITION BY dataset, class_idx ORDER BY round(log_prob, 9) DESC, image_id ROWS UNBOUNDED PRECEDING)), "
              "r AS (SELECT dataset, class_idx, CAST(tp AS DOUBLE) / rnk AS prec, (tp * 10) // npos AS tmax FROM o WHERE npos > 0), "
              "ts AS (SELECT unnest(range(0, 11)) AS i), "
              "ip AS (SELECT r.dataset, r.class_idx, ts.i, max(prec) AS p FROM r JOIN ts ON r.tmax >= ts.i GROUP BY ALL), "
              "ap AS (SELECT dataset, class_idx, sum(p) / 11.0 AS ap FROM ip GROUP BY dataset, class_idx)")

ORACLE["f5_metric_dispatch"] = f"""
WITH {BY_DATASET}, {AUC.replace("JOIN documents d USING (doc_id))", "JOIN documents d USING (doc_id) WHERE doc_id % 3 = 0)")},
res AS (SELECT dataset, 'accuracy' AS metric, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS value FROM pd GROUP BY dataset
        UNION ALL
        SELECT dataset, 'mean-per-class', avg(r) FROM
          (SELECT dataset, target, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS r FROM pd GROUP BY dataset, target) GROUP BY dataset
        UNION ALL SELECT dataset, '11point_mAP', avg(ap) FROM ap GROUP BY dataset
        UNION ALL SELECT 'hateful-memes', 'roc_auc', auc FROM aucr)
SELECT dataset, metric, round(value * 100.0, 6) AS result FROM meta JOIN res USING (dataset, metric)
"""

ORACLE["f6_dataset_registry"] = f"""
WITH e AS (SELECT {NAMES}[(vec_id // 5) % 20 + 1] AS name, label, vec_id % 5 = 0 AS prompt FROM embeddings),
n AS (SELECT name, 'classification' AS type, count(DISTINCT label) AS num_classes,
             count(*) FILTER (WHERE prompt) AS train, count(*) FILTER (WHERE NOT prompt) AS test FROM e GROUP BY name)
SELECT name, type, num_classes, 'train' AS split, train AS num_images FROM n
UNION ALL SELECT name, type, num_classes, 'test', test FROM n
"""

INB = ("pi AS (SELECT vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 0), "
       "pt AS (SELECT vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 1), "
       "pp AS (SELECT pi.pair_id FROM pi JOIN pt USING (pair_id)), "
       "b AS (SELECT a.pair_id // 50 AS batch_id, a.pair_id AS i, c.pair_id AS j, 20.0 * list_dot_product(a.vec, c.vec) AS l "
       "FROM pi a JOIN pt c ON a.pair_id // 50 = c.pair_id // 50 "
       "WHERE a.pair_id IN (SELECT pair_id FROM pp) AND c.pair_id IN (SELECT pair_id FROM pp)), "
       "mr AS (SELECT batch_id, i, max(l) AS m FROM b GROUP BY ALL), "
       "lr AS (SELECT b.batch_id, b.i, any_value(mr.m) + ln(sum(exp(b.l - mr.m))) AS lse FROM b JOIN mr USING (batch_id, i) GROUP BY ALL), "
       "mc AS (SELECT batch_id, j, max(l) AS m FROM b GROUP BY ALL), "
       "lc AS (SELECT b.batch_id, b.j, any_value(mc.m) + ln(sum(exp(b.l - mc.m))) AS lse FROM b JOIN mc USING (batch_id, j) GROUP BY ALL), "
       "dg AS (SELECT batch_id, i, l FROM b WHERE i = j), "
       "ce AS (SELECT d.batch_id, avg(lr.lse - d.l) AS ce_r, avg(lc.lse - d.l) AS ce_c FROM dg d "
       "JOIN lr ON lr.batch_id = d.batch_id AND lr.i = d.i JOIN lc ON lc.batch_id = d.batch_id AND lc.j = d.i GROUP BY d.batch_id), "
       "ar AS (SELECT batch_id, i, j, row_number() OVER (PARTITION BY batch_id, i ORDER BY l DESC, j) AS rr, "
       "row_number() OVER (PARTITION BY batch_id, j ORDER BY l DESC, i) AS rc FROM b)")

ORACLE["f7_contrastive_loss"] = f"WITH {INB} SELECT batch_id, round((ce_r + ce_c) / 2.0, 6) AS loss FROM ce"

ORACLE["f8_in_batch_accuracy"] = f"""
WITH {INB}
SELECT batch_id,
       round(CAST(sum(CASE WHEN rr = 1 AND i = j THEN 1 ELSE 0 END) AS DOUBLE) / count(DISTINCT i), 6) AS acc_image,
       round(CAST(sum(CASE WHEN rc = 1 AND i = j THEN 1 ELSE 0 END) AS DOUBLE) / count(DISTINCT j), 6) AS acc_text
FROM ar GROUP BY batch_id
"""

ORACLE["f9_classification_loss"] = f"""
WITH {CLS},
m AS (SELECT image_id, max(logit) AS m FROM sc GROUP BY image_id),
l AS (SELECT s.image_id, any_value(m.m) + ln(sum(exp(s.logit - m.m))) AS lse FROM sc s JOIN m USING (image_id) GROUP BY s.image_id),
t AS (SELECT s.image_id, s.logit AS tl FROM sc s JOIN ti USING (image_id) WHERE s.class_idx = ti.target),
top AS (SELECT image_id, class_idx FROM scr WHERE rnk = 1)
SELECT round(avg(l.lse - t.tl), 6) AS loss,
       round(avg(CASE WHEN top.class_idx = ti.target THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM l JOIN t USING (image_id) JOIN top USING (image_id) JOIN ti USING (image_id)
"""

ORACLE["f10_run_summary"] = """
WITH per AS (SELECT lang AS model, source AS dataset, avg(CAST(n_chars AS DOUBLE)) AS mean,
                    stddev_samp(CAST(n_chars AS DOUBLE)) AS std, count(*) AS runs FROM documents GROUP BY ALL),
u AS (SELECT * FROM per UNION ALL
      SELECT model, '__average__', avg(mean), NULL::DOUBLE, NULL::BIGINT FROM per GROUP BY model),
b AS (SELECT dataset, mean AS bm FROM u WHERE model = 'en')
SELECT u.model, u.dataset, round(u.mean, 6) AS mean, round(u.std, 6) AS std, u.runs, round(u.mean - b.bm, 6) AS diff
FROM u LEFT JOIN b USING (dataset)
"""

# ---------------------------------------------------------------- B / C / A
STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
CONV = "conv AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row FROM conversations)"
ZIP = (f"{CONV}, "
       "z AS (SELECT o.row AS pos, o.conv_id AS image_id, o.text AS en, o.role AS pt1, d.text AS pt2 "
       "FROM conv o JOIN documents d ON d.doc_id = o.row)")
PAGES = "pg AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS caption FROM pages)"
LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"

ORACLE["b1_positional_zip"] = f"WITH {ZIP} SELECT pos, image_id, length(en) AS en_len, pt1, length(pt2) AS pt2_len FROM z"

ORACLE["b2_group_captions"] = f"""
WITH {ZIP},
io AS (SELECT image_id, min(pos) AS image_order FROM z GROUP BY image_id),
en AS (SELECT image_id, 'en' AS lang, row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1 AS idx, en AS text FROM z),
ptx AS (SELECT image_id, pos, 0 AS sub, pt1 AS t FROM z UNION ALL SELECT image_id, pos, 1, trim(pt2, {STRIP}) FROM z),
pt AS (SELECT image_id, 'pt' AS lang, row_number() OVER (PARTITION BY image_id ORDER BY pos, sub) - 1 AS idx, t AS text FROM ptx)
SELECT u.image_id, io.image_order, u.lang, u.idx, md5(u.text) AS text_md5
FROM (SELECT * FROM en UNION ALL SELECT * FROM pt) u JOIN io USING (image_id)
"""

ORACLE["b3_split_translations"] = f"""
WITH {CONV},
im AS (SELECT 'doc' || doc_id AS image, {LINES} AS en FROM documents WHERE source = 'src1'),
tr AS (SELECT row, left(img, length(img) - 2) AS image, text FROM
       (SELECT row, 'doc' || conv_id || '#' || turn AS img, text FROM conv)),
trs AS (SELECT image, list(text ORDER BY row) AS pt FROM tr WHERE image IN (SELECT image FROM im) GROUP BY image),
s AS (SELECT im.image, im.en, coalesce(trs.pt, []) AS pt FROM im LEFT JOIN trs USING (image)),
e AS (SELECT image, 'en' AS lang, CASE WHEN len(en) = 0 THEN [NULL] ELSE en END AS l FROM s
      UNION ALL SELECT image, 'pt', CASE WHEN len(pt) = 0 THEN [NULL] ELSE pt END FROM s)
SELECT image, lang, CASE WHEN l[1] IS NULL AND len(l) = 1 THEN NULL ELSE generate_subscripts(l, 1) - 1 END AS idx,
       md5(unnest(l)) AS text_md5 FROM e
"""

ORACLE["b4_select_split"] = """
SELECT 'doc' || doc_id AS image, md5(text) AS caption_md5, 1::BIGINT AS n_pt, 0::BIGINT AS n_en
FROM documents WHERE source = 'src3'
"""

B5 = (f"{PAGES}, s AS (SELECT lpad(CAST(page_id // 10000 AS VARCHAR), 5, '0') || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') AS key, "
      "caption, page_id FROM pg), "
      "j AS (SELECT s.key, s.caption, s.page_id AS row, d.text AS t1, b.text AS t2 FROM s "
      "LEFT JOIN documents d ON d.doc_id = s.page_id LEFT JOIN benchmark b ON b.item_id = s.page_id)")

ORACLE["b5_insert_translations"] = f"""
WITH {B5},
ok AS (SELECT * FROM j WHERE t1 IS NOT NULL AND t2 IS NOT NULL)
SELECT key, 'en' AS lang, 0::BIGINT AS idx, md5(caption) AS text_md5 FROM ok WHERE caption IS NOT NULL
UNION ALL SELECT key, 'pt', 0::BIGINT, md5(t1) FROM ok
UNION ALL SELECT key, 'pt', 1::BIGINT, md5(trim(t2, {STRIP})) FROM ok
"""

ORACLE["b5_missing_rows"] = f"WITH {B5} SELECT key, row FROM j WHERE t1 IS NULL OR t2 IS NULL"

ORACLE["b6_dedup_first"] = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"

ORACLE["b7_image_id"] = f"""
WITH {PAGES}
SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)$', 1), ''), 'p' || page_id) AS image_id FROM pg
"""

B8 = ("b8 AS (SELECT doc_id AS image, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS caption "
      f"FROM (SELECT doc_id, {LINES} AS l FROM documents))")

ORACLE["b8_explode_for_translation"] = f"WITH {B8} SELECT image, pos, md5(caption) AS caption_md5 FROM b8"

ORACLE["b9_partitioned_export"] = f"""
WITH {B8}, i AS (SELECT image, pos, row_number() OVER (ORDER BY image, pos) - 1 AS idx FROM b8)
SELECT image, pos, idx, idx // 1000 AS part FROM i
"""

ORACLE["b10_merge_translations"] = f"""
WITH {CONV},
tr AS (SELECT trim(' ' || CAST(conv_id AS VARCHAR), {STRIP}) AS image, row, trim(text, {STRIP}) AS t FROM conv),
s AS (SELECT CAST(doc_id AS VARCHAR) AS image FROM documents),
j AS (SELECT s.image, tr.row, tr.t FROM s LEFT JOIN tr USING (image))
SELECT image, CASE WHEN t IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY image ORDER BY row) - 1 END AS idx,
       md5(t) AS text_md5 FROM j
"""

ORACLE["b11_quarantine"] = f"""
WITH {PAGES}
SELECT page_id, CASE WHEN NOT coalesce(caption <> '', false) THEN 'no_title'
                     WHEN NOT coalesce(NOT regexp_matches(caption, '[%*#]{{3}}'), false) THEN 'junk_title' END AS reject_reason
FROM pg
"""

ORACLE["b12_union_datasets"] = """
SELECT 'documents' AS source, doc_id AS id, length(text) AS n_chars, lang FROM documents
UNION ALL SELECT 'benchmark', item_id, length(text), NULL FROM benchmark
"""

ORACLE["b13_language_select"] = f"""
WITH s AS (SELECT doc_id, {LINES} AS l FROM documents WHERE lang = 'fr')
SELECT doc_id, generate_subscripts(l, 1) - 1 AS idx, md5(unnest(l)) AS text_md5 FROM s
"""

ORACLE["b14_translator_slice"] = """
WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT conv_id, text, p FROM r WHERE n = 1 OR p % 2 = 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS idx, md5(text) AS text_md5 FROM k
"""

ORACLE["c2_caption_fanout"] = f"""
WITH {PAGES},
pr AS (SELECT generate_subscripts(l, 1) - 1 AS prompt_idx, unnest(l) AS prompt FROM (SELECT
  ['the foreground features', 'a photo of', 'a picture of', 'this is a scene depicting', 'an image of',
   'portrait of a', 'this image captures a moment of', 'a painting of', 'an art of', 'the picture shows'] AS l))
SELECT pg.page_id AS image, pr.prompt_idx, pr.prompt || ' ' || trim(pg.caption, {STRIP}) AS caption FROM pg, pr
"""

ORACLE["c2_caption_lists"] = (
    "SELECT image, count(*) AS n, md5(string_agg(caption, '|' ORDER BY prompt_idx)) AS captions_md5 FROM ("
    + ORACLE["c2_caption_fanout"] + ") GROUP BY image")

ORACLE["c3_translate_memory"] = """
SELECT concat_ws('_', conv_id, turn) AS key, md5(text) AS original_md5, md5('>>por<< ' || text) AS translated_md5,
       'conversations' AS dataset_name FROM conversations
"""

ORACLE["c3_kept_memory"] = """
SELECT concat_ws('_', conv_id, turn) AS key, md5(text) AS original_md5, md5('>>por<< ' || text) AS translated_md5,
       CASE WHEN text IS NULL THEN NULL WHEN text IN (SELECT text FROM conversations WHERE role = 'user' AND text IS NOT NULL)
            THEN 'users' ELSE 'all' END AS run FROM conversations
"""

ORACLE["c4_masked_mean_pool"] = f"""
WITH {TXT},
d AS (SELECT image_id AS id, CASE WHEN pos < 4 THEN 1.0 ELSE 0.0 END AS m, generate_subscripts(vec, 1) - 1 AS dim,
             unnest(vec) AS x FROM txt)
SELECT id, dim, round(CASE WHEN sum(m) = 0 THEN NULL ELSE sum(m * x) / sum(m) END, 6) AS x FROM d GROUP BY id, dim
"""

ORACLE["a2_sharded_sink"] = """
WITH i AS (SELECT doc_id AS image, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT idx, idx // 10000 AS shard, 'sample' || lpad(CAST(idx AS VARCHAR), 5, '0') AS key, image FROM i
"""

ORACLE["a3_resume"] = """
WITH t AS (SELECT doc_id AS image FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
i AS (SELECT image, 30000 + row_number() OVER (ORDER BY image) - 1 AS idx FROM t)
SELECT idx, idx // 10000 AS shard, 'sample' || lpad(CAST(idx AS VARCHAR), 5, '0') AS key, image FROM i
"""

ORACLE["a5_csv_to_tsv"] = f"""
WITH {PAGES}, r AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS record, caption FROM pg)
SELECT record, trim(caption, {STRIP}) AS col0 FROM r WHERE record >= 10
"""

ORACLE["a6_caption_url_export"] = f"WITH {PAGES} SELECT caption, url FROM pg"

ORACLE["a11_prediction_export"] = f"""
WITH {CLS}, ri AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS row_idx FROM ti)
SELECT ri.row_idx, p.class_idx, round(p.prob, 6) AS prob FROM probs p JOIN ri USING (image_id)
"""

ORACLE["a12_peek"] = f"""
WITH {CAPS} SELECT image, pos, md5(text) AS text_md5 FROM capsx ORDER BY image, pos LIMIT 5
"""

ORACLE["a12_duplicate_captions"] = f"""
WITH s AS (SELECT doc_id AS image, {LINES} AS l FROM documents),
r AS (SELECT image, unnest(l[3:]) AS text FROM s WHERE len(l) >= 3)
SELECT image, md5(text) AS text_md5, count(*) AS n FROM r GROUP BY image, text HAVING count(*) > 1
"""

ORACLE["d14_seeded_shuffle"] = """
SELECT doc_id, ('0x' || substr(md5(concat_ws('|', doc_id, 3, 0)), 1, 8))::BIGINT AS shuffle_h FROM documents
"""

ORACLE["c1_hashed_bow_native"] = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS tok FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS cnt FROM t GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(cnt * cnt)) AS nrm FROM c GROUP BY doc_id),
g AS (SELECT d.doc_id, r.dim FROM (SELECT DISTINCT doc_id FROM t) d, (SELECT unnest(range(0, 64)) AS dim) r)
SELECT g.doc_id, g.dim, round(coalesce(c.cnt, 0.0) / n.nrm, 6) AS x
FROM g JOIN n USING (doc_id) LEFT JOIN c USING (doc_id, dim)
"""
# the encoder's vectors are floats
ORACLE["c1_embed_column"] = ORACLE["c1_hashed_bow_native"].replace(
    "round(coalesce(c.cnt, 0.0) / n.nrm, 6)", "round(CAST(CAST(coalesce(c.cnt, 0.0) / n.nrm AS FLOAT) AS DOUBLE), 6)")


ORACLE["a10_metric_lines"] = "SELECT 'run-1' AS id, dataset, metric, result FROM (" + ORACLE["f5_metric_dispatch"] + ")"

ORACLE["a1_shard_roundtrip"] = f"""
WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS image, len({LINES}) AS n_captions FROM documents),
o AS (SELECT image, n_captions, row_number() OVER (ORDER BY image) - 1 AS idx FROM i)
SELECT 'sample' || lpad(CAST(idx AS VARCHAR), 5, '0') AS key, lpad(CAST(idx // 10000 AS VARCHAR), 5, '0') || '.tar' AS shard,
       image, n_captions FROM o
"""

def _planned(size: int) -> str:
    return f"""
WITH i AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS image, len({LINES}) AS n_captions FROM documents),
o AS (SELECT image, n_captions, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM i)
SELECT 'sample' || lpad(CAST(idx AS VARCHAR), 5, '0') AS key, lpad(CAST(idx // {size} AS VARCHAR), 5, '0') || '.tar' AS shard,
       image, n_captions, true AS ok FROM o
"""


ORACLE["a2_planned_shards"] = _planned(10_000)
ORACLE["a3_resumed_shards"] = _planned(500)
ORACLE["b9_written_parts"] = f"""
WITH {B8}, i AS (SELECT image, pos, caption, row_number() OVER (ORDER BY image, pos) - 1 AS idx FROM b8)
SELECT image, pos, md5(caption) AS caption_md5, idx // 5000 AS part FROM i
"""

ORACLE["a1_indexed_shards"] = _planned(10000).replace(", true AS ok", "")

ORACLE["a4_translation_table"] = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, md5(text) AS caption_md5, source AS url FROM documents
"""

ORACLE["a7_split_manifest"] = """
WITH s AS (SELECT doc_id, source, text, ['train', 'validation', 'test'][doc_id % 3 + 1] AS split, 'doc' || doc_id AS filename FROM documents)
SELECT split, row_number() OVER (PARTITION BY source, split ORDER BY filename) - 1 AS pos, filename, md5(text) AS caption_md5 FROM s
"""

ORACLE["a7_coco_manifest"] = "WITH " + CAPS + """
SELECT image AS image_id, count(*) AS n_captions, md5(string_agg(text, chr(10) ORDER BY pos)) AS captions_md5
FROM capsx GROUP BY image
"""

ORACLE["a7_karpathy_manifest"] = "WITH " + CAPS + """,
l AS (SELECT image, count(*) AS n, string_agg(text, chr(10) ORDER BY pos) AS t FROM capsx GROUP BY image)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.jpg' AS filename, ['train', 'val', 'test', 'restval'][doc_id % 4 + 1] AS split,
       coalesce(n, 0) AS n_sentences, md5(coalesce(t, '')) AS sentences_md5
FROM documents LEFT JOIN l ON image = doc_id
"""

ORACLE["a8_labelled_folder"] = """
WITH p AS (SELECT page_id, 'kind=' || regexp_extract(url, '\\.(com|net|org)', 1) AS class_name FROM pages)
SELECT page_id, class_name, dense_rank() OVER (ORDER BY class_name) - 1 AS class_idx FROM p
"""

ORACLE["a9_split_list"] = "SELECT 'doc' || doc_id AS image FROM labels"
