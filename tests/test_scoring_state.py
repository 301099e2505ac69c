"""The scoring state: against the long score table, over one and many class blocks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics as M
from corpusmill.operators import scoring_state as ST
from corpusmill.operators import zeroshot as Z


def make(spark, n_images=90, n_classes=37, dim=6, groups=("a",), seed=0):
    rnd = np.random.default_rng(seed)
    im, pr = [], []
    for g in groups:
        protos = rnd.normal(size=(n_classes, dim))
        protos[5] = protos[3]                            # equal classes: the smaller one wins
        pr += [(g, c, [float(x) for x in v]) for c, v in enumerate(protos) if not (g == "b" and c == 7)]
        im += [(g, i, int(rnd.integers(0, n_classes)), [float(x) for x in rnd.normal(size=dim)]) for i in range(n_images)]
        im += [(g, n_images, 3, [0.0] * dim), (g, n_images + 1, None, [1.0] * dim), (g, n_images + 2, 999, [1.0] * dim)]
    images = spark.createDataFrame(im, "g string, image_id bigint, target bigint, vec array<double>")
    return images, spark.createDataFrame(pr, "g string, class_idx bigint, vec array<double>")


@pytest.mark.parametrize("block_size,broadcast_bytes", [(1000, 1 << 20), (8, 1 << 20), (8, 0)])
def test_states_equal_the_long_table(spark, block_size, broadcast_bytes):
    g = ["g"]
    images, protos = make(spark, groups=("a", "b"))
    states = ST.class_states(images, protos, scale=20.0, group_cols=g, block_size=block_size, broadcast_bytes=broadcast_bytes).cache()
    scores = Z.class_scores(images, protos, scale=20.0, group_cols=g, target="target").cache()
    key = lambda r: (r.g, r.image_id)
    best = {key(r): r for r in scores.filter("rank = 1").collect()}
    ranks = {key(r): r["rank"] for r in scores.filter("is_pos").collect()}
    probs = {key(r): r.p for r in Z.softmax(scores, group_cols=g).groupBy("g", "image_id").agg(F.max("prob").alias("p")).collect()}
    preds = ST.predictions(states, group_cols=g).collect()
    assert {key(r) for r in preds} == set(best) and len(preds) == len(best)
    for r in preds:
        assert r.pred == best[key(r)].class_idx and r.confidence == pytest.approx(probs[key(r)], rel=1e-9)
    assert {key(r): r["rank"] for r in ST.true_ranks(states, group_cols=g).collect()} == ranks
    acc = lambda x: sorted((r.g, r.k, round(r.accuracy, 9)) for r in Z.topk_accuracy(x, images, (1, 5, 50), group_cols=g).collect())
    assert acc(ST.true_ranks(states, group_cols=g)) == acc(scores)


def test_loss(spark):
    images, protos = make(spark)
    whole = images.filter("target < 37 and image_id < 90").drop("g")
    one = ST.class_states(whole, protos.drop("g"), scale=20.0, block_size=8)
    got = ST.classification_loss(one, whole).first()
    want = M.classification_loss(Z.class_scores(whole, protos.drop("g"), scale=20.0, target="target"), whole).first()
    assert (got.loss, got.accuracy) == (pytest.approx(want.loss), pytest.approx(want.accuracy))
    with pytest.raises(Exception, match="no score for the class"):
        ST.classification_loss(ST.class_states(images.drop("g"), protos.drop("g")), images.drop("g")).collect()


def test_few_rows_leave_python(spark):
    """Images x class blocks, however many classes there are; and no state without classes."""
    images, protos = make(spark, n_classes=300)
    states, blocks = ST.block_states(images, protos, block_size=100)
    assert blocks == 3 and states.count() == 3 * images.filter("vec[0] <> 0").count()
    assert ST.class_states(images, protos.limit(0)).count() == 0
    assert ST.class_states(images.limit(0), protos).count() == 0
