"""The recurrent network against finite differences and a plain forward pass."""

import math

import numpy as np
import pytest

from upslope.llm import gru, lm_scoring

HEADS, BANDS = 64, 3


def network(seed=1):
    net = gru.Gru.initial(np.arange(1, HEADS + BANDS + 1), HEADS, BANDS, seed)
    return gru.Gru(HEADS, BANDS, net.flat.astype(np.float64))


def texts(seed=2, lengths=(9, 5, 5, 1, 14)):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, HEADS + BANDS, n).astype(np.uint16) for n in lengths]


def loss(net, docs, grads=None):
    """Mean loss of one window over the docs, and its gradient."""
    ((inputs, targets),) = gru.Steps(docs, HEADS + BANDS).windows(100)
    kept = []
    hs = list(net.steps(np.zeros((len(docs), gru.HIDDEN)), inputs, kept))
    logp, dh = net.outputs(np.concatenate(hs), np.concatenate(targets), grads)
    if grads is not None:
        net.back(kept, np.split(dh, np.cumsum([len(t) for t in targets])[:-1]), grads)
    return -logp.mean()


def test_gradient_equals_finite_differences():
    net, docs = network(), texts()
    grad = gru.Gru(HEADS, BANDS, np.zeros_like(net.flat))
    loss(net, docs, grad.p)
    rng, checked = np.random.default_rng(3), 0
    for name, part in net.p.items():
        flat, found = part.reshape(-1), grad.p[name].reshape(-1)
        for i in {*rng.integers(0, flat.size, 25).tolist(), *np.argsort(-np.abs(found))[:5].tolist()}:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss(net, docs)
            flat[i] = was - 1e-5
            down = loss(net, docs)
            flat[i] = was
            assert math.isclose((up - down) / 2e-5, found[i], rel_tol=1e-4, abs_tol=1e-8), (name, i)
            checked += found[i] != 0
    assert checked > 60


def plain_score(net, doc):
    """Log10 probability of one text, symbol by symbol."""
    p, k = net.p, gru.HIDDEN
    h, last, out = [0.0] * k, HEADS + BANDS, 0.0
    sig = lambda v: 1 / (1 + math.exp(-v))
    for y in doc.tolist():
        a, u = p["x"][last], p["u"]
        r = [sig(a[i] + sum(h[j] * u[j][i] for j in range(k))) for i in range(k)]
        z = [sig(a[k + i] + sum(h[j] * u[j][k + i] for j in range(k))) for i in range(k)]
        c = [math.tanh(a[2 * k + i] + sum(r[j] * h[j] * u[j][2 * k + i] for j in range(k))) for i in range(k)]
        h = [h[i] + z[i] * (c[i] - h[i]) for i in range(k)]
        logits = [p["bc"][i] + sum(h[j] * p["wc"][j][i] for j in range(k)) for i in range(net.classes)]
        chosen = y // gru.GROUP if y < HEADS else y - HEADS + net.groups
        out += logits[chosen] - math.log(sum(map(math.exp, logits)))
        if y < HEADS:
            inner = [p["bh"][chosen][i] + sum(h[j] * p["wh"][chosen][j][i] for j in range(k)) for i in range(gru.GROUP)]
            out += inner[y % gru.GROUP] - math.log(sum(map(math.exp, inner)))
        last = y
    return out / math.log(10)


@pytest.mark.parametrize("window", [1, 4, 64])
def test_score_equals_a_plain_forward_pass(window):
    net, docs = network(), texts()
    assert np.allclose(gru.score(net, docs, window), [plain_score(net, d) for d in docs], rtol=1e-5)


def test_probabilities_add_up():
    net = network()
    every = [np.array([5, y], np.uint16) for y in range(HEADS + BANDS)]
    first = plain_score(net, np.array([5], np.uint16))
    assert math.isclose(sum(10 ** (s - first) for s in gru.score(net, every)), 1, rel_tol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    docs = [np.array([(s + i * 3) % HEADS for i in range(30)], np.uint16) for s in rng.integers(0, HEADS, 300)]
    net = gru.Gru.initial(np.ones(HEADS + BANDS), HEADS, BANDS)
    before = gru.score(net, docs).sum()
    adam = gru.Adam(net)
    for _ in range(12):
        gru.train(net, docs, adam)
    assert gru.score(net, docs).sum() > before * 0.95


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = None
    for parts in (1, 4, 13):
        got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs.repartition(parts), shard_tokens=15_000).collect()}
        first = first or got
        assert got == first and len(got) == docs.count()


def test_many_equal_rows_spread_over_shards(spark):
    docs = spark.range(3000).selectExpr("CAST(null AS long) doc_id", "'the same words again' text").unionAll(spark.range(500).selectExpr("id", "concat('own words ', id)"))
    got = lm_scoring.score_documents(docs, shard_tokens=2000).collect()
    same = [r.score for r in got if r.doc_id is None]
    assert len(got) == 3500 and len(same) == 3000 and max(same) - min(same) < 1e-5
