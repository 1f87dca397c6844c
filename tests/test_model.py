"""Heads trained on sums against training on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regulus.operators import model as U
from regulus.operators import nulls as N


def table(n=240, d=3, seed=0):
    r = np.random.default_rng(seed)
    f, g = r.normal(size=(n, d)), r.normal(size=(n, d))
    y = f @ [1.0, -2.0, 0.5][:d] + g @ [0.3, 0.1, 0.2][:d] + r.normal(size=n)
    fold = r.choice(["train", "stop", "eval"], n)
    return f, g, y, fold


def frame(spark, f, g, y, fold):
    rows = [(i, a.tolist(), b.tolist(), float(t), str(k)) for i, (a, b, t, k) in enumerate(zip(f, g, y, fold))]
    rows += [(1000, None, [0.0] * f.shape[1], 1.0, "train"), (1001, [0.0] * f.shape[1], [0.0] * f.shape[1], None, "train"), (1002, [9.0] * f.shape[1], [9.0] * f.shape[1], 5.0, None)]
    return spark.createDataFrame(rows, "id long, f array<double>, g array<double>, y double, fold string").repartition(3)


def by_rows(f, g, y, fold, penalty, epochs, patience, rate):
    tr, st = fold == "train", fold == "stop"
    x = np.column_stack((np.concatenate((f[tr], g[tr])), np.ones(2 * tr.sum())))
    t = np.concatenate((y[tr], y[tr]))
    z = np.column_stack(((f[st] + g[st]) / 2, np.ones(st.sum())))
    free = np.append(np.ones(f.shape[1]), 0)
    w, best, bad, at = np.zeros(x.shape[1]), np.inf, 0, 0
    best_w = w
    for e in range(1, epochs + 1):
        w = w - rate * 2 * (x.T @ (x @ w - t) / len(x) + penalty * free * w)
        loss = ((z @ w - y[st]) ** 2).mean()
        if loss < best - 1e-7:
            best, best_w, bad, at = loss, w, 0, e
        else:
            bad += 1
            if bad >= patience:
                break
    return best_w, best, e, at


@pytest.mark.parametrize("penalty,epochs,patience", [(0.0, 60, 5), (0.05, 400, 3), (0.0, 1, 1)])
def test_epochs_equal_training_on_rows(spark, penalty, epochs, patience):
    data = table()
    head = U.fit_head(frame(spark, *data), "f", "g", "y", "fold", (penalty,), max_epochs=epochs, patience=patience, rate=0.1)
    w, loss, ran, at = by_rows(*data, penalty, epochs, patience, 0.1)
    assert np.allclose(head.weights[:, 0], w) and np.isclose(head.loss[0], loss)
    assert (head.epochs[0], head.best_epoch[0]) == (ran, at)


def test_the_evaluation_fold_is_never_read(spark):
    f, g, y, fold = table(seed=1)
    one = U.fit_head(frame(spark, f, g, y, fold), "f", "g", "y", "fold", (0.0, 0.1))
    g2, y2 = np.where((fold == "eval")[:, None], 1e6, g), np.where(fold == "eval", -1e6, y)
    two = U.fit_head(frame(spark, f, g2, y2, fold), "f", "g", "y", "fold", (0.0, 0.1))
    assert np.array_equal(one.weights, two.weights) and one.penalty == two.penalty


def test_scores_of_several_targets(spark):
    f, g, y, fold = table(seed=2)
    df = frame(spark, f, g, y, fold).withColumn("t", F.when(F.col("y").isNotNull(), F.array("y", -F.col("y"))))
    sums = U.head_sums(df, "f", "g", "t", "fold")
    head = U.solve_head(sums["train"], sums["stop"])
    tr = fold == "train"
    x = np.column_stack((np.concatenate((f[tr], g[tr])), np.ones(2 * tr.sum())))
    want = np.linalg.lstsq(x, np.concatenate((y[tr], y[tr])), rcond=None)[0]
    assert np.allclose(head.weights, np.column_stack((want, -want)))
    got = {(r.id, r.target): r.pred for r in U.score_heads(df, "f", "g", head, ["id"]).collect()}
    assert all(np.isclose(got[i, 0], (f[i] + g[i]) / 2 @ want[:-1] + want[-1]) and np.isclose(got[i, 1], -got[i, 0]) for i in range(len(y)))
    with pytest.raises(ValueError):
        U.head_sums(df.where("fold = 'eval'"), "f", "g", "t", "fold")


def ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(len(v))
    return np.array([out[v == x].mean() for x in v])


@pytest.mark.parametrize("epochs", [None, 25])
def test_refits_equal_a_plain_loop(spark, epochs):
    f, g, y, fold = table(n=150, d=2, seed=3)
    rows = [(i, f[i].tolist(), g[i].tolist(), float(y[i]), str(fold[i]), float(y[i] + i % 5)) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, f array<double>, g array<double>, y double, fold string, m double")
    seeds = (3, 5, 8, 9)
    null, real = N.refit_null(df, "id", "f", "g", "y", "fold", "m", seeds, penalty=0.02, epochs=epochs, patience=4)
    known = df.where("fold <> 'eval'")
    drawn = {(r.seed, r.id): r.shuffled for r in N.shuffle_within(known.select("fold", "id", "y"), ["fold"], "id", "y", seeds).collect()}
    ev = fold == "eval"

    def rho(t):
        train, stop = (U.head_sums(spark.createDataFrame([(*x[:3], [float(t[x[0]])], x[4]) for x in rows if x[4] != "eval"],
                                                        "id long, f array<double>, g array<double>, y array<double>, fold string"), "f", "g", "y", "fold")[k] for k in ("train", "stop"))
        head = U.solve_head(train, stop, 0.02) if epochs is None else U.train_head(train, stop, epochs, 4, 0.02)
        p = ((f[ev] + g[ev]) / 2) @ head.weights[:-1, 0] + head.weights[-1, 0]
        return np.corrcoef(ranks(p), ranks(np.array([x[5] for x in rows])[ev]))[0, 1]

    assert real.first().rho == pytest.approx(rho(y))
    for s in seeds:
        t = np.array([drawn.get((s, i), 0.0) for i in range(len(y))])
        assert {r.seed: r.rho for r in null.collect()}[s] == pytest.approx(rho(t))
