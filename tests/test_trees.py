import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltrail.models import duration as D, trees as T
from voltrail.models.permutation import permutation_importance
from voltrail.plans import modelling as Q
from voltrail.plans.history import FEATURE_COLUMNS
from voltrail.schema import STATION


def made_up(n, seed, noise=0.5):
    """Codes of two numbers and one text, and a label that depends on them."""
    rng = np.random.default_rng(seed)
    codes = np.stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 6, n)], 1).astype(np.int32)
    y = codes[:, 0] * (codes[:, 1] > 2) + 4.0 * (codes[:, 2] == 3) + rng.normal(size=n) * noise
    return codes, np.array([12, 5, 6]), np.array([False, False, True]), y


def sides(codes, one_value, rows, f, cut):
    code = codes[rows, f]
    go = code == cut if one_value[f] else code <= cut
    return rows[go], rows[~go]


def slow_boosting(codes, widths, one_value, y, rounds, rate, max_leaves, max_depth, min_leaf, l2):
    """Every split of every leaf tried directly; the leaf of the largest gain is split first."""
    predicted = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = y - predicted
        ends = [(np.arange(len(y)), 0)]
        while len(ends) < max_leaves:
            found = []
            for i, (rows, depth) in enumerate(ends):
                if depth >= max_depth:
                    continue
                for f, width in enumerate(widths):
                    for cut in range(width):
                        left, right = sides(codes, one_value, rows, f, cut)
                        if min(len(left), len(right)) >= min_leaf:
                            gain = sum(g[p].sum() ** 2 / (len(p) + l2) for p in (left, right)) - g[rows].sum() ** 2 / (len(rows) + l2)
                            found.append((gain, -i, -f, -cut, left, right, depth + 1))
            if not found or max(x[0] for x in found) <= 1e-9:
                break
            _, i, _, _, left, right, depth = max(found, key=lambda x: (round(x[0], 9), x[1:4]))
            ends[-i:-i + 1] = []
            ends += [(left, depth), (right, depth)]
        for rows, _ in ends:
            predicted[rows] += rate * g[rows].sum() / (len(rows) + l2)
    return predicted


@pytest.mark.parametrize("max_leaves,max_depth,min_leaf,l2", [(6, 1 << 30, 5, 0.0), (8, 2, 1, 0.5), (31, 1 << 30, 20, 3.0), (4, 9, 3, 0.1)])
def test_boosting_equals_a_direct_search_of_all_splits(max_leaves, max_depth, min_leaf, l2):
    codes, widths, one_value, y = made_up(150, 1)
    base, nodes = T.grow_boosted(codes, widths, one_value, y, 6, 0.3, max_leaves, max_depth, min_leaf, l2)
    binning = T.Binning([0, 1, 2], [1, 2, 7], [np.arange(11), np.arange(4), None], 7)
    got = T.TreesModel(binning, nodes, base, mean=False).values(codes)
    assert got == pytest.approx(slow_boosting(codes, widths, one_value, y, 6, 0.3, max_leaves, max_depth, min_leaf, l2), abs=1e-9)
    ends = nodes["feature"] < 0
    assert np.bincount(nodes["tree"][ends]).max() <= max_leaves and nodes["rows"][ends].min() >= min_leaf and nodes["depth"].max() <= max_depth


def slow_tree(codes, widths, one_value, y, weight, rows, depth, max_depth, min_leaf, min_split):
    """A function from a row of codes to the mean of its leaf."""
    w = weight[rows]
    mean = (w * y[rows]).sum() / w.sum()
    best = (1e-9, None)
    if depth < max_depth and len(rows) >= max(min_split, 2):
        for f, width in enumerate(widths):
            for cut in range(width):
                left, right = sides(codes, one_value, rows, f, cut)
                if min(len(left), len(right)) >= max(1, min_leaf):
                    gain = sum((weight[p] * y[p]).sum() ** 2 / weight[p].sum() for p in (left, right)) - (w * y[rows]).sum() ** 2 / w.sum()
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, cut, left, right))
    if best[1] is None:
        return lambda row: mean
    f, cut, left, right = best[1]
    a, b = (slow_tree(codes, widths, one_value, y, weight, p, depth + 1, max_depth, min_leaf, min_split) for p in (left, right))
    return lambda row: (a if (row[f] == cut if one_value[f] else row[f] <= cut) else b)(row)


@pytest.mark.parametrize("max_depth,min_leaf,min_split", [(1 << 30, 1, 2), (3, 2, 2), (6, 4, 10)])
def test_forest_equals_a_direct_search_of_all_splits(max_depth, min_leaf, min_split):
    codes, widths, one_value, y = made_up(120, 2)
    trees = [0, 3, 7]
    nodes = T.grow_forest(codes, widths, one_value, y, trees, max_depth, min_leaf, min_split)
    got = nodes["value"][T.leaves(nodes, np.arange(3), codes, one_value)]
    for i, tree in enumerate(trees):
        weight = np.bincount(np.random.default_rng([T.SEED, tree]).integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        one = slow_tree(codes, widths, one_value, y, weight, np.flatnonzero(weight), 0, max_depth, min_leaf, min_split)
        drawn = np.flatnonzero(weight)  # splits that part these alike may part others differently
        assert got[drawn, i] == pytest.approx([one(row) for row in codes[drawn]])


@pytest.mark.parametrize("depth,split", [(0, 2), (2, 2), (4, 10), (1 << 30, 5)])
def test_a_tree_without_limits_holds_the_smaller_ones(depth, split):
    codes, widths, one_value, y = made_up(400, 3)
    whole = T.grow_forest(codes, widths, one_value, y, range(5), 1 << 30, 2, 2)
    alone = T.grow_forest(codes, widths, one_value, y, range(5), depth, 2, split)
    a = whole["value"][T.leaves(whole, np.arange(5), codes, one_value, depth, split)]
    assert (a == alone["value"][T.leaves(alone, np.arange(5), codes, one_value)]).all()


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    parts = D.split_folds(D.Prepared(None, Q.prepared(spark, sf_dir).train.where("row_id % 5 = 0"), None), 2)
    return [(train, T.take(p.test, binning=train.binning)) for p in parts for train in [T.take(p.train)]]


def test_nested_search_scores_equal_forests_fitted_alone(spark, samples):
    settings = [{"numTrees": 30, "maxDepth": None, "minInstancesPerNode": 1}, {"numTrees": 40, "maxDepth": 3, "minInstancesPerNode": 1},
                {"numTrees": 7, "maxDepth": 5, "minSamplesSplit": 10, "minInstancesPerNode": 4}]
    alone = []
    for s in settings:
        errors = []
        for train, test in samples:
            nodes = T.grow_forest(train.codes, train.binning.widths, train.binning.one_value, train.label, range(s["numTrees"]),
                                  1 << 30 if s["maxDepth"] is None else s["maxDepth"], s["minInstancesPerNode"], s.get("minSamplesSplit", 2))
            errors.append(np.abs(test.label - T.TreesModel(test.binning, nodes).values(test.codes)).mean())
        alone.append(np.mean(errors))
    assert T.nested_errors(spark, settings, samples) == pytest.approx(alone)


def test_boosting_scores_equal_fits_alone(spark, samples):
    settings = [{"maxIter": 5, "l2": 0.5, "maxLeafNodes": 15, "maxDepth": None}, {"maxIter": 3, "stepSize": 0.1}]
    alone = [np.mean([np.abs(test.label - T.Boosting(**s).grow(train).values(test.codes)).mean() for train, test in samples]) for s in settings]
    assert T.boosting_errors(spark, settings, samples) == pytest.approx(alone)


def test_a_fitted_forest_has_the_nodes_of_its_blocks_in_order(spark, sf_dir):
    rows = Q.prepared(spark, sf_dir).train.where("row_id % 5 = 0").select("features", "label")
    sample = T.take(rows)
    parts = [T.grow_forest(sample.codes, sample.binning.widths, sample.binning.one_value, sample.label, range(i, min(i + T.BLOCK, 60)), 6, 2, 2)
             for i in range(0, 60, T.BLOCK)]
    fitted, direct = T.Forest(numTrees=60, maxDepth=6).fit(rows).nodes, T.joined_nodes(parts)
    assert all((fitted[k] == direct[k]).all() and fitted[k].dtype == direct[k].dtype for k in direct)


def test_grids_have_all_settings_and_differ():
    assert set(D.FOREST_GRID) == {"numTrees", "maxDepth", "minSamplesSplit", "minInstancesPerNode"}
    assert set(D.BOOSTING_GRID) == {"stepSize", "maxDepth", "maxLeafNodes", "minInstancesPerNode", "l2"}


def test_large_tables_are_fitted_on_a_bounded_sample(spark, sf_dir):
    rows = Q.prepared(spark, sf_dir).train.select("features", "label")
    n = rows.count()
    taken = T.bounded(rows, n // 4).count()
    assert 0.15 * n < taken < 0.35 * n and T.bounded(rows, n).count() == n
    few = T.Boosting(maxIter=2, fitRows=300).fit(rows)
    assert few.transform(rows).where(F.col("prediction").isNull()).isEmpty()


def test_an_unseen_value_and_numbers_beyond_the_sample_are_scored():
    binning = T.learn_bins(["energy_consumed_kwh", "user_type", "user_type"], np.array([[1.0], [2.0], [4.0]]))
    assert binning.codes(np.array([[-9.0, 1, 0], [3.0, 0, 1], [99.0, 0, 0]])).tolist() == [[0, 0], [1, 1], [2, 2]]
    assert T.learn_bins(["energy_consumed_kwh"], np.arange(9000.0)[:, None]).widths[0] <= T.BINS


def some_models():
    """A boosting and a forest over more than one block of trees, and their binning."""
    codes, widths, one_value, y = made_up(300, 4)
    binning = T.Binning([0, 1, 2], [1, 2, 7], [np.arange(11), np.arange(4), None], 7)
    base, boosted = T.grow_boosted(codes, widths, one_value, y, 120, 0.1, 6, 1 << 30, 5, 0.0)
    forest = T.joined_nodes([T.grow_forest(codes, widths, one_value, y, range(i, i + 60), 1 << 30, 1, 2) for i in (0, 60)])
    return [T.TreesModel(binning, boosted, base, mean=False), T.TreesModel(binning, forest)]


def test_mixed_values_equal_scoring_of_every_mixture():
    own, lent = made_up(80, 5)[0], made_up(80, 6)[0]
    groups = [[0], [1], [2], [0, 2], []]
    for model in some_models():
        found = model.mixed_values(own, lent, groups)
        assert (found[:, 0] == model.values(own)).all() and (found[:, 5] == found[:, 0]).all()
        for k, group in enumerate(groups, 1):
            mixed = own.copy()
            mixed[:, group] = lent[:, group]
            assert (found[:, k] == model.values(mixed)).all()
        assert model.mixed_values(own[:0], lent[:0], groups).shape == (0, 6)


def test_vectors_are_read_whole_whether_sparse_or_dense_or_cut():
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    vectors = pa.array([{"type": 0, "size": 4, "indices": [1, 3], "values": [5.0, 6.0]}, {"type": 1, "size": 4, "indices": None, "values": [1.0, 2.0, 0.0, 4.0]},
                        {"type": 0, "size": 4, "indices": [], "values": []}, {"type": 0, "size": 4, "indices": [0], "values": [7.0]}], kind)
    rows = [[0, 5, 0, 6], [1, 2, 0, 4], [0, 0, 0, 0], [7, 0, 0, 0]]
    assert T.dense_rows(vectors, 4).tolist() == rows
    assert T.dense_rows(vectors.slice(1, 2), 4).tolist() == rows[1:3] and T.dense_rows(vectors.slice(4), 4).shape == (0, 4)


@pytest.mark.parametrize("hashed", [(), (STATION,)])
def test_importance_reads_a_row_once_and_equals_scoring_every_mixture(spark, sf_dir, hashed):
    parts = D.prepare(Q.stored_features(spark, sf_dir).where("row_id % 3 = 0"), hash_columns=hashed)
    rows = parts.test.drop("features", "label").withColumn("charging_rate_kw", F.when(F.col("row_id") % 2 == 0, F.col("charging_rate_kw"))) \
        .withColumn("user_type", F.when(F.col("row_id") % 5 > 0, F.col("user_type")))
    scorer = D.Scorer(parts.preprocessor, T.Boosting(maxIter=15, stepSize=0.3, minInstancesPerNode=5).fit(parts.train))
    found = permutation_importance(rows, FEATURE_COLUMNS, scorer)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Generate") < plan.index("ArrowEvalPython")  # repeated after the model, not before
    got = {r.feature: (r.importance, r.mae) for r in found.collect()}
    slow = {r.feature: (r.importance, r.mae) for r in permutation_importance(rows, FEATURE_COLUMNS, lambda mixed: scorer(mixed)).collect()}
    assert got.keys() == slow.keys() == set(FEATURE_COLUMNS)
    assert all(got[c] == pytest.approx(slow[c], abs=1e-9) for c in slow) and max(v[0] for v in got.values()) > 1
    assert permutation_importance(rows.limit(0), FEATURE_COLUMNS, scorer).count() == 0
