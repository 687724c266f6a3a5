import numpy as np
import pytest
from pyspark.sql import functions as F

from purchaselens.operators import similarity as s
from purchaselens.operators import tiles
from purchaselens.plans import joins


def vectors(n=90, d=16, seed=0, copies=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[-copies:] = v[0]  # identical vectors: ties at similarity 1
    return [f"item {i:03d}" for i in range(n)], v / np.linalg.norm(v, axis=1, keepdims=True)


def index(spark, names, v, scale=1.0):
    rows = [(n, f"f{i % 3}", [float(x) * scale for x in row]) for i, (n, row) in enumerate(zip(names, v))]
    df = spark.createDataFrame(rows, "name string, family string, vector array<double>")
    return s.ItemIndex.of(df.repartition(4))


@pytest.fixture(params=[None, 16], ids=["one block", "many blocks"])
def idx(spark, request, monkeypatch):
    names, v = vectors()
    if request.param:
        monkeypatch.setattr(s, "BLOCK_MIN", request.param)
    return index(spark, names, v, 3.0), names, v


def ranked(names, scores, i):
    order = sorted(range(len(names)), key=lambda j: (-round(scores[i, j], 12), names[j]))
    return [j for j in order if j != i]


def test_pairs(idx):
    ix, names, v = idx
    scores = v @ v.T
    got = {(x.a, x.b): x.similarity for x in s.similarity_pairs(ix, 0.3).collect()}
    n = len(names)
    want = {(names[i], names[j]): scores[i, j] for i in range(n) for j in range(n)
            if i != j and scores[i, j] >= 0.3}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_neighbours(idx):
    ix, names, v = idx
    scores = v @ v.T
    rows = s.nearest_neighbours(ix, 4).orderBy("a", "rank").collect()
    got = {}
    for x in rows:
        got.setdefault(x.a, []).append(x.b)
    for i, name in enumerate(names):
        assert got[name] == [names[j] for j in ranked(names, scores, i)[:4]]


def test_neighbour_lists(spark, idx):
    ix, names, v = idx
    out = {x.name: x for x in s.neighbour_lists(ix, 3).collect()}
    assert set(out) == set(names)
    scores = v @ v.T
    first = out[names[0]].neighbours
    assert [e.name for e in first] == [names[j] for j in ranked(names, scores, 0)[:3]]
    assert first[0].similarity == 1.0 and first[0].family.startswith("f")


def test_single_item_index(spark):
    ix = index(spark, ["only"], np.ones((1, 3)))
    assert s.similarity_pairs(ix, -1.0).count() == 0
    assert s.nearest_neighbours(ix).count() == 0
    assert s.neighbour_lists(ix).first().neighbours == []


def test_find_similar(spark):
    names, v = vectors()
    ix, scores = index(spark, names, v), v @ v.T
    got = s.find_similar(ix, names[3], 6, 0.1).collect()
    want = [j for j in ranked(names, scores, 3) if scores[3, j] >= 0.1][:6]
    assert [(x.name, x.similarity) for x in got] == [
        (names[j], pytest.approx(scores[3, j], abs=1e-4)) for j in want]
    dirty = s.find_similar(ix, " ITEM 003  Plus", 6, 0.1).collect()
    assert dirty == got
    assert s.find_similar(ix, "FAKE").count() == 0
    assert s.find_similar(ix, names[3], 0).count() == 0
    assert s.find_similar(ix, names[3], threshold=1.0).count() == 0
    # Copies of item 0 tie at 1 and none of them is the item itself.
    assert [x.name for x in s.find_similar(ix, names[0], 5).collect()] == names[-5:]
    assert {x.name for x in s.similar_set(ix, names[3], 0.1).collect()} == {
        names[j] for j in ranked(names, scores, 3) if scores[3, j] >= 0.1}


def test_checked(spark):
    names, v = vectors()
    ix = index(spark, names, v)
    weak = s.find_similar_checked(ix, names[3], 5, 0.999).first()
    assert weak.qualifying_above_threshold is False and weak.similar == []
    assert "threshold" in weak.reason
    good = s.find_similar_checked(ix, names[0], 2, 0.999).first()
    assert good.qualifying_above_threshold and good.reason is None
    assert [e.name for e in good.similar] == names[-5:-3]
    assert s.find_similar_checked(ix, "FAKE").count() == 1


@pytest.mark.parametrize("bound", [joins.BROADCAST_BYTES, 0])
def test_pair_similarity(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    names, v = vectors()
    pairs = spark.createDataFrame(
        [(names[0], names[0]), (names[1], names[2]), (names[1], "FAKE"), (None, names[1])] * 2,
        "a string, b string")
    out = s.pair_similarity(pairs, index(spark, names, v)).collect()
    assert len(out) == 8
    got = {(x.a, x.b): x.similarity for x in out}
    assert got[names[0], names[0]] == pytest.approx(1.0)
    assert got[names[1], names[2]] == pytest.approx(v[1] @ v[2])
    assert got[names[1], "FAKE"] == got[None, names[1]] == 0.0


def test_stats(spark):
    names, v = vectors()
    out = s.embedding_stats(index(spark, names, v)).first()
    assert (out.total_items, out.embedding_dim, out.families) == (90, 16, ["f0", "f1", "f2"])
    assert out.avg_similarity == pytest.approx((v @ v.T).mean(), abs=1e-12)


PROFILES = [
    ("Grapefruit Fizz", "tart grapefruit, bright citrus zest, sparkling"),
    ("Lemon Sherbet", "lemon zest, bright citrus, tart sparkling sugar"),
    ("Grapefruit Sugar Cloud", "spun sugar, sweet vanilla, soft cream"),
]


def test_profiles_are_embedded_not_names(spark):
    """Two names without a common word but with common notes beat two with a common word."""
    df = spark.createDataFrame(PROFILES, "name string, notes string")
    vectors_ = s.embed_profiles(df, "notes").withColumn("family", F.lit("x"))
    ix = s.ItemIndex.of(vectors_)
    pairs = spark.createDataFrame([(PROFILES[0][0], PROFILES[1][0]), (PROFILES[0][0], PROFILES[2][0])],
                                  "a string, b string")
    got = {x.b: x.similarity for x in s.pair_similarity(pairs, ix).collect()}
    assert got["Lemon Sherbet"] > got["Grapefruit Sugar Cloud"]


def test_encoder_hook_and_custom_text(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", "yyyy")], "name string, notes string")
    out = s.embed_profiles(df, "notes", lambda c: F.array(F.length(c).cast("double"), F.lit(0.0)))
    assert [x.vector for x in out.collect()] == [[1.0, 0.0], [1.0, 0.0]]
    train = spark.createDataFrame(PROFILES, "name string, notes string")
    encoder = s.TextEncoder.fit(train, "notes", 64)
    own = {x.name: x.vector for x in s.embed_profiles(train, "notes", encoder).collect()}
    again = s.embed_custom(train.limit(1), "notes", encoder).first()
    assert again.vector == own[again.name] and len(again.vector) == 64
    blank = s.embed_custom(spark.createDataFrame([(None,)], "notes string"), "notes", encoder)
    assert sum(blank.first().vector) == 0


def test_null_vectors_are_refused_or_dropped(spark):
    rows = [("a", "f", [0.6, 0.8]), ("b", "f", None), ("c", "f", [1.0, 0.0]), ("d", "f", [None, 1.0])]
    df = spark.createDataFrame(rows, "name string, family string, vector array<double>")
    for run in (s.similarity_pairs, s.nearest_neighbours, s.neighbour_lists, s.embedding_stats,
                lambda ix: s.find_similar(ix, "a"), lambda ix: s.similar_set(ix, "a", 0.1)):
        with pytest.raises(Exception, match="no whole vector for item (b|d)"):
            run(s.ItemIndex.of(df)).collect()
    got = s.similarity_pairs(s.ItemIndex.of(df, missing="drop"), 0.1).collect()
    assert {(x.a, x.b): round(x.similarity, 9) for x in got} == {("a", "c"): 0.6, ("c", "a"): 0.6}
    with pytest.raises(ValueError):
        s.ItemIndex.of(df, missing="keep")


@pytest.mark.parametrize("block", [256, 1])
def test_vectors_of_different_lengths_are_refused(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK_MIN", block)
    rows = [("a", "f", [1.0, 0.0]), ("b", "f", [0.0, 1.0, 0.0, 0.0])]
    ix = s.ItemIndex.of(spark.createDataFrame(rows, "name string, family string, vector array<double>"))
    for run in (s.similarity_pairs, s.nearest_neighbours, s.embedding_stats, lambda i: s.find_similar(i, "a")):
        with pytest.raises(Exception, match="differ in length"):
            run(ix).collect()


def test_items_of_one_name_are_no_neighbours(spark):
    rows = [("a", "f", [1.0, 0.0]), ("a", "f", [0.8, 0.6]), ("b", "f", [0.6, 0.8])]
    ix = s.ItemIndex.of(spark.createDataFrame(rows, "name string, family string, vector array<double>"))
    assert {(x.a, x.b) for x in s.similarity_pairs(ix, 0.1).collect()} == {("a", "b"), ("b", "a")}
    assert all(x.a != x.b for x in s.nearest_neighbours(ix, 3).collect())


def test_threshold_meets_rounded_scores(spark, monkeypatch):
    third = [1 / 3**0.5] * 3
    rows = [("a", "f", third), ("b", "f", [x * 7 for x in third]), ("c", "f", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "name string, family string, vector array<double>")
    for block in (256, 1):
        monkeypatch.setattr(s, "BLOCK_MIN", block)
        assert {(x.a, x.b) for x in s.similarity_pairs(s.ItemIndex.of(df), 1.0).collect()} == {("a", "b"), ("b", "a")}


def test_no_job_runs_before_an_item_is_looked_up(spark):
    names, v = vectors(20)
    spark.sparkContext.setJobGroup("before", "")
    ix = index(spark, names, v)
    frames = [s.find_similar(ix, names[0]), s.similar_set(ix, names[0], 0.2), s.embedding_stats(ix)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("before")) == 0
    spark.sparkContext.setJobGroup("after", "")
    assert all(f.count() for f in frames)


def clustered(n=900, d=8, seed=3):
    """Tight groups, zero vectors, exact copies, one name on two rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(0, 12, n)] * 6 + rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[10], v[20], v[500:505] = 0, 0, v[0]
    names = [f"item {i:04d}" for i in range(n)]
    names[40] = names[41]
    return names, v


@pytest.mark.parametrize("rows", [16, 60, 2000])
def test_tiles_lose_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(s, "BLOCK_MIN", rows)
    monkeypatch.setattr(s, "BLOCK_MAX", rows)
    names, v = clustered()
    ix, scores = index(spark, names, v), np.round(v @ v.T, 12)
    other = np.array(names)[:, None] != np.array(names)[None, :]
    for threshold in (0.97, 0.6, 0.0, -0.5):
        got = sorted((x.a, x.b) for x in s.similarity_pairs(ix, threshold).collect())
        assert got == sorted((names[i], names[j]) for i, j in zip(*np.nonzero((scores >= threshold) & other)))
    nearest = {}
    for x in s.nearest_neighbours(ix, 5).orderBy("a", "rank").collect():
        nearest.setdefault(x.a, []).append((x.b, round(x.similarity, 9)))
    for i, name in enumerate(names):
        if i not in (40, 41):  # two rows of one name share their list
            best = sorted(np.flatnonzero(other[i]), key=lambda j: (-scores[i, j], names[j]))
            want = [(names[j], round(float(scores[i, j]), 9)) for j in best[:5]]
            # Rows of one name are candidates each; the first five rows count.
            assert nearest[name] == want, name


def test_visits_are_few_where_items_are_close(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_MIN", 50)
    monkeypatch.setattr(s, "BLOCK_MAX", 50)
    names, v = clustered()
    plan = s._tiling(index(spark, names, v))
    to = tiles.angles(v, plan.pivots)
    at, _ = plan.visits(plan.open_cells(to, np.full(len(v), np.arccos(0.9))))
    assert plan.total > 10 and len(at) < 0.35 * len(v) * plan.total
    assert plan.n_tiles.max() > 1 or plan.total < len(plan.pivots)
    sizes = np.bincount(plan.homes(names, plan.cells(v, to)), minlength=plan.total)
    assert sizes.sum() == len(v)


def test_pairs_among_named_items(spark):
    names, v = vectors()
    ix, some = index(spark, names, v), set(names[::3])
    asked = spark.createDataFrame([(n,) for n in [*some, *some, "unknown", None]], "item string")
    want = {(x.a, x.b, x.similarity) for x in s.similarity_pairs(ix, 0.1).collect() if {x.a, x.b} <= some}
    assert {(x.a, x.b, x.similarity) for x in s.similarity_pairs(ix, 0.1, asked).collect()} == want and want
    # Items that nobody names are still refused where they are faulty.
    for bad, why in ((None, "no whole vector for item x"), ([1.0], "differ in length")):
        more = spark.createDataFrame([("x", "f", bad)], ix.items.schema)
        with pytest.raises(Exception, match=why):
            s.similarity_pairs(s.ItemIndex.of(ix.items.unionByName(more)), 0.1, asked).count()


@pytest.mark.parametrize("query", [
    "cross_sell_matches", "cross_sell_similar", "cross_sell_similar_default", "cross_sell_recommendations",
])
def test_cross_selling_stores_pairs_of_offered_items_only(spark, monkeypatch, query):
    from workload import cohort, tables

    folder, kept = "/root/testdata/sf0.001", []
    original = tables.stored_pairs
    monkeypatch.setattr(cohort, "stored_pairs", lambda *a: kept.append(original(*a)) or kept[-1])
    cohort.QUERIES[query][0](spark, folder)
    offered = {r[0] for r in spark.read.parquet(f"{folder}/part.parquet").select("p_brand").collect()}
    assert {x for r in kept[0].collect() for x in (r.a, r.b)} <= offered


@pytest.mark.parametrize("later", [True, False])
def test_rows_of_a_task_do_not_grow_with_the_index(spark, monkeypatch, later):
    names, v = vectors(400, 16)
    ix = index(spark, names, v)
    want = sorted(map(tuple, (s.similarity_pairs(ix, -0.2) if later else s.nearest_neighbours(ix, 5)).collect()))
    monkeypatch.setattr(s, "BLOCK_MIN", 40)
    monkeypatch.setattr(tiles, "SLICE", 50)
    against = tiles.against_tiles

    def counted(items, plan, visitors, within, later_only, score, schema):
        def size(names, here, home, visiting, there):
            yield from score(names, here, home, visiting, there)
            assert len(there) <= 130, len(there)

        return against(items, plan, visitors, within, later_only, size, schema)

    monkeypatch.setattr(tiles, "against_tiles", counted)
    got = sorted(map(tuple, (s.similarity_pairs(ix, -0.2) if later else s.nearest_neighbours(ix, 5)).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])


def test_best_breaks_ties_by_name_only():
    scores = np.array([[0.5, 0.5 + 4e-13, 0.9, 0.5, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5], [1.0, 1.0, 1.0, 1.0, 1.0]])
    same = np.zeros(scores.shape, bool)
    same[2, 0] = same[1, 1:] = True
    i, j = s._best(scores, same, 2)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 2), (1, 0), (2, 1), (2, 2)]


def test_best_equals_sorting():
    rng = np.random.default_rng(3)
    for rows, wide, k in ((7, 500, 10), (5, 11, 10), (6, 40, 1), (4, 330, 33)):
        scores = np.round(rng.normal(size=(rows, wide)), 1)  # many ties
        same = rng.random((rows, wide)) < 0.3
        same[0], same[1, k // 2 :] = True, True
        want = [(i, j) for i in range(rows)
                for j in sorted(sorted(np.flatnonzero(~same[i]), key=lambda j: (-scores[i, j], j))[:k])]
        assert sorted(zip(*(x.tolist() for x in s._best(scores, same, k)), strict=True)) == want


def shuffled_rows(df):
    """Rows that the exchanges of a query wrote, each exchange once."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif name != "ReusedExchange":
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_items_are_shuffled_once_whatever_they_visit(spark, monkeypatch):
    names, v = vectors(400, 16)
    monkeypatch.setattr(s, "BLOCK_MIN", 40)
    ix = index(spark, names, v)
    tiles_ = s._tiling(ix).total
    assert tiles_ > 8
    # The index's own repartition, every item to its tile, every tile in a few pieces; neighbours of a task once more.
    most = 2 * 400 + 3 * tiles_
    assert 800 < shuffled_rows(s.similarity_pairs(ix, -0.2)) <= most
    assert 800 < shuffled_rows(s.nearest_neighbours(ix, 5)) <= most + 5 * 420


@pytest.mark.parametrize("pieces", [1, 7, 1000])
def test_pieces_hold_every_row_once(pieces):
    import pyarrow as pa

    tile = [0] * 5 + [2] * 20 + [3] + [7] * 14
    rows = [(t, None if i == 6 else f"n{i:02d}", [float(i), 1.0]) for i, t in enumerate(tile)]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.float64())]
    columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
    whole = pa.RecordBatch.from_arrays(columns, ["tile", "name", "vector"])
    cut = [whole.slice(0, 0), whole.slice(0, 9), whole.slice(9, 0), whole.slice(9, 17), whole.slice(26)]
    found = []
    for t, n, x in tiles._pieces(iter(cut), pieces):
        assert 0 < len(n) <= pieces
        back, matrix = tiles._unpacked(pa.scalar(tiles._packed(n, x)))
        found += [(t, a, b) for a, b in zip(back.to_pylist(), matrix.tolist(), strict=True)]
    assert found == rows
    assert list(tiles._pieces(iter([whole.slice(0, 0)]), pieces)) == []


def test_best_of_found_keeps_ties_of_the_last():
    import pyarrow as pa

    a = ["x", "y", "x", None, "x", "x", None, "y"]
    score = [0.5, 0.1, 0.9, 0.2, 0.5 + 1e-13, 0.4, 0.3, 0.2]
    table = pa.table({"a": a, "b": list("abcdefgh"), "similarity": score})
    assert s._best_of_found(table, 2).column("b").to_pylist() == ["a", "b", "c", "d", "e", "g", "h"]
    assert s._best_of_found(table, 1).column("b").to_pylist() == ["c", "g", "h"]
    assert s._best_of_found(table.slice(0, 0), 2).num_rows == 0


def test_neighbours_are_found_once_for_lists_of_large_indexes(spark, monkeypatch):
    names, v = vectors()
    want = sorted(map(str, s.neighbour_lists(index(spark, names, v), 3).collect()))
    scored, against = spark.sparkContext.accumulator(0), tiles.against_tiles

    def counted(items, plan, kept, within, later_only, score, schema):
        def counting(names, here, home, visiting, there):
            scored.add(len(there))
            yield from score(names, here, home, visiting, there)

        return against(items, plan, kept, within, later_only, counting, schema)

    monkeypatch.setattr(tiles, "against_tiles", counted)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    got = s.neighbour_lists(index(spark, names, v), 3)
    assert sorted(map(str, got.collect())) == want
    assert scored.value == len(names)


def test_faulty_items_are_shuffled_once_too(spark, monkeypatch):
    """Missing vectors and names on several rows, one of them on more rows than a piece takes."""
    names, v = vectors(400, 16)
    rows = [(n, "f", None if i % 7 == 0 else x.tolist()) for i, (n, x) in enumerate(zip(names, v, strict=True))]
    rows += [(names[i], "f", v[i][::-1].tolist()) for i in range(0, 400, 11)]
    rows += [(names[5], "f", v[5].tolist())] * 90
    df = spark.createDataFrame(rows, "name string, family string, vector array<double>")
    whole = [(n, np.array(x)) for n, _, x in rows if x]
    scores = np.round(np.array([x for _, x in whole]) @ np.array([x for _, x in whole]).T, 12)
    want = sorted((whole[i][0], whole[j][0]) for i, j in np.argwhere(scores >= 0.2) if whole[i][0] != whole[j][0])
    monkeypatch.setattr(s, "BLOCK_MIN", 40)
    monkeypatch.setattr(tiles, "SLICE", 150)
    pairs = s.similarity_pairs(s.ItemIndex.of(df.repartition(4), missing="drop"), 0.2)
    assert sorted((x.a, x.b) for x in pairs.collect()) == want
    assert shuffled_rows(pairs) <= len(rows) + len(whole) + 60
