"""Known answers of operators that SQL doesn't cover, and refusals."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import concepts, conditions, graph, paging, ranking, resolution, search, selection
from tessera.sources import files, sql, store
from tessera.streaming import windows


def test_only_select_is_served(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert sql.query(spark, "SELECT id FROM numbers WHERE id = :x", {"x": 2}).collect()[0][0] == 2
    for bad in ("DROP VIEW numbers", "CREATE TABLE t AS SELECT 1", "INSERT INTO numbers SELECT 1", "SET a=b"):
        with pytest.raises(sql.Refused):
            sql.query(spark, bad)
    text = "o'brien'); DROP TABLE typed_names; --"
    assert sql.query(spark, "SELECT :v AS v", {"v": text}).first()[0] == text


def test_catalog_aliases_do_not_change(spark, sf):
    c = sql.Catalog(spark, sf, ("region",))
    assert c.table("region").count() == 5
    c.register("mine", spark.range(2))
    with pytest.raises(sql.Refused):
        c.register("mine", spark.range(3))
    with pytest.raises(sql.Refused):
        c.register("region", spark.range(3))
    with pytest.raises(sql.Refused):
        c.drop("region")
    assert c.query("SELECT count(*) FROM mine", using=("mine",)).first()[0] == 2
    c.drop("mine")
    with pytest.raises(sql.Refused):
        c.table("mine")


@pytest.mark.parametrize(("text", "cap", "want"), [("ab\ncd\nef", 5, ["ab\n", "cd\nef"]), ("αβγδε\nz", 5, ["αβ", "γδ", "ε\nz"]), ("", 4, [""]), ("abcdefghi", 4, ["abcd", "efgh", "i"])])
def test_line_windows(text, cap, want):
    assert list(X.line_windows(text, cap)) == want
    with pytest.raises(ValueError):
        list(X.line_windows(text, 3))


def test_line_windows_add_up():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "é", "\n", "\r", "日本", " "]) for _ in range(r.randint(0, 60)))
        cap = r.randint(4, 20)
        got = list(X.line_windows(text, cap))
        assert "".join(got) == text and all(len(w.encode()) <= cap for w in got)


FUSION = [("A", "lexical", "a", 1, 2.0), ("A", "vector", "a", 1, 0.1), ("A", "lexical", "b", 1, 1.0), ("A", "vector", "b", 1, 0.2), ("S", "vector", "b", 1, 0.5)]


def test_fusion_known_answer(spark):
    df = spark.createDataFrame(FUSION, "family string, channel string, target string, occurrence int, score double")
    got = {r.target: r.score for r in ranking.fuse(df).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61)


def test_fusion_null_abstains_zero_votes(spark):
    rows = [("A", "lexical", "a", 1, None), ("A", "lexical", "b", 1, -0.0), ("A", "vector", "b", 1, 0.0), ("A", "vector", "c", 1, -0.7)]
    df = spark.createDataFrame(rows, "family string, channel string, target string, occurrence int, score double")
    assert [r.target for r in ranking.fuse(df).orderBy("score", ascending=False).collect()] == ["b", "c"]


def test_pagerank_known_graph(spark):
    arcs = spark.createDataFrame([(0, 1, 2), (0, 1, 1), (0, 2, 1), (1, 2, 2), (2, 0, 1), (3, 2, 1), (4, 0, 2), (4, 3, 1)], "src int, dst int, weight long")
    got = {r.node: r.score for r in graph.pagerank(arcs, spark.createDataFrame([(i,) for i in range(6)], "node int")).collect()}
    weight: dict = {}
    for a, b, w in [(0, 1, 3), (0, 2, 1), (1, 2, 2), (2, 0, 1), (3, 2, 1), (4, 0, 2), (4, 3, 1)]:
        weight.setdefault(a, {})[b] = w
    x = [1 / 6] * 6
    for _ in range(200):
        lost = sum(x[i] for i in range(6) if i not in weight)
        x = [0.15 / 6 + 0.85 * lost / 6 + 0.85 * sum(x[a] * o[i] / sum(o.values()) for a, o in weight.items() if i in o) for i in range(6)]
    assert sum(got.values()) == pytest.approx(1, abs=1e-12)
    assert all(got[i] == pytest.approx(x[i], abs=1e-9) for i in range(6))


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_pagerank_deals_arcs_by_rows(spark, monkeypatch, small):
    """Tables of arcs are dealt by number of rows, also where half of all arcs have one end and most are given twice."""
    from tessera.functions import parts

    cut, most = graph._cut, []

    def cut_(df):
        out = cut(df)
        if {"src", "dst"} <= set(out.columns):
            most.append(max(r["count"] for r in out.groupBy(F.input_file_name()).count().collect()))
        return out

    monkeypatch.setattr(graph, "_cut", cut_)
    monkeypatch.setattr(graph, "SMALL_IDS", small, raising=False)
    monkeypatch.setattr(parts, "ROWS_A_TASK", 100)
    pairs = [(i, 0) for i in range(1, 900)] + [(i, 1 + (i * 7 + 1) % 900) for i in range(1, 800)] + [(0, 5), (0, 6)]
    weight: dict = {}
    for a, b in pairs + pairs[:1000]:
        weight.setdefault(a, {})
        weight[a][b] = weight[a].get(b, 0) + 1
    arcs = spark.createDataFrame(pairs + pairs[:1000], "src long, dst long").withColumn("weight", F.lit(1).cast("long"))
    got = {r.node: r.score for r in graph.pagerank(arcs, arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()).collect()}
    assert most and max(most) <= 200
    nodes = sorted({x for p in pairs for x in p})
    n, x = len(nodes), dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(150):
        lost, y = sum(x[i] for i in nodes if i not in weight), dict.fromkeys(nodes, 0.0)
        for a, o in weight.items():
            for b, w in o.items():
                y[b] += w / sum(o.values()) * x[a]
        x = {i: 0.15 / n + 0.85 * lost / n + 0.85 * y[i] for i in nodes}
    assert got.keys() == x.keys() and all(got[i] == pytest.approx(x[i], abs=1e-9) for i in nodes)
    assert {r.node for r in graph.pagerank(arcs, max_rounds=1).collect()} == x.keys()


def test_graph_schedule_and_bounds(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    parts = graph.strong_components(arcs, nodes)
    assert {(r.node, r.component) for r in parts.collect()} == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6)}
    levels = {r.component: r.level for r in graph.callee_first(arcs, parts).collect()}
    assert levels[4] < levels[2] < levels[1]
    assert {r.node for r in graph.cyclic_nodes(arcs).collect()} >= {2, 3, 5}
    assert graph.bounded_search(arcs, 1, 1, 100)[1] == "depth"
    assert graph.bounded_search(arcs, 1, 9, 2)[1] == "vertices"
    found, why = graph.bounded_search(arcs, 1, 9, 100, boundary=spark.createDataFrame([(2,)], "node long"))
    assert why == "exhausted" and {r.node for r in found.collect()} == {1, 2}


def _all_concepts(pairs, objects, attributes, least):
    out = set()
    for k in range(len(attributes) + 1):
        for want in itertools.combinations(attributes, k):
            extent = frozenset(o for o in objects if all((o, a) in pairs for a in want))
            intent = frozenset(a for a in attributes if all((o, a) in pairs for o in extent))
            if len(extent) >= least:
                out.add((extent, intent))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_concepts_by_enumeration(seed):
    r = random.Random(seed)
    objects, attributes, least = list(range(r.randint(1, 9))), list(range(100, 100 + r.randint(1, 6))), r.choice([0, 1, 2])
    pairs = {(o, a) for o in objects for a in attributes if r.random() < 0.55}
    c = concepts.Context(sorted(pairs), objects, attributes)
    found, basis, _, cut = concepts.analyse(c, least)
    names = {(frozenset(c.objects[i] for i in concepts._bits(e)), frozenset(c.attributes[i] for i in concepts._bits(a))) for e, a in found}
    assert names == _all_concepts(pairs, objects, attributes, least) and not cut
    if least == 0:  # the basis is sound and complete
        rules = [(p, p | q) for p, q, _ in basis]
        assert all(concepts.implied(m, rules) == c.closed(m) for m in range(1 << len(attributes)))


def test_diagrams_against_truth_tables():
    r = random.Random(5)
    atoms = ["a", "b", "c", "d"]

    def tree(depth):
        return r.choice(atoms) if depth == 0 or r.random() < 0.2 else r.choice([["not", tree(depth - 1)], ["and", tree(depth - 1), tree(depth - 1)], ["or", tree(depth - 1), tree(depth - 1)]])

    def value(t, env):
        if isinstance(t, str):
            return env[t]
        return not value(t[1], env) if t[0] == "not" else (all if t[0] == "and" else any)(value(x, env) for x in t[1:])

    worlds = [dict(zip(atoms, v, strict=True)) for v in itertools.product([False, True], repeat=4)]
    for _ in range(60):
        d, x, y = conditions.Diagrams(), tree(4), tree(4)
        f, g = d.build(x), d.build(y)
        assert d.implies(f, g) == all(value(y, w) or not value(x, w) for w in worlds)
        assert d.compatible(f, g) == any(value(y, w) and value(x, w) for w in worlds)
        assert all(d.restricted(f, w) == int(value(x, w)) for w in worlds)
        gone = d.exists(f, ["a"])
        assert all((d.restricted(gone, w) == 1) == (value(x, w | {"a": True}) or value(x, w | {"a": False})) for w in worlds)
    with pytest.raises(conditions.Boundary):
        d = conditions.Diagrams(max_nodes=5)
        d.build(["and", *[["or", f"x{i}", f"y{i}"] for i in range(9)]])


def test_projection_losses(spark):
    q = spark.createDataFrame([("q", [1.0, 0.2, 0.0])], "item string, vector array<float>")
    t = spark.createDataFrame([("z-best", [1.0, 0.2, 0.0]), ("a-prefix-tie", [1.0, 0.2, 5.0])], "item string, vector array<float>")
    r = search.projection_losses(q, t, 2, 1).collect()
    assert [(x.target, x.found) for x in r] == [("z-best", False)]


def test_cursor_is_bound_to_its_request():
    token = paging.cursor({"q": 1}, "s1", 42)
    assert paging.resume(token, {"q": 1}, "s1") == 42
    for request, snapshot in (({"q": 2}, "s1"), ({"q": 1}, "s2")):
        with pytest.raises(sql.Refused):
            paging.resume(token, request, snapshot)


def test_store_publishes_whole_snapshots(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.selected() is None
    with pytest.raises(sql.Refused):
        s.read("t")
    one = s.publish({"t": spark.range(5)})
    assert s.selected() == one and s.read("t").count() == 5
    s.backup(one, f"file://{tmp_path}/copy")
    with pytest.raises(sql.Refused):
        s.backup(one, f"file://{tmp_path}/copy")
    two = s.restore(f"file://{tmp_path}/copy")
    assert two != one and store.digest(s.read("t")) == store.digest(spark.range(5))
    with pytest.raises(sql.Refused):
        s.retire(two)
    s.retire(one)
    with pytest.raises(sql.Refused):
        s.read("t", one)
    spark.range(6).write.mode("overwrite").parquet(f"file://{tmp_path}/copy/t")
    with pytest.raises(sql.Refused):
        s.restore(f"file://{tmp_path}/copy")


def test_file_connectors(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text('"""Module."""\nclass C:\n    """Class."""\n    def f(self):\n        "Method."\n')
    (tmp_path / "src" / "METADATA").write_text("Name: demo\nRequires-Dist: x>=1\n\nBody")
    (tmp_path / "src" / "p.toml").write_text('[project]\nname = "demo"\n[[package]]\nname = "x"\nversion = "1"\ndependencies = [{name = "y"}]\n')
    root = f"file://{tmp_path}/src"
    found = {r.path: r.byte_len for r in files.inventory(spark, root, content=False).collect()}
    assert set(found) == {"a.py", "METADATA", "p.toml"}
    docs = files.inventory(spark, root, "*.py").select(files.docstrings("content").alias("d")).first().d
    assert [(x.owner, x.text) for x in docs] == [("", "Module."), ("C", "Class."), ("C.f", "Method.")]
    meta = files.inventory(spark, root, "METADATA").select(files.header_fields("content").alias("d")).first().d
    assert ("Name", "demo") in [(x.field, x.value) for x in meta]
    lock = files.inventory(spark, root, "*.toml").select(files.lock_packages("content").alias("d")).first().d
    assert [(x.name, x.version, x.needs) for x in lock] == [("x", "1", ["y"])]
    leaves = files.inventory(spark, root, "*.toml").select(files.toml_fields("content").alias("d")).first().d
    assert ("project", "name", '"demo"') in [(x.section, x.field, x.value) for x in leaves]
    r = spark.createDataFrame([("a.py", 3, 9), ("a.py", 0, 9999)], "path string, start int, stop int")
    got = {x.stop: x for x in files.byte_ranges(files.inventory(spark, root), r).collect()}
    assert bytes(got[9].bytes) == b"Module" and got[9999].error == "outside"


def test_resolution_helpers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "resolved"), ("a", "unresolved"), ("b", "ambiguous"), ("b", "resolved"), ("c", "resolved")], "k string, s string")
    assert dict(df.groupBy("k").agg(resolution.worst_status(F.col("s")).alias("s")).collect()) == {"a": "unresolved", "b": "ambiguous", "c": "resolved"}


def test_classify_order(spark):
    obs = spark.createDataFrame([("a", "c", 1, True), ("a", "c", 1, False), ("b", "c", 1, False), ("d", "c", 1, None)], "candidate string, context string, basis int, value boolean")
    dom = spark.createDataFrame([("a", True), ("b", True), ("d", True), ("e", True), ("f", False)], "candidate string, closed boolean")
    got = {r.candidate: (r.outcome, r.reason) for r in selection.classify(obs, dom, "any").collect()}
    assert got == {"a": ("conflicting", "conflict"), "b": ("contradicted", "closed_absence"), "d": ("unresolved", "open"), "e": ("contradicted", "no_applicable_domain"), "f": ("unresolved", "open")}
    assert {r.candidate: r.outcome for r in selection.classify(obs, dom, "all").collect()}["a"] == "contradicted"


def test_a_followed_stream_goes_on_where_it_stopped(spark, sf, tmp_path):
    """Micro-batches of a file each, in two runs with one checkpoint: each window as its last change left it."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.filter("event_id % 3 > 0").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 4))
    for rows in (batch.filter("event_id % 3 > 0"), batch):
        windows.follow(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", late="60 days")
        assert sorted(map(key, windows.followed(spark, f"{tmp_path}/out").collect())) == sorted(map(key, windows.tumbling(rows).collect()))
        batch.filter("event_id % 3 = 0").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = windows.stream_once(stream, "windows_test", f"{tmp_path}/cp", late="60 days")
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 4))
    assert sorted(map(key, got.collect())) == sorted(map(key, windows.tumbling(batch).collect()))


def test_spread_deals_by_rows(spark):
    from tessera.functions import parts

    df = spark.range(1000).selectExpr("id % 50 as k", "id")
    few, many = parts.spread(df, "k", rows=1), parts.spread(df, "k", rows=20 * parts.ROWS_A_TASK)
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 20
    assert sorted(many.collect()) == sorted(df.collect())
