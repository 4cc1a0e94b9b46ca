"""Functions and predicates on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import aggregates, predicates, validation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    assert one(spark, X.normal_name(F.lit("Some_.Name--x"))) == "some-name-x"
    for name, dotted, distinctive in (("a.b_c", True, True), ("word", True, False), ("HttpClient", True, True), ("1a", False, False), ("_x", True, False), ("URL", True, False)):
        assert one(spark, X.is_dotted(F.lit(name))) is dotted and one(spark, X.is_distinctive(F.lit(name))) is distinctive
    assert one(spark, X.analyzed(F.lit("HTTPServer readLine_2x"))) == ["http", "server", "read", "line", "2x"]
    r = one(spark, X.parsed_requirement(F.lit("Foo_Bar[x,y] >=1.0 ; python_version<'3'")))
    assert (r.name, r.extras, r.specifier, r.marker) == ("foo-bar", "x,y", ">=1.0", "python_version<'3'")


def test_framed_ids_do_not_collide(spark):
    ids = {one(spark, X.framed_id("t", F.lit(a), F.lit(b))) for a, b in (("ab", "c"), ("a", "bc"), ("abc", ""), ("", "abc"))}
    assert len(ids) == 4 and one(spark, X.framed_id("t", F.lit(None), F.lit("x"))) != one(spark, X.framed_id("t", F.lit("-"), F.lit("x")))


def test_finite(spark):
    assert str(one(spark, X.finite(F.lit(-0.0)))) == "0.0"
    with pytest.raises(Exception, match="not finite"):
        one(spark, X.finite(F.lit(float("nan"))))


def test_path_relation(spark):
    a = lambda *x: F.array(*[F.lit(y) for y in x]) if x else F.array().cast("array<string>")
    for p, q, want in ((a("x"), a("x", "y"), "rest"), (a("x", "y"), a("x"), "shorter"), (a("x"), a("z"), "disjoint"), (a("x"), a("x"), "rest"), (F.lit(None).cast("array<string>"), a("x"), "unknown")):
        assert one(spark, X.path_relation(p, q)) == want


def test_body_containment(spark):
    rows = [("s", 0, 100, ["m"], "s", 10, 20, ["m", "f"]), ("s", 0, 100, ["m"], "t", 10, 20, ["m", "f"]), ("s", 0, 100, ["m"], "s", 10, 120, ["m", "f"]), ("s", 0, 100, ["m"], "s", 10, 20, ["n", "f"])]
    df = spark.createDataFrame(rows, "a string, b int, c int, d array<string>, e string, f int, g int, h array<string>")
    df = df.select(F.struct(F.col("a").alias("source"), F.col("b").alias("start"), F.col("c").alias("stop"), F.col("d").alias("path")).alias("p"), F.struct(F.col("e").alias("source"), F.col("f").alias("start"), F.col("g").alias("stop"), F.col("h").alias("path")).alias("q"))
    assert [r.x for r in df.select(predicates.body_contains("p", "q").alias("x")).collect()] == [True, False, False, False]


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, V.cosine(a(3, 4), a(6, 8))) == pytest.approx(1) and one(spark, V.norm(a(0, 0))) is None
    assert one(spark, V.project_prefix(a(3, 4, 9), 2)) == pytest.approx([0.6, 0.8])


def test_known_shares_and_weights(spark):
    u = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("t", "a"), ("u", None)], "site string, target string")
    assert {r.target: (r.share, r.sites) for r in aggregates.usage_share(u, "site", "target").collect()} == {"a": (1.5, 2), "b": (0.5, 1)}
    p = spark.createDataFrame([(1, 2, 5), (2, 3, 1)], "a int, b int, n long")
    assert {(r.a, r.b): pytest.approx(r.weight) for r in aggregates.layer_weights(p).collect()} == {(1, 2): 5 / 6, (2, 3): 1 / 6}
    with pytest.raises(Exception, match="self pair"):
        aggregates.canonical_pairs(spark.createDataFrame([(1, 1, 1)], "a int, b int, n long")).collect()


def test_findings_of_a_model(spark):
    r = {"a": spark.createDataFrame([(1, 7), (1, 9), (2, None)], "id int, b int"), "b": spark.createDataFrame([(7,)], "id int")}
    found = {(x.kind, x.relation): x.n for x in validation.replay(r, {"a": ["id"], "b": ["id"]}, [("a", "b", "b", "id")]).collect()}
    assert found == {("duplicate_key", "a"): 1, ("missing_reference", "a"): 1}
    assert [tuple(x) for x in validation.null_required(r["a"], ["id", "b"]).collect()] == [("b", 1)]
    assert validation.violations(r["a"], "b is small", F.col("b") < 8, "id").count() == 2


def test_identifier_spans_of_long_batches(spark, monkeypatch):
    import re

    import pyarrow as pa

    from tessera.functions import text as X

    texts = ["aé.b _c1 9x.y.z", None, "", "ü é", "Straße.x" * 50, *[f"w{i} é.{i}_q" for i in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.s for r in df.select("i", X.identifier_spans("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [(m.start(), m.end(), m[0].decode()) for m in re.finditer(rb"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*", t.encode())]
        assert (None if got[i] is None else list(map(tuple, got[i]))) == want
    monkeypatch.setattr(X, "SPAN_BYTES", 64)
    seen, cut = [], X._spans_of
    monkeypatch.setattr(X, "_spans_of", lambda a: seen.append(len(a)) or cut(a))
    out = X.identifier_spans.func(pa.array(texts))
    assert out.to_pylist() == cut(pa.array(texts)).to_pylist() and sum(seen) == len(texts) and len(seen) > 20
    assert X.identifier_spans.func(pa.array([], pa.string())).to_pylist() == []
