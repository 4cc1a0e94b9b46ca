"""Type terms as a relation, and substitution in many environments at a time.

terms: term (an id), kind (con, var), name, args (array of ids; empty for variables). Ids are names of contents
(`term_id`), so that equal terms are one row and a subterm is shared by all that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import framed
from tessera.operators.graph import _cut

MAX_ROUNDS = 128


class Refused(ValueError):
    pass


def term_id(kind: Column, name: Column, args: Column) -> Column:
    """32 hex digits of a framed digest: sizes keep names and ids apart."""
    return F.substring(F.sha2(F.concat_ws(":", kind, F.octet_length(name), name, F.size(args), F.array_join(args, ",")).cast("binary"), 256), 1, 32)


def variables(names: DataFrame) -> DataFrame:
    """Terms of variables (name)."""
    none = F.expr("cast(array() as array<string>)")
    return names.select(term_id(F.lit("var"), F.col("name"), none).alias("term"), F.lit("var").alias("kind"), "name", none.alias("args")).distinct()


def built(rows: DataFrame) -> DataFrame:
    """Terms of constructors (name, args) over known ids."""
    return rows.select(term_id(F.lit("con"), F.col("name"), F.col("args")).alias("term"), F.lit("con").alias("kind"), "name", "args").distinct()


def substituted(terms: DataFrame, bindings: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results: env, root, term, status; terms with those that are new; boundaries: env, root, term, reason).

    bindings: env, name, term; roots: env, root. A variable that its environment binds becomes the bound term, whose own
    variables are replaced as well. Terms are rewritten from the leaves up, a round a level: an environment has a row only for
    terms under its roots that change, once each however often they occur, and what comes out alike is one new term.
    Boundaries: unbound variables, and recursive terms, those on a circle of bindings (or on a way from one to another), which stay as they
    are. status: resolved, partial where a root has boundaries, unknown where it has some and its environment binds nothing.
    Refused: a variable bound to two terms in an environment, and ids without a term.

    What comes of a root depends on what its environment binds alone: environments that bind alike are one class, and the work is
    done once a class.
    """
    once = _cut(bindings.groupBy("env", "name").agg(F.min("term").alias("term"), F.max("term").alias("other")))
    if not once.filter("term <> other").isEmpty():
        raise Refused("a variable is bound to two terms")
    once = once.select("env", "name", "term")
    classes = _cut(_classes(once))
    every = roots.select("env", "root").distinct()
    every = _cut(every.join(classes.withColumnRenamed("env", "of"), F.col("env").eqNullSafe(F.col("of")), "left").select("env", "root", F.coalesce("class", F.lit("")).alias("class")))
    # A class binds what its least environment does.
    least = classes.groupBy("class").agg(F.min("env").alias("of"))
    binds = once.join(least, F.col("env").eqNullSafe(F.col("of"))).select(F.col("class").alias("env"), "name", "term")
    got, out_terms, edges = _substituted(terms, _cut(binds), _cut(every.select(F.col("class").alias("env"), "root").distinct()))
    of = lambda rows: every.join(rows.withColumnRenamed("env", "class"), ["class", "root"])
    return of(got).select("env", "root", "term", "status"), out_terms, of(edges).select("env", "root", "term", "reason")


def _classes(bindings: DataFrame) -> DataFrame:
    """(env, class): a digest of all that an environment binds. Hashes are added up word by word, so that no task holds an environment's bindings."""
    h = bindings.select("env", F.sha2(framed(F.col("name"), F.col("term")), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")) for i in range(8)]
    sums = h.groupBy("env").agg(F.count("*").alias("n"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("env", F.sha2(F.concat_ws(",", "n", *[f"w{i}" for i in range(8)]), 256).alias("class"))


def _substituted(terms: DataFrame, bindings: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`substituted` of environments that each have a name, bind a variable once and ask for a root once."""
    terms = _cut(terms.select("term", "kind", "name", "args").distinct())
    uses = _cut(terms.select(F.col("term").alias("above"), F.explode("args").alias("below")).distinct())
    named = F.col("below").alias("term")
    if not uses.select(named).union(bindings.select("term")).union(asked.select("root")).join(terms, "term", "left_anti").isEmpty():
        raise Refused("an id has no term")
    bound = _cut(bindings.join(terms.filter("kind = 'var'").select(F.col("term").alias("var"), "name"), "name").select("env", F.col("var").alias("above"), F.col("term").alias("below")).distinct())
    # What each root leads to, through arguments and bindings.
    front = seen = _cut(asked.select("env", "root", F.col("root").alias("term")))
    steps = lambda rows: rows.join(uses, rows["term"] == uses["above"]).select("env", "root", F.col("below").alias("term")).union(rows.join(bound, (rows["term"] == bound["above"]) & rows["env"].eqNullSafe(bound["env"])).select(rows["env"], "root", F.col("below").alias("term")))
    for _ in range(MAX_ROUNDS):
        front = _cut(steps(front).distinct().join(seen, ["env", "root", "term"], "left_anti"))
        if front.isEmpty():
            break
        seen = _cut(seen.union(front))
    else:
        raise Refused("terms lie deeper than the rounds that are allowed")
    need = _cut(seen.select("env", "term").distinct())
    # Of these, what a bound variable lies under.
    deps = _cut(need.join(uses, need["term"] == uses["above"]).select("env", "above", "below").union(bound.join(need, (bound["above"] == need["term"]) & (bound["env"] == need["env"])).select(bound["env"], "above", "below")))
    touched = new = _cut(bound.select("env", F.col("above").alias("term")).distinct().join(need, ["env", "term"], "left_semi"))
    while not new.isEmpty():
        new = _cut(deps.join(new.select("env", F.col("term").alias("below")), ["env", "below"], "left_semi").select("env", F.col("above").alias("term")).distinct().join(touched, ["env", "term"], "left_anti"))
        touched = _cut(touched.union(new))
    links = _cut(deps.join(touched.withColumnRenamed("term", "above"), ["env", "above"], "left_semi").join(touched.withColumnRenamed("term", "below"), ["env", "below"], "left_semi").select("env", "above", "below"))
    circles = _circles(links)
    whole = _cut(touched.join(circles, ["env", "term"], "left_anti").join(terms, "term"))
    done = _cut(circles.select("env", "term", F.col("term").alias("new")))
    made = None
    while True:
        waits = links.join(done.select("env", F.col("term").alias("below")), ["env", "below"], "left_anti").select("env", F.col("above").alias("term")).distinct()
        ready = whole.join(done, ["env", "term"], "left_anti").join(waits, ["env", "term"], "left_anti")
        args = ready.select("env", "term", "kind", "name", F.posexplode_outer("args").alias("at", "arg"))
        args = args.join(done.select("env", F.col("term").alias("arg"), F.col("new").alias("put")), ["env", "arg"], "left")
        rows = args.groupBy("env", "term", "kind", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("put", "arg").alias("arg")))), lambda x: x["arg"]).alias("got"))
        rows = rows.withColumn("got", F.filter("got", lambda x: x.isNotNull()))
        to = bound.select("env", F.col("above").alias("term"), F.col("below").alias("to")).join(done.select("env", F.col("term").alias("to"), F.col("new").alias("to_new")), ["env", "to"], "left").select("env", "term", F.coalesce("to_new", "to").alias("to"))
        rows = rows.join(to, ["env", "term"], "left")
        step = _cut(rows.select("env", "term", "name", "got", F.when(F.col("kind") == "var", F.col("to")).otherwise(term_id(F.lit("con"), F.col("name"), F.col("got"))).alias("new"), "kind"))
        if step.isEmpty():
            break
        cons = step.filter("kind = 'con'").select(F.col("new").alias("term"), "kind", "name", F.col("got").alias("args")).distinct()
        made = cons if made is None else made.union(cons)
        done = _cut(done.union(step.select("env", "term", "new")))
    out_terms = terms if made is None else _cut(terms.union(made).distinct())
    free = seen.join(terms.filter("kind = 'var'").select("term"), "term", "left_semi").join(bound.select("env", F.col("above").alias("term")), ["env", "term"], "left_anti")
    stuck = seen.join(circles, ["env", "term"], "left_semi")
    edges = _cut(free.select("env", "root", "term", F.lit("unbound_variable").alias("reason")).union(stuck.select("env", "root", "term", F.lit("recursive").alias("reason"))))
    binds = bindings.select("env").distinct().withColumn("binds", F.lit(True))
    limits = edges.select("env", "root").distinct().withColumn("open", F.lit(True))
    status = F.when(F.col("open").isNull(), "resolved").when(F.col("binds"), "partial").otherwise("unknown")
    got = asked.join(done.select("env", F.col("term").alias("root"), "new"), ["env", "root"], "left").join(limits, ["env", "root"], "left").join(binds, "env", "left")
    return _cut(got.select("env", "root", F.coalesce("new", "root").alias("term"), status.alias("status"))), out_terms, edges


def _circles(links: DataFrame) -> DataFrame:
    """(env, term) left when terms without a link to them, or from them, are taken away again and again."""
    while True:
        n = links.count()
        heads, tails = links.select("env", F.col("above").alias("below")).distinct(), links.select("env", F.col("below").alias("above")).distinct()
        links = _cut(links.join(heads, ["env", "below"], "left_semi").join(tails, ["env", "above"], "left_semi").select("env", "above", "below"))
        if links.count() == n:
            return links.select("env", F.col("above").alias("term")).distinct()


def spelled(terms: DataFrame, most: int = MAX_ROUNDS) -> DataFrame:
    """(term, text): name, or name(arguments), level by level."""
    done = _cut(terms.filter("size(args) = 0").select("term", F.col("name").alias("text")))
    rest = _cut(terms.filter("size(args) > 0").select("term", "name", "args"))
    for _ in range(most):
        if rest.isEmpty():
            return done
        parts = rest.select("term", "name", F.posexplode("args").alias("at", "arg")).join(done.select(F.col("term").alias("arg"), "text"), "arg", "left")
        whole = parts.groupBy("term", "name").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("xs"), F.count_if(F.col("text").isNull()).alias("open")).filter("open = 0")
        step = _cut(whole.select("term", F.concat("name", F.lit("("), F.array_join(F.transform("xs", lambda x: x["text"]), ", "), F.lit(")")).alias("text")))
        done, rest = _cut(done.union(step)), _cut(rest.join(step, "term", "left_anti"))
    raise Refused("terms lie deeper than the rounds that are allowed")
