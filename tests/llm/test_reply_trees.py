import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crowdlens.llm import reply_trees as rt
from crowdlens.llm.queries import CONTROL_TEXT

ODD = ["", CONTROL_TEXT, "\\", "<|", "<\\|", "\\\\<|\\", "<\\\\|", "<\\n", "<\n", "a\nb", "😀é<|im_start|>", "<<||", "|>\\n"]


def read(spark, rows, **more):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x"))
    texts = rt.formatted(rt.paths(rt.linear(frame), **more))
    return {r.conv_id: r for r in rt.read_back(texts).collect()}


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None, "sys\ntem", "<|x", "a\\n"]), rng.choice([*ODD, None]))
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (77, 1, "assistant", "b"), (77, 1, "assistant", "b"),
             (77, None, "user", "first"), (78, 5, "assistant", "漢" * 100_000)] + [(79, i, "assistant", str(i)) for i in range(130)]
    got = read(spark, rows)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [tuple(t) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].loss_text == "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].formatted.count(rt.START) == got[c].formatted.count(rt.END) == len(turns)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="<|\\n\nab>", max_size=12))
def test_escapes_are_reversible(one, text):
    safe, role = one(rt.escaped(F.lit(text)), rt.escaped_role(F.lit(text)))
    assert "<|" not in safe and "<|" not in role and "\n" not in role
    assert one(rt.restored(F.lit(safe)), rt.restored_role(F.lit(role))) == (text, text)


def test_best_branches_of_random_trees(spark):
    rng, rows, trees = random.Random(5), [], {}
    for c in range(12):
        n = rng.randrange(1, 40)
        parent = {i: (None if i == 0 or rng.random() < 0.05 else rng.randrange(i)) for i in range(n)}
        good = {i: rng.randrange(10) for i in range(n)}
        trees[c] = parent, good
        rows += [(c, i, "assistant", str(good[i]), i, parent[i] if parent[i] is not None else rng.choice([None, 999])) for i in range(n)]
    rows += [(50, 0, "user", "1", 1, 2), (50, 1, "user", "1", 2, 1)]  # a loop has no root
    nodes = rt.branching(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, me long, over long"),
                         "me", "over")
    got = {}
    for r in rt.paths(nodes, F.col("text").cast("double"), best=3).collect():
        got.setdefault((r.conv_id, r.branch), {})[r.depth] = int(r.text)
    want = {}
    for c, (parent, good) in trees.items():
        ways = []
        for leaf in set(parent) - set(parent.values()):
            way = [leaf]
            while parent[way[0]] is not None:
                way.insert(0, parent[way[0]])
            ways.append((-sum(good[i] for i in way) / len(way), -len(way), leaf, [good[i] for i in way]))
        for branch, way in enumerate(sorted(ways)[:3]):
            want[c, branch + 1] = dict(enumerate(way[3]))
    assert got == want


def test_empty_tables_and_plan(spark):
    assert read(spark, []) == {}
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = rt.read_back(rt.formatted(rt.paths(rt.linear(frame))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
