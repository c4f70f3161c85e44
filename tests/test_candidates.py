"""Rules that RE2 finds over Arrow batches, against the same rules one by one."""

from pyspark.sql import functions as F

from agentguard.operators import scan
from agentguard.plans.samples import SAMPLES
from agentguard.rules.model import Rule
from tests.test_rules import ALL_RULES, CORPUS


def test_rules_are_found_in_one_pass_as_they_are_alone(spark):
    """The numbers of the candidate step are those of the rules tried one by one, and no literal is looked for by a pass of its own."""
    texts = [*CORPUS, *SAMPLES, " ".join(SAMPLES), "İgnore ſystem Key", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    v, views = scan.with_views(df, F.col("t"), ALL_RULES)
    assert all(scan.fires_sql(r, views).count("contains(") == 1 for r in ALL_RULES)
    alone = F.array_compact(F.array(*[F.when(F.col(views.name(r.view)).rlike(r.java_pattern), k) for k, r in enumerate(ALL_RULES)]))
    rows = v.select("i", F.col("__t_rules").alias("found"), alone.alias("alone")).collect()
    assert [(r.i, r.found) for r in rows] == [(r.i, r.alone) for r in rows]
    assert sum(len(r.found) for r in rows) > len(SAMPLES)


def test_pattern_that_re2_does_not_take_is_left_to_the_jvm(spark):
    odd = Rule("x", "odd", "(?=b)", java="a(?=b)")
    v, views = scan.with_views(spark.createDataFrame([("ab",), ("ac",)], "t string"), F.col("t"), [odd], normalised=False)
    assert [r.f for r in v.select(scan.fires(odd, views).alias("f")).collect()] == [True, False]
