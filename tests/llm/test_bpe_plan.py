"""What the driver keeps of the byte-pair plan: Spark holds its description for every run and every stage that ends."""

import public_tokenizers as P

from helpers import DOCS
from lotwise.llm import bpe


def test_plan_does_not_hold_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "plain words, élan\n", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    out = bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    run = out._jdf.queryExecution()
    assert len(run.toString()) < 100_000  # 1.4 million characters and more with the rank map as literals
    info = spark._jvm.org.apache.spark.sql.execution.SparkPlanInfo.fromSparkPlan(run.executedPlan())
    todo, chars = [info], 0
    while todo:
        node = todo.pop()
        chars += len(node.simpleString())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert chars < 100_000


def test_vocabulary_is_not_copied_into_rows(spark):
    """The subqueries stand in the expressions; no projection puts their arrays beside each word or document."""
    df = spark.createDataFrame([(1, "plain words", "en", "s", 0)], DOCS)
    out = bpe.round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for name in ("pairs", "of_bytes", "pieces"):
        assert f" AS {name}#" not in plan
