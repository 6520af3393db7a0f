"""What tests share; a name of its own, as two folders have a `conftest`."""

import uuid

from py4j.protocol import Py4JJavaError


def rows(df, *columns):
    """The rows as sorted tuples, nulls first."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def rows_read(spark, action):
    """How many rows the stages of `action` read from files."""
    return _summed(spark, action, lambda stage: stage.inputRecords())


def bytes_shuffled(spark, action):
    """How many bytes the stages of `action` wrote for a shuffle, compressed."""
    return _summed(spark, action, lambda stage: stage.shuffleWriteBytes())


def _summed(spark, action, value):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        action()
    finally:
        sc._jsc.sc().clearJobGroup()
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}

    def of(stage):
        try:
            return value(store.lastStageAttempt(stage))
        except Py4JJavaError:  # a stage that was skipped has no attempt
            return 0

    return sum(map(of, stages))
