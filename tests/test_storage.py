import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.operators.alerts import mitre_enrich
from flowsentry.plans.storage import checkpoint_dir, materialize


def session(named, set_on_context, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_on_context, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=context)


def test_named_folder_is_used():
    assert checkpoint_dir(session("hdfs:///shared", None, "yarn")) == "hdfs:///shared"
    assert checkpoint_dir(session(None, "hdfs:///set", "yarn")) == "hdfs:///set"


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session(None, None, "spark://host:7077"))


def test_materialize_cuts_the_lineage(spark):
    made = materialize(spark.range(10).withColumn("x", F.rand()))
    assert made.collect() == made.collect() and len(made.inputFiles()) > 0
    assert os.path.exists(checkpoint_dir(spark).replace("file:", ""))


def test_wider_technique_table(spark):
    df = spark.createDataFrame([("PORT_SCAN",), ("AUTH_FAIL",), ("x",)], "event_type string")
    rows = mitre_enrich(df, tactics=dims.MITRE_TACTICS, techniques=dims.MITRE_TECHNIQUES).collect()
    assert [tuple(r)[1:] for r in rows] == [("Reconnaissance", "T1046"), ("Credential Access", "T1110"), ("Unknown", "Unknown")]
