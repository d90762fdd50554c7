"""What the plans look like, and that one very large configuration changes neither plan nor result."""

from unittest import mock

import pytest
from pyspark.sql import functions as F

from colweave import apply_mapping, apply_mappings, compile_mapping_arrays, mapping_rejects
from colweave.operators import columns
from colweave.operators.columns import attach_source_table, hot_configurations, ordered_text
from colweave.plans.compile import source_entries
from colweave.schemas import MAPPING
from workload import inputs


def plan_of(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Set Spark settings for one test."""
    before = {}

    def set_all(**values):
        for name, value in values.items():
            key = name.replace("_", ".")
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot(spark, sf_dir):
    """The mapping with a third of all rows under one configuration of a few hundred columns."""
    rows = inputs.mapping(spark, sf_dir)
    hot_row = F.pmod(F.xxhash64("config_id", "custom_column_mapping_id"), F.lit(3)) == 0
    number = F.pmod(F.xxhash64("custom_column_mapping_id", "config_id"), F.lit(300))
    return rows.withColumns(
        {
            "config_id": F.when(hot_row, 7).otherwise(F.col("config_id")),
            "target_column_name": F.when(hot_row, F.concat(F.lit("T"), number)).otherwise(
                F.col("target_column_name")
            ),
        }
    )


def test_compile_has_two_exchanges_of_the_mapping_and_no_python(spark, sf_dir):
    frame, tables = inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir)
    plan = plan_of(compile_mapping_arrays(frame, tables))
    assert "Python" not in plan and "Window" not in plan and "Cartesian" not in plan
    # one scan and two exchanges of the mapping, one of each for the config
    assert plan.count("FileScan") == 2
    assert plan.count("Exchange hashpartitioning") == 3


def test_compile_joins_without_a_further_exchange_or_a_broadcast(spark, sf_dir):
    plan = plan_of(compile_mapping_arrays(inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir)))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Exchange") == 3


def test_apply_reads_only_what_it_needs(spark, sf_dir, tmp_path):
    inputs.source(spark, sf_dir).write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    plan = plan_of(apply_mapping(inputs.lineitem_mapping(spark), source, 1))
    assert "Exchange" not in plan and "Python" not in plan
    assert "EqualTo(AUDIT_ACTIVE_ROW_IND,Y)" in plan
    assert "l_tax" not in plan and "l_discount" not in plan


def test_a_hot_configuration_compiles_like_any_other(spark, sf_dir):
    frame, tables = hot(spark, sf_dir), inputs.config(spark, sf_dir)
    record = compile_mapping_arrays(frame, tables, return_length=0).filter("config_id = 7").first()
    alone = compile_mapping_arrays(frame, tables, config_id=7, return_length=0).first()
    assert record == alone
    assert len(record.nkeys.split(";")) == len(set(record.nkeys.split(";"))) > 250


def test_the_config_join_has_one_plan(spark, sf_dir):
    plan = plan_of(attach_source_table(inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir)))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_compile_from_the_mapping_alone_is_one_scan_and_two_exchanges(spark, sf_dir):
    plan = plan_of(compile_mapping_arrays(inputs.mapping(spark, sf_dir)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "Python" not in plan


def test_rejects_scan_the_mapping_once(spark, sf_dir):
    frame, tables = inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir)
    alone, joined = plan_of(mapping_rejects(frame)), plan_of(mapping_rejects(frame, tables))
    assert alone.count("FileScan") == 1 and alone.count("Exchange") == 1
    assert joined.count("FileScan") == 2 and "Broadcast" not in joined


def test_the_text_of_a_hot_group_is_made_in_many_tasks(spark, settings):
    settings(spark_sql_adaptive_coalescePartitions_enabled="false")
    frame = spark.range(40_000).selectExpr("0 as g", "id as n", "cast(id as string) as item").repartition(8)
    text = ordered_text(frame, "g", ("n",), F.col("item"), ",", "text")
    assert text.first().text == ",".join(map(str, range(40_000)))
    # the text of the group was put together from that of several partitions
    plan = plan_of(text, final=True)
    assert plan.count("ObjectHashAggregate") + plan.count("SortAggregate") >= 2
    laid = frame.repartitionByRange("g", "n", "item").groupBy(F.spark_partition_id()).count()
    assert laid.count() > 3


def test_a_hot_configuration_is_split_in_the_join(spark, sf_dir, settings):
    settings(
        spark_sql_adaptive_advisoryPartitionSizeInBytes="64k",
        spark_sql_adaptive_skewJoin_skewedPartitionThresholdInBytes="64k",
        spark_sql_adaptive_skewJoin_skewedPartitionFactor="1.5",
        spark_sql_adaptive_coalescePartitions_enabled="false",
    )
    # a partition is split along the tasks that wrote it, so there must be several
    frame, tables = hot(spark, sf_dir).repartition(8), inputs.config(spark, sf_dir)
    one_salt = attach_source_table(frame, tables, salts=1)
    assert "skew=true" in plan_of(one_salt, final=True)
    key = ["config_id", "custom_column_mapping_id", "source_table", "table_reject"]
    salted = attach_source_table(frame, tables).select(*key)
    tasks = salted.filter("config_id = 7").groupBy(F.spark_partition_id()).count().count()
    assert tasks > 3
    alone = one_salt.select(*key)
    assert salted.exceptAll(alone).count() == 0 and alone.exceptAll(salted).count() == 0


def test_a_hot_configuration_is_listed_by_many_tasks(spark, sf_dir, settings):
    """By source column every entry stays: a third of all rows belongs to one configuration."""
    settings(spark_sql_adaptive_coalescePartitions_enabled="false")
    frame = hot(spark, sf_dir).withColumn("active_ind", F.lit(1)).repartition(8)
    laid = source_entries(frame).repartitionByRange("config_id", "slot", "pos", "name")
    tasks = laid.filter("config_id = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2
    record = compile_mapping_arrays(frame, key="source", return_length=0).filter("config_id = 7").first()
    alone = compile_mapping_arrays(frame, config_id=7, key="source", return_length=0).first()
    assert record == alone
    rows = sorted(source_entries(frame).filter("config_id = 7").collect(), key=lambda r: (r.pos, r.name, r.text))
    assert len(rows) == sum(row["count"] for row in tasks) > 5_000
    for prefix, kind in (("b", "Boolean"), ("d", "Date"), ("dt", "Timestamp"), ("n", "Numeric"), ("s", "String")):
        own = [row for row in rows if row.slot == kind]
        assert record[f"{prefix}keys"] == ";".join(row.name for row in own)
        assert record[f"{prefix}vals"] == ";".join(row.text for row in own)


def test_quoted_and_padded_lists_by_source_column(spark):
    rows = [(1, n, "d", "s", "t", f"C{n}", "T", 1, 0, 1, "f(i0)", "", "String") for n in range(3)]
    rows.append((2, 9, "d", "s", "t", "D", "T", 1, 0, None, None, None, None))
    frame = spark.createDataFrame(rows, MAPPING)
    found = {r.config_id: r for r in compile_mapping_arrays(frame, return_length=4, key="source", quote=True, sep="'|").collect()}
    assert found[1].skeys == "'|".join(['"C0"', '"C1"', '"C2"', '"_s4"'])
    assert found[1].svals == "'|".join(['"f(C0)"', '"f(C1)"', '"f(C2)"', '"toString(null())"'])
    assert found[2].skeys == "'|".join(f'"_s{n}"' for n in range(1, 5)) and found[2].source_query is not None


def test_all_configurations_are_applied_in_one_scan(spark, sf_dir, tmp_path):
    inputs.source(spark, sf_dir).write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    frame = inputs.lineitem_mappings(spark)
    plan = plan_of(apply_mappings(frame, source, [1, 3]))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "l_tax" not in plan
    assert "EqualTo(AUDIT_ACTIVE_ROW_IND,Y)" in plan
    # a column that one of them derives and the source has is another thing to it
    assert plan_of(apply_mappings(frame, source, [1, 2, 3])).count("FileScan") == 2
    stacked = apply_mappings(frame, source, [1, 2, 3, 3])
    for config_id in (1, 2, 3):
        alone = apply_mapping(frame, source, config_id)
        own = stacked.filter(F.col("config_id") == config_id).select(*alone.columns)
        assert own.schema.simpleString() == alone.schema.simpleString()
        assert own.exceptAll(alone).count() == 0 and alone.exceptAll(own).count() == 0
    assert apply_mappings(frame, source, [99]).collect() == []
    with pytest.raises(ValueError, match="column l_orderkey is string"):
        rows = [(4, 1, "d", "s", "t", "l_partkey", "l_orderkey", 1, 0, 1, "'a'", None, "String")]
        apply_mappings(frame.unionByName(spark.createDataFrame(rows, MAPPING)), source, [1, 4])


def test_only_hot_configurations_are_salted(spark, sf_dir):
    frame, tables = hot(spark, sf_dir).repartition(8), inputs.config(spark, sf_dir)
    assert hot_configurations(frame) == [7] and hot_configurations(inputs.mapping(spark, sf_dir)) == []
    assert hot_configurations(frame.limit(0)) == []
    plan = plan_of(attach_source_table(inputs.mapping(spark, sf_dir), tables))
    assert "_salt" not in plan  # none is hot, no config row is copied
    copied = []
    with mock.patch.object(columns, "_with_reject", lambda joined: copied.append(joined) or joined):
        attach_source_table(frame, tables)
    right = copied[0]._jdf.queryExecution().analyzed().toString()
    assert "_salt" in right
    key = ["config_id", "custom_column_mapping_id", "source_table", "table_reject"]
    salted, plain = attach_source_table(frame, tables).select(*key), attach_source_table(frame, tables, salts=1).select(*key)
    assert salted.count() == frame.count() and salted.exceptAll(plain).count() == 0
    # a config row for each configuration, and seven more of the hot one if it has any
    every = attach_source_table(frame, tables)
    known = tables.filter("active_ind = 1").select("config_id").distinct()
    rows = known.count() + (7 if known.filter("config_id = 7").count() else 0)
    assert set(exchanged_rows(every)) <= {frame.count(), known.count(), rows}


def exchanged_rows(df):
    """The rows that each exchange of the plan was sent."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found = []

    def visit(node):
        name = node.nodeName()
        if "ShuffleQueryStage" in name:
            found.append(node.shuffle().metrics().apply("shuffleRecordsWritten").value())
            visit(node.plan().child() if hasattr(node.plan(), "child") else node.plan())
            return
        children = node.children()
        for k in range(children.size()):
            visit(children.apply(k))

    visit(plan)
    return found


def test_the_texts_of_small_groups_are_not_exchanged(spark, settings):
    settings(spark_sql_execution_arrow_maxRecordsPerBatch="7")  # groups go on from batch to batch
    frame = spark.range(4000).selectExpr(
        "if(id % 100 = 3, null, id % 100) as g", "id % 9 as n", "if(id % 2 = 0, id, null) as v", "repeat('x', 99) as pad"
    )
    text = ordered_text(frame, "g", ("n",), F.concat("pad", F.col("v").cast("string")), ";", "text")
    plan = plan_of(text)
    assert plan.count("Exchange") == 1 and "listagg" not in plan
    items = {}
    for g, n, v, pad in sorted(frame.collect(), key=lambda r: (r.g or 0, r.n, f"{r.v}")):
        items.setdefault(g, []).extend([] if v is None else [f"{pad}{v}"])
    found = {r.g: r.text for r in text.collect()}
    assert found == {g: ";".join(own) if own else None for g, own in items.items()} and None in found


def test_a_hot_group_without_a_name_is_put_together_too(spark):
    frame = spark.range(3000).selectExpr("if(id % 3 = 0, id % 5, null) as g", "id as n")
    found = {r.g: r.text for r in ordered_text(frame, "g", ("n",), F.col("n").cast("string"), ",", "text").collect()}
    assert found[None] == ",".join(str(n) for n in range(3000) if n % 3)
    assert found[2] == ",".join(str(n) for n in range(0, 3000, 3) if n % 5 == 2) and len(found) == 6
