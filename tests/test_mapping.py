"""Hand-made mapping rows, one per decision, and invariants over all configurations."""

from itertools import count

import pytest
from pyspark.sql import functions as F, types as T

from colweave import (
    apply_mapping,
    compile_mapping_arrays,
    compile_source_query,
    mapping_of_csv,
    mapping_rejects,
    read_mapping_csv,
)
from colweave.functions.text import quote_identifier
from colweave.operators.columns import ordered_text, single_source_table
from colweave.operators.items import entry_items, last_item_wins
from colweave.operators.rows import active_mapping, is_transformed
from colweave.schemas import MAPPING, SOURCE_CONFIG, conform
from workload import inputs

TYPES = {"b": "Boolean", "d": "Date", "dt": "Timestamp", "n": "Numeric", "s": "String"}


def mapping(spark, *rows):
    """Rows of ``config 1`` from keyword dicts; ids count up."""
    ids = count(1)
    defaults = {
        "config_id": 1,
        "source_database_name": "db",
        "source_schema_name": "s",
        "source_table_name": "t",
        "source_column_name": "A",
        "target_column_name": "T",
        "active_ind": 1,
        "derived_ind": 0,
        "transformation_function_id": 1,
        "transformation_function_def": "f(i0)",
        "transformation_parameter_text": "",
        "transform_func_data_type": "String",
    }
    full = [{**defaults, "custom_column_mapping_id": next(ids), **row} for row in rows]
    nullable = T.StructType([T.StructField(field.name, field.dataType) for field in MAPPING.fields])
    return spark.createDataFrame([tuple(row[name] for name in MAPPING.names) for row in full], nullable)


def config(spark, *rows):
    return spark.createDataFrame(rows or [(1, 1, "db", "s", "t")], SOURCE_CONFIG)


def compiled(spark, *rows, length=3, **options):
    result = compile_mapping_arrays(mapping(spark, *rows), config(spark), return_length=length, **options)
    return result.first()


def test_raw_then_derived_columns_sorted_and_distinct(spark):
    record = compiled(
        spark,
        {"source_column_name": "B", "derived_ind": 0},
        {"source_column_name": "A", "derived_ind": 1, "transformation_function_id": None},
        {"source_column_name": "B", "derived_ind": 0},
        {"source_column_name": "D", "derived_ind": 1},
        {"source_column_name": "C", "derived_ind": 1},
        {"source_column_name": "N", "derived_ind": None},
    )
    assert record.source_query == (
        "select `A`, `B`, cast(null as string) as `C`, cast(null as string) as `D`"
        " from db.s.t WHERE AUDIT_ACTIVE_ROW_IND='Y'"
    )


def test_order_by_mapping_and_styles(spark):
    rows = [{"source_column_name": name} for name in ("B", "A", "B")]
    frame, tables = mapping(spark, *rows), config(spark)
    query = lambda **options: compile_source_query(frame, tables, **options).first().source_query
    assert query(order="mapping", style="bracket").startswith("select [B], [A] from")
    assert query(style="none").startswith("select A, B from")
    with pytest.raises(ValueError):
        query(order="size")
    with pytest.raises(ValueError):
        query(style="loud")


def test_null_derived_ind_is_in_no_column_list(spark):
    without = compiled(spark, {"derived_ind": None, "transformation_function_id": None})
    assert without.source_query is None and without.skeys == "_s1;_s2;_s3"
    with_function = compiled(spark, {"derived_ind": None})
    assert with_function.source_query is None and with_function.skeys == "T;_s2;_s3"


def test_last_mapping_wins_at_the_first_position(spark):
    record = compiled(
        spark,
        {"target_column_name": "X", "transformation_function_def": "first"},
        {"target_column_name": "Y", "transformation_function_def": "other"},
        {"target_column_name": "X", "transformation_function_def": "last"},
    )
    assert (record.skeys, record.svals) == ("X;Y;_s3", "last;other;toString(null())")


def test_a_rejected_row_never_wins(spark):
    record = compiled(
        spark,
        {"transformation_function_def": "good"},
        {"transformation_function_def": "bad(i1)", "transformation_parameter_text": None},
    )
    assert record.svals.startswith("good;")


def test_key_source_keeps_every_entry(spark):
    rows = [{"transformation_function_def": text} for text in ("a", "b", "a")]
    record = compiled(spark, *rows, key="source")
    assert (record.skeys, record.svals) == ("A;A;A", "a;b;a")


@pytest.mark.parametrize(
    "given, prefix",
    [("DATETIME", "dt"), ("timestamp", "dt"), ("numeric", "n"), ("bit", "n"), ("Decimal", "n"),
     ("INTEGER", "n"), ("boolean", "b"), ("date", "d"), ("sTRING", "s")],
)
def test_types_without_regard_to_case(spark, given, prefix):
    record = compiled(spark, {"transform_func_data_type": given})
    assert record[f"{prefix}keys"] == f"T;_{prefix}2;_{prefix}3"


def test_padding_counts_on_and_never_cuts(spark):
    four = [{"target_column_name": f"T{n}", "transform_func_data_type": "Boolean"} for n in range(4)]
    record = compiled(spark, *four)
    assert record.bkeys == "T0;T1;T2;T3" and record.bvals.count(";") == 3
    assert record.dtvals == ";".join(["toTimestamp(null())"] * 3)
    empty = compiled(spark, *four, length=0)
    assert empty.bkeys == "T0;T1;T2;T3" and empty.dkeys == ""


def test_default_length_separator_and_quotes(spark):
    record = compile_mapping_arrays(mapping(spark, {}), config(spark), sep=",", quote=True).first()
    assert record.skeys == '"T",' + ",".join(f'"_s{n}"' for n in range(2, 9))
    assert record.svals.startswith('"f(A)","toString(null())"')


def test_one_configuration(spark):
    frame = mapping(spark, {}, {"config_id": 2}, {"config_id": 3, "active_ind": 0})
    tables = config(spark, (1, 1, "a", "b", "c"), (2, 1, "a", "b", "d"))
    assert [row.config_id for row in compile_mapping_arrays(frame, tables, config_id=2).collect()] == [2]
    assert compile_mapping_arrays(frame, tables, config_id=3).count() == 0


def test_no_single_table_means_no_query(spark):
    frame = mapping(spark, *({"config_id": n} for n in (1, 2, 3, 4)))
    tables = config(
        spark,
        (1, 1, "a", "b", "c"), (1, 1, "a", "b", "c"), (1, 0, "a", "b", "old"),
        (2, 1, "a", "b", "c"), (2, 1, "a", "b", "d"),
        (3, 0, "a", "b", "c"),
        (4, 1, "a", None, "c"),
    )
    queries = {row.config_id: row.source_query for row in compile_source_query(frame, tables).collect()}
    assert queries.pop(1) == "select `A` from a.b.c WHERE AUDIT_ACTIVE_ROW_IND='Y'"
    assert queries == {2: None, 3: None, 4: None}
    rejects = mapping_rejects(frame, tables).collect()
    reasons = {(r.config_id, r.custom_column_mapping_id): r.reason for r in rejects}
    assert reasons == {(2, None): "many_source_tables", (3, None): "no_config", (4, None): "null_table_name"}


def test_the_mapping_can_name_the_table(spark):
    frame = mapping(spark, {}, {}, {"config_id": 2}, {"config_id": 2, "source_table_name": "u"})
    queries = {row.config_id: row.source_query for row in compile_source_query(frame).collect()}
    assert queries == {1: "select `A` from db.s.t WHERE AUDIT_ACTIVE_ROW_IND='Y'", 2: None}
    assert compile_mapping_arrays(frame, config_id=1).first().source_query == queries[1]
    assert [(r.config_id, r.reason) for r in mapping_rejects(frame).collect()] == [(2, "many_source_tables")]


def test_row_rejects(spark):
    frame = mapping(
        spark,
        {"transform_func_data_type": "geo"},
        {"transform_func_data_type": None},
        {"transformation_function_def": None},
        {"transformation_function_def": "f(i1)", "transformation_parameter_text": None},
        {"transformation_function_def": "f(i0)", "transformation_parameter_text": None},
        {"transformation_function_id": None, "transform_func_data_type": "geo"},
        {"active_ind": 0, "transform_func_data_type": "geo"},
    )
    reasons = {r.custom_column_mapping_id: r.reason for r in mapping_rejects(frame, config(spark)).collect()}
    assert reasons == {1: "unknown_type", 2: "unknown_type", 3: "null_definition", 4: "null_parameters"}


def test_single_source_table_reports_several(spark):
    frame = mapping(spark, {}, {"source_table_name": "u"}, {"config_id": 2}, {"config_id": 2})
    found = {r.config_id: (r.n_tables, r.source_table) for r in single_source_table(frame).collect()}
    assert found == {1: (2, None), 2: (1, "db.s.t")}


def test_ordered_text(spark):
    frame = spark.range(5000).selectExpr("id % 3 as g", "5000 - id as n", "cast(id as string) as item")
    text = {r.g: r.text for r in ordered_text(frame, "g", ("n",), F.col("item"), "';", "text").collect()}
    assert text[0] == "';".join(str(n) for n in range(4998, -1, -3)) and len(text) == 3


def test_null_names_are_rejected_and_left_out(spark):
    frame = mapping(
        spark,
        {"source_column_name": "B"},
        {"source_column_name": None},
        {"target_column_name": None, "source_column_name": "C"},
        {"config_id": 2, "source_column_name": None},
        {"config_id": 3, "source_schema_name": None},
    )
    records = {r.config_id: r for r in compile_mapping_arrays(frame, return_length=0).collect()}
    assert records[1].source_query == "select `B`, `C` from db.s.t WHERE AUDIT_ACTIVE_ROW_IND='Y'"
    assert records[2].source_query is None and records[3].source_query is None
    assert "" not in records[1].skeys.split(";")
    found = sorted((r.config_id, r.reason) for r in mapping_rejects(frame).collect())
    assert found == [
        (1, "null_source_column"), (1, "null_target_column"), (2, "null_source_column"), (3, "null_table_name")
    ]


def test_apply_is_what_the_compiled_texts_say(spark):
    source = spark.createDataFrame([("x", 5, "Y"), ("y", 6, "N")], ["A", "D", "AUDIT_ACTIVE_ROW_IND"])
    frame = mapping(
        spark,
        {"source_column_name": "A", "target_column_name": "up", "transformation_function_def": "upper(i0)"},
        # the source has this derived column; the compiled query makes it a null string all the same
        {"source_column_name": "D", "derived_ind": 1, "target_column_name": "filled",
         "transformation_function_def": "coalesce(i0, 'none')"},
    )
    record = compile_mapping_arrays(frame, return_length=0).first()
    source.createOrReplaceTempView("t_of_texts")
    selected = spark.sql(record.source_query.replace("db.s.t", "t_of_texts"))
    pairs = zip(record.skeys.split(";"), record.svals.split(";"))
    by_text = selected.select("*", *[F.expr(value).alias(key) for key, value in pairs])
    applied = apply_mapping(frame, source, 1)
    assert by_text.select(*applied.columns).collect() == applied.collect()
    assert applied.columns == ["A", "D", "up", "filled"] and applied.first().filled == "none"


def test_apply_refuses_a_name_that_padding_takes(spark):
    source = spark.createDataFrame([("x", "Y")], ["A", "AUDIT_ACTIVE_ROW_IND"])
    frame = mapping(spark, {"target_column_name": "_s2", "transformation_function_def": "upper(i0)"})
    assert apply_mapping(frame, source, 1).first()["_s2"] is not None
    with pytest.raises(ValueError, match="padding"):
        apply_mapping(frame, source, 1, return_length=2)


def test_compile_from_the_csv_form(spark, tmp_path):
    head = "config_id,source_column_name,f_definition,f_parameter_text,transform_data_type\n"
    (tmp_path / "m.csv").write_text(head + "1,A,\"f(i0,i1)\",p,String\n1,B,g(i0),,Date\n")
    rows = mapping_of_csv(read_mapping_csv(spark, f"{tmp_path}/m.csv"))
    record = compile_mapping_arrays(rows, return_length=0, key="source").first()
    assert (record.skeys, record.svals, record.dkeys, record.dvals) == ("A", "f(A,p)", "B", "g(B)")
    assert record.source_query is None


def test_lists_are_whole_and_keys_match_values(spark, sf_dir):
    length = 3
    frame, tables = inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir)
    records = compile_mapping_arrays(frame, tables, return_length=length)
    expected = (
        last_item_wins(entry_items(active_mapping(frame))).groupBy("config_id", "slot").count().collect()
    )
    sizes = {(row.config_id, row.slot): row["count"] for row in expected}
    for record in records.collect():
        for prefix, kind in TYPES.items():
            keys, values = record[f"{prefix}keys"].split(";"), record[f"{prefix}vals"].split(";")
            n = sizes.get((record.config_id, kind), 0)
            assert len(keys) == len(values) == max(n, length)
            assert keys[n:] == [f"_{prefix}{i}" for i in range(n + 1, length + 1)]
            assert not any("i0" in value for value in values)


def test_rejects_superseded_and_entries_add_up(spark, sf_dir):
    frame, tables = inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir)
    active = active_mapping(frame)
    usable = entry_items(active)
    entries, superseded = last_item_wins(usable).count(), usable.count() - last_item_wins(usable).count()
    rejects = mapping_rejects(frame, tables).filter("custom_column_mapping_id is not null").count()
    assert rejects + superseded + entries == active.filter(is_transformed()).count()
    assert superseded > 0 and rejects > 0


def test_conform(spark):
    narrow = spark.createDataFrame([(1, 1, "a", "b", "c", "extra")], "config_id int, active_ind int, "
                                   "source_database_name string, source_schema_name string, "
                                   "source_table_name string, extra string")
    assert [f.dataType for f in conform(narrow, SOURCE_CONFIG, "c").schema] == [
        f.dataType for f in SOURCE_CONFIG
    ]
    with pytest.raises(ValueError, match="source_table_name"):
        conform(narrow.drop("source_table_name"), SOURCE_CONFIG, "c")
    with pytest.raises(TypeError, match="active_ind"):
        conform(narrow.withColumn("active_ind", F.lit("1")), SOURCE_CONFIG, "c")


def test_quoted_identifiers_run(spark):
    names = ["BR#", "GROUP", "a`b", "NGAMORG$"]
    frame = spark.createDataFrame([(1, 2, 3, 4)], names)
    frame.createOrReplaceTempView("odd_names")
    quoted = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string")
              .select(quote_identifier(F.col("n"))).collect()]
    assert tuple(spark.sql(f"select {', '.join(quoted)} from odd_names").first()) == (1, 2, 3, 4)


def test_apply_mapping(spark):
    source = spark.createDataFrame(
        [("x", "12", "Y"), ("y", "no number", "Y"), ("z", "1", "N")], ["BR#", "n", "AUDIT_ACTIVE_ROW_IND"]
    )
    rows = [
        {"source_column_name": "BR#", "target_column_name": "BR", "transformation_function_def": "upper(i0)"},
        {"source_column_name": "n", "target_column_name": "n", "transformation_function_def": "i0",
         "transform_func_data_type": "Numeric"},
        {"source_column_name": "gone", "derived_ind": 1, "target_column_name": "G",
         "transformation_function_def": "coalesce(i0, 'i1')", "transformation_parameter_text": "none"},
    ]
    applied = apply_mapping(mapping(spark, *rows), source, 1, strict=False, return_length=2)
    assert applied.columns == ["BR#", "gone", "_b1", "_b2", "_d1", "_d2", "_dt1", "_dt2", "n", "_n2", "BR", "G"]
    found = sorted((r["BR#"], r.BR, r.n, r.G, r._b1) for r in applied.collect())
    assert [(a, b, None if n is None else int(n), g, p) for a, b, n, g, p in found] == [
        ("x", "X", 12, "none", None), ("y", "Y", None, "none", None)
    ]
    assert dict(applied.dtypes)["n"] == "decimal(38,18)"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply_mapping(mapping(spark, *rows), source, 1).collect()


def test_apply_refuses_a_target_of_two_types(spark):
    source = spark.createDataFrame([("x", "Y")], ["A", "AUDIT_ACTIVE_ROW_IND"])
    frame = mapping(spark, {}, {"transform_func_data_type": "Boolean"})
    with pytest.raises(ValueError, match="more than one type"):
        apply_mapping(frame, source, 1)


def test_csv_rows_are_in_the_order_of_the_file(spark, tmp_path):
    """Two files, cut into many stretches; a compile gives their entries in the order of the lines."""
    head = "config_id,source_column_name,f_definition,f_parameter_text,transform_data_type\n"
    lines = [f"{n % 3},C{(n * 7919) % 997},f{n}(i0),,String" for n in range(3_000)]
    (tmp_path / "b.csv").write_text(head + "\n".join(lines[2_000:]) + "\n")
    (tmp_path / "a.csv").write_text(head + "\n".join(lines[:2_000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = read_mapping_csv(spark, str(tmp_path), position="place")
        read = spark.read.csv(str(tmp_path), header=True).rdd.getNumPartitions()
        found = {r.place: r.f_definition for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read > 8 and found == {n + 1: f"f{n}(i0)" for n in range(3_000)}
    records = compile_mapping_arrays(mapping_of_csv(rows, position="place"), key="source", return_length=0)
    for record in records.collect():
        own = [n for n in range(3_000) if n % 3 == record.config_id]
        assert record.skeys.split(";") == [f"C{(n * 7919) % 997}" for n in own]
        assert record.svals.split(";") == [f"f{n}(C{(n * 7919) % 997})" for n in own]
