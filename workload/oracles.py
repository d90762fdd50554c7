"""The SQL each query is checked against, over the same tables."""

from __future__ import annotations

from .inputs import NAMESPACE

MAPPING = """
mapping as (
  select
    l_orderkey as config_id,
    l_linenumber * 100000000000000000 + (l_partkey % 10000000000) * 10000000
      + l_suppkey % 10000000 as custom_column_mapping_id,
    'db' || l_orderkey % 3 as source_database_name,
    's' as source_schema_name,
    't_' || l_orderkey % 100 || case when l_partkey % 29 = 0 then '_b' else '' end
      as source_table_name,
    'C' || l_partkey % 50 as source_column_name,
    'T' || l_suppkey % 20 as target_column_name,
    (l_quantity > 5)::int as active_ind,
    case when l_partkey % 17 = 0 then null when l_linestatus = 'O' then 1 else 0 end as derived_ind,
    case when l_returnflag = 'N' then null else l_suppkey end as transformation_function_id,
    case l_linenumber % 3 when 0 then 'f(i0,i1,i10)' when 1 then 'g(i2,i1)' else 'trim(i0)' end
      as transformation_function_def,
    case when l_partkey % 13 = 0 then null else 'i2|' || l_partkey end
      as transformation_parameter_text,
    case l_linenumber when 1 then 'BOOLEAN' when 2 then 'date' when 3 then 'DateTime'
      when 4 then 'Bit' when 5 then 'decimal' when 6 then 'string' else 'geo' end
      as transform_func_data_type
  from lineitem
)"""

ACTIVE = (
    MAPPING
    + """,
active as (
  select *,
    derived_ind = 0 or (derived_ind = 1 and transformation_function_id is null) as is_raw,
    derived_ind = 1 and transformation_function_id is not null as is_derived,
    case when lower(transform_func_data_type) in ('numeric', 'bit', 'decimal', 'integer') then 'Numeric'
      when lower(transform_func_data_type) in ('timestamp', 'datetime') then 'Timestamp'
      else upper(transform_func_data_type[1]) || lower(transform_func_data_type[2:]) end as kind
  from mapping where active_ind = 1
)"""
)

CONFIG = """
config as (
  select
    o_orderkey as config_id,
    case when o_orderkey % 11 = 0 then 0 else 1 end as active_ind,
    'db' || o_custkey % 3 as source_database_name,
    lower(o_orderstatus) as source_schema_name,
    't_' || o_custkey as source_table_name
  from orders
),
tables as (
  select config_id,
    min(source_database_name || '.' || source_schema_name || '.' || source_table_name) as source_table,
    count(distinct source_database_name || '.' || source_schema_name || '.' || source_table_name) as n
  from config where active_ind = 1 group by config_id
)"""

_OPEN, _CLOSE = "chr(1)", "chr(2)"


def _bound(parameters: bool) -> str:
    """The definition bound by marking its placeholders, replacing marks, and unmarking the rest."""
    text = (
        "regexp_replace(transformation_function_def, '\\bi(0|[1-9][0-9]*)\\b',"
        f" {_OPEN} || '\\1' || {_CLOSE}, 'g')"
    )
    values = ["source_column_name"]
    if parameters:
        values += [f"string_split(transformation_parameter_text, '|')[{k}]" for k in (1, 2)]
    for k, value in enumerate(values):
        text = f"replace({text}, {_OPEN} || '{k}' || {_CLOSE}, coalesce({value}, 'i{k}'))"
    return f"regexp_replace({text}, {_OPEN} || '([0-9]+)' || {_CLOSE}, 'i\\1', 'g')"


ENTRIES = (
    ACTIVE
    + f""",
usable as (
  select *, {_bound(True)} as expression
  from active
  where transformation_function_id is not null
    and kind in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String')
    and not (transformation_parameter_text is null
      and regexp_matches(transformation_function_def, '\\bi[1-9][0-9]*\\b'))
),
entries as (
  select config_id, kind, target_column_name as key, min(custom_column_mapping_id) as pos,
    arg_max(expression, custom_column_mapping_id) as val
  from usable group by all
),
source_entries as (
  select config_id, kind, source_column_name as key, custom_column_mapping_id as pos, expression as val
  from usable
),
configs as (select distinct config_id from active)"""
)

_KINDS = (
    ("Boolean", "b", "toBoolean(null())"),
    ("Date", "d", "toDate(null())"),
    ("Timestamp", "dt", "toTimestamp(null())"),
    ("Numeric", "n", "toDecimal(null())"),
    ("String", "s", "toString(null())"),
)


def _lists(length: int, sep: str, quote: str = "", entries: str = "entries") -> str:
    """CTE ``lists``: the ten joined lists of every configuration."""
    bare, padded = [], []
    for kind, prefix, null_text in _KINDS:
        for part in ("key", "val"):
            bare.append(
                f"coalesce(list({part} order by pos, key, val) filter (where kind = '{kind}'), [])"
                f" as {prefix}{part}"
            )
        start = f"range(len({prefix}key)::bigint + 1, {length + 1})"
        for part, filler in (("key", f"'_{prefix}' || n"), ("val", f"'{null_text}'")):
            padded.append(
                f"array_to_string([{f"'{quote}' || v || '{quote}'" if quote else 'v'} for v in"
                f" list_concat({prefix}{part}, [{filler} for n in {start}])], '{sep}') as {prefix}{part}s"
            )
    return f"""
bare as (
  select config_id, {", ".join(bare)}
  from configs left join {entries} using (config_id) group by config_id
),
lists as (select config_id, {", ".join(padded)} from bare)"""


MAPPING_TABLES = """
tables as (
  select config_id,
    min(source_database_name || '.' || source_schema_name || '.' || source_table_name) as source_table,
    count(distinct source_database_name || '.' || source_schema_name || '.' || source_table_name) as n
  from active group by config_id
)"""

SOURCE_QUERY = """
names as (
  select config_id, source_column_name as name, bool_or(is_raw) as raw, bool_or(is_derived) as derived
  from active group by all
),
selected as (
  select config_id,
    coalesce(list('`' || name || '`' order by name) filter (where raw), []) as raw_items,
    coalesce(list('cast(null as string) as `' || name || '`' order by name) filter (where derived), [])
      as derived_items
  from names group by config_id
),
source_queries as (
  select config_id,
    case when len(raw_items) + len(derived_items) > 0 and n = 1 then
      'select ' || array_to_string(list_concat(raw_items, derived_items), ', ') || ' from '
      || source_table || ' WHERE AUDIT_ACTIVE_ROW_IND=''Y''' end as source_query
  from selected left join tables using (config_id)
)"""

APPLIED = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate, l_suppkey % 7 = 0 as is_near,
  strftime(l_shipdate::date + 2, '%Y-%m-%d') as ship_day,
  strftime(date_trunc('hour', l_shipdate), '%Y-%m-%d %H:%M') as ship_hour,
  (l_extendedprice::decimal(18, 4) * 2)::decimal(18, 2)::double as net_price,
  trunc(l_quantity)::bigint as whole_quantity,
  l_returnflag || '/' || l_linestatus as flags,
  null::varchar as "NOT_THERE", 'none' as filled
from lineitem where l_linestatus = 'O'"""

_RECORD = ", ".join(f"{prefix}{part}" for _, prefix, _ in _KINDS for part in ("keys", "vals"))


def _packages(key: str, cut: bool = False, name: str = "'pkg_' || package") -> str:
    content = "case when package % 97 = 0 then document[:-6] else document end" if cut else "document"
    whole = "package % 97 <> 0" if cut else "true"
    return f"""
lines as (
  select {key} as package, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    row_number() over (partition by {key} order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as line
  from lineitem
),
whole as (
  select package,
    '<D:Executable xmlns:D="{NAMESPACE}">' || string_agg('<D:Executable n="' || l_linenumber
      || '" p="' || l_partkey || '"><D:Executable s="' || l_suppkey || '"/></D:Executable>', ''
      order by line) || '</D:Executable>' as document
  from lines group by package
),
packages as (
  select {name} as ssis_file_name, {content} as content
  from whole
),
components as (
  select {name} as ssis_file_name, 2 * line - 1 as component_index,
    '<ns0:Executable xmlns:ns0="{NAMESPACE}" n="' || l_linenumber || '" p="' || l_partkey
    || '"><ns0:Executable s="' || l_suppkey || '" /></ns0:Executable>' as ssis_component
  from lines where {whole}
  union all
  select {name}, 2 * line,
    '<ns0:Executable xmlns:ns0="{NAMESPACE}" s="' || l_suppkey || '" />'
  from lines where {whole}
)"""


_FILE = "'pkg_' || package || ' 50%.dtsx'"
_CUT_ERROR = "'unclosed token: line 1, column ' || length(document) - 15"
PROMPTS = """
prompts as (
  select *, 'Digest this:' || ssis_component as prompt,
    row_number() over (order by ssis_file_name, component_index) as id
  from components
)"""


LOG_ROWS = """
log_rows as (
  select 'local' as api_provider, 'digest' as model_name, 'documents' as ssis_file_path,
    source as ssis_file_name, 'You digest.' as system_prompt, 'Digest this' as prompt_prefix,
    text as ssis_component, length(text) || ':' || md5(text) as llm_response, doc_id
  from documents
),
log as (
  select row_number() over (order by doc_id % 2, ssis_file_name, doc_id) as id, * exclude (doc_id),
    doc_id % 2 as batch
  from log_rows
)"""

_DIGEST = "length(prompt) || ':' || md5(prompt)"


def _select(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body}"


def _keys(condition: str) -> str:
    return _select(
        ACTIVE,
        f"select config_id, custom_column_mapping_id, source_column_name from active where {condition}",
    )


_MAPPING_COLUMNS = (
    "config_id, custom_column_mapping_id, source_database_name, source_schema_name, source_table_name,"
    " source_column_name, target_column_name, active_ind, derived_ind, transformation_function_id,"
    " transformation_function_def, transformation_parameter_text, transform_func_data_type"
)

_DEFINITIONS = """
select config_id, custom_column_mapping_id, source_column_name, target_column_name,
  transformation_function_def as f_definition, transformation_parameter_text as f_parameter_text,
  kind as transform_data_type
from active where transformation_function_id is not null"""

ORACLES = {
    "scan_mapping": _select(MAPPING, f"select {_MAPPING_COLUMNS} from mapping"),
    "scan_source_config": _select(
        CONFIG,
        "select config_id, source_database_name, source_schema_name, source_table_name"
        " from config where active_ind = 1",
    ),
    "read_mapping_csv": _select(
        ACTIVE.replace("where active_ind = 1", ""),
        "select config_id::int as config_id, source_column_name,"
        " transformation_function_def as f_definition,"
        " coalesce(transformation_parameter_text, '') as f_parameter_text, kind as transform_data_type"
        " from active where transformation_function_id is not null",
    ),
    "read_packages": _select(
        _packages("l_suppkey", True, _FILE),
        "select 'root/batch 1+' as ssis_file_path, ssis_file_name, content from packages",
    ),
    "append_conversion_log": _select(LOG_ROWS, "select * exclude (batch) from log"),
    "log_violations": """
select 'model_name' as violated_column, count(*) as n_rows from documents where doc_id % 7 = 0
union all
select 'ssis_file_name', count(*) from documents where doc_id % 5 = 0""",
    "allocate_ids": _select(
        _packages("l_orderkey"),
        "select ssis_file_name, component_index,"
        " 1000 + row_number() over (order by ssis_file_name, component_index) as id from components",
    ),
    "log_since": _select(LOG_ROWS, "select * exclude (batch) from log where batch = 1"),
    "log_for_package": _select(
        LOG_ROWS, "select id, ssis_file_name, llm_response from log where ssis_file_name = 'src0'"
    ),
    "active_mapping": _select(ACTIVE, f"select {_MAPPING_COLUMNS} from active"),
    "raw_column_rows": _keys("is_raw"),
    "derived_column_rows": _keys("is_derived"),
    "transformed_rows": _keys("transformation_function_id is not null"),
    "active_source_rows": "select l_orderkey, l_linenumber, l_partkey, 'Y' as AUDIT_ACTIVE_ROW_IND"
    " from lineitem where l_linestatus = 'O'",
    "normalize_type": _select(
        ACTIVE.replace("where active_ind = 1", ""),
        "select config_id, custom_column_mapping_id, kind as transform_data_type from active",
    ),
    "null_cast_items": _select(
        ACTIVE,
        "select config_id, custom_column_mapping_id,"
        " 'cast(null as string) as `' || source_column_name || '`' as item from active where is_derived",
    ),
    "qualified_table_name": _select(
        CONFIG,
        "select config_id, source_database_name || '.' || source_schema_name || '.' || source_table_name"
        " as source_table from config",
    ),
    "quote_identifiers": """
select l_orderkey, l_linenumber, l_partkey,
  '`P#' || l_partkey || case when l_partkey % 3 = 0 then '``' else '$' end || '`' as backtick,
  '[P#' || l_partkey || case when l_partkey % 3 = 0 then '`' else '$' end || ']' as bracket
from lineitem""",
    "bind_source_column": _select(
        ACTIVE,
        f"select config_id, custom_column_mapping_id, {_bound(False)} as f_definition"
        " from active where transformation_function_id is not null",
    ),
    "bind_parameters": _select(
        ACTIVE,
        f"select config_id, custom_column_mapping_id, {_bound(True)} as f_definition"
        " from active where transformation_function_id is not null",
    ),
    "quoted_arrays": _select(ENTRIES + "," + _lists(3, ",", '"'), f"select config_id, {_RECORD} from lists"),
    "typed_nulls": _select(
        ACTIVE,
        "select config_id, custom_column_mapping_id, case kind "
        + " ".join(f"when '{kind}' then '{text}'" for kind, _, text in _KINDS)
        + " end as null_text, "
        + ", ".join(f"null::varchar as null_{prefix}" for _, prefix, _ in _KINDS)
        + ", 'boolean' as type_b, 'date' as type_d, 'timestamp' as type_dt, 'decimal(38,18)' as type_n,"
        " 'string' as type_s"
        + " from active",
    ),
    "render_prompts": "select doc_id, 'Digest this:' || text as prompt, 'You digest.' as system_prompt"
    " from documents",
    "conversion_rows": _select(LOG_ROWS, "select * from log_rows"),
    "function_definitions": _select(ACTIVE, _DEFINITIONS),
    "distinct_columns": _select(
        ACTIVE,
        "select config_id,"
        " coalesce(string_agg(distinct source_column_name, ',' order by source_column_name)"
        " filter (where is_raw), '') as raw_columns,"
        " coalesce(string_agg(distinct source_column_name, ',' order by source_column_name)"
        " filter (where is_derived), '') as derived_columns"
        " from active where is_raw or is_derived group by config_id",
    ),
    "ordered_column_list": _select(
        ACTIVE,
        "select config_id, string_agg('[' || source_column_name || ']', ', '"
        " order by custom_column_mapping_id, source_column_name) as column_list"
        " from active where is_raw group by config_id",
    ),
    "joined_column_list": _select(
        ACTIVE,
        "select config_id, string_agg(source_column_name, ','"
        " order by custom_column_mapping_id, source_column_name) as column_list"
        " from active where is_derived group by config_id",
    ),
    "typed_buckets": _select(ENTRIES + "," + _lists(0, ";"), f"select config_id, {_RECORD} from lists"),
    "padded_arrays": _select(ENTRIES + "," + _lists(3, ";"), f"select config_id, {_RECORD} from lists"),
    "last_mapping_wins": _select(
        ENTRIES,
        "select config_id, kind as transform_data_type, key as target_column_name, pos,"
        " val as expression from entries",
    ),
    "joined_arrays": _select(
        ENTRIES + "," + _lists(5, ",", entries="source_entries"), f"select config_id, {_RECORD} from lists"
    ),
    "high_water_mark": "select count(*) as max_id from documents",
    "mapping_counts": _select(
        ACTIVE,
        "select config_id, count(*) as n_rows, count(*) filter (where is_raw) as n_raw,"
        " count(*) filter (where is_derived) as n_derived, count(transformation_function_id)"
        " as n_transformed from active group by config_id",
    ),
    "single_source_table": _select(
        ACTIVE,
        "select config_id, count(distinct name) as n_tables,"
        " case when count(distinct name) = 1 then min(name) end as source_table from"
        " (select config_id, source_database_name || '.' || source_schema_name || '.' ||"
        " source_table_name as name from active) group by config_id",
    ),
    "attach_source_table": _select(
        ACTIVE + "," + CONFIG,
        "select config_id, custom_column_mapping_id, case when n = 1 then source_table end as source_table,"
        " case when n is null then 'no_config' when n > 1 then 'many_source_tables' end as table_reject"
        " from active left join tables using (config_id)",
    ),
    "source_columns": _select(
        ACTIVE
        + """,
names as (
  select config_id, source_column_name as name,
    min(custom_column_mapping_id) filter (where is_raw) as raw,
    min(custom_column_mapping_id) filter (where is_derived) as derived
  from active group by all
)""",
        "select config_id, array_to_string(list_concat("
        "coalesce(list(name order by raw) filter (where raw is not null), []),"
        " coalesce(list('cast(null as string) as ' || name order by derived)"
        " filter (where derived is not null), [])), ', ') as source_columns from names group by config_id",
    ),
    "explode_components": _select(_packages("l_orderkey"), "select * from components"),
    "explode_encoded_packages": _select(
        _packages("l_suppkey", False, _FILE),
        "select ssis_file_name, component_index, ssis_component from components",
    ),
    "component_rejects": _select(
        _packages("l_orderkey"),
        f"select 'pkg_' || package as ssis_file_name, {_CUT_ERROR} as error from whole where package % 97 = 0",
    ),
    "enrich_rows": "select conv_id, turn,"
    f" case when length(prompt) % 10 <> 7 then {_DIGEST} end as response,"
    " case when length(prompt) % 10 = 7 then 'ValueError: length ends in 7' end as error"
    " from (select conv_id, turn, 'Digest this:' || text as prompt from conversations)",
    "compile_source_query": _select(
        ACTIVE + "," + CONFIG + "," + SOURCE_QUERY, "select config_id, source_query from source_queries"
    ),
    "compile_mapping_arrays": _select(
        ENTRIES + "," + CONFIG + "," + SOURCE_QUERY + "," + _lists(8, ";"),
        f"select config_id, source_query, {_RECORD} from lists join source_queries using (config_id)",
    ),
    "mapping_rejects": _select(
        ACTIVE + "," + CONFIG,
        """
select config_id, custom_column_mapping_id, target_column_name,
  case when kind not in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String') then 'unknown_type'
    else 'null_parameters' end as reason
from active
where transformation_function_id is not null
  and (kind not in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String')
    or (transformation_parameter_text is null
      and regexp_matches(transformation_function_def, '\\bi[1-9][0-9]*\\b')))
union all
select config_id, null, null,
  case when n is null then 'no_config' else 'many_source_tables' end
from (select distinct config_id from active) left join tables using (config_id)
where n is null or n > 1""",
    ),
    "apply_mapping": APPLIED,
    "apply_mappings": f"""
select 1::bigint as config_id, *, null::bigint as line from ({APPLIED})
union all by name
select 2::bigint as config_id, l_orderkey, l_quantity, 'hidden' as filled, l_linestatus as flags,
  trunc(l_quantity)::bigint * 10 as whole_quantity, null::varchar as l_comment
from lineitem where l_linestatus = 'O'
union all by name
select 3::bigint as config_id, l_orderkey, l_linenumber, l_linenumber::bigint + 100 as line, '#' || l_linenumber as flags
from lineitem where l_linestatus = 'O'""",
    "convert_packages": _select(
        _packages("l_suppkey", False, _FILE) + "," + PROMPTS,
        "select id, 'local' as api_provider, 'digest' as model_name, ssis_file_name,"
        " 'You digest.' as system_prompt, 'Digest this' as prompt_prefix, ssis_component,"
        f" case when length(prompt) % 10 <> 7 then {_DIGEST} end as llm_response from prompts",
    ),
    "convert_without_log": _select(
        _packages("l_suppkey", False, _FILE) + "," + PROMPTS,
        "select 'local' as api_provider, 'digest' as model_name, ssis_file_name,"
        " 'You digest.' as system_prompt, 'Digest this' as prompt_prefix, ssis_component,"
        f" case when length(prompt) % 10 <> 7 then {_DIGEST} end as llm_response from prompts",
    ),
    "convert_failures": _select(
        _packages("l_suppkey", False, _FILE) + "," + PROMPTS,
        "select ssis_file_name, component_index, 'ValueError: length ends in 7' as error"
        " from prompts where length(prompt) % 10 = 7",
    ),
    "convert_rejects": _select(
        _packages("l_suppkey", True, _FILE),
        f"select {_FILE} as ssis_file_name, {_CUT_ERROR} as error from whole where package % 97 = 0",
    ),
    "retry_conversion_log": _select(
        LOG_ROWS
        + """,
placed as (
  select *, row_number() over (partition by batch order by ssis_file_name, doc_id) as n from (
    select *, doc_id % 2 as batch from log_rows)
),
first_ids as (select max(n) // 3 * 3 as last, count(*) filter (where batch = 1) as odd from placed where batch = 0),
odd_count as (select count(*) as odd from placed where batch = 1),
numbered as (
  select case
      when batch = 0 and n % 3 = 0 then n
      when batch = 1 then last + n
      else last + odd_count.odd + n - n // 3
    end as id, placed.* exclude (n, batch, doc_id)
  from placed, first_ids, odd_count
)""",
        "select * from numbered",
    ),
    "compile_from_mapping": _select(
        ENTRIES + "," + MAPPING_TABLES + "," + SOURCE_QUERY + "," + _lists(8, ";"),
        f"select config_id, source_query, {_RECORD} from lists join source_queries using (config_id)",
    ),
    "mapping_rejects_from_mapping": _select(
        ACTIVE + "," + MAPPING_TABLES,
        """
select config_id, custom_column_mapping_id, target_column_name,
  case when kind not in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String') then 'unknown_type'
    else 'null_parameters' end as reason
from active
where transformation_function_id is not null
  and (kind not in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String')
    or (transformation_parameter_text is null
      and regexp_matches(transformation_function_def, '\\bi[1-9][0-9]*\\b')))
union all
select config_id, null, null, 'many_source_tables' from tables where n > 1""",
    ),
    "mapping_rejects_of_faults": _select(
        ACTIVE
        + """,
faulty as (
  select * replace (
    case when custom_column_mapping_id % 19 <> 0 then source_column_name end as source_column_name,
    case when custom_column_mapping_id % 23 <> 0 then target_column_name end as target_column_name,
    case when custom_column_mapping_id % 7 <> 0 then transformation_function_def end
      as transformation_function_def,
    case when config_id % 41 <> 0 then source_schema_name end as source_schema_name)
  from active
),
reasons as (
  select *, case
      when source_column_name is null then 'null_source_column'
      when transformation_function_id is null then null
      when target_column_name is null then 'null_target_column'
      when kind not in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String') then 'unknown_type'
      when transformation_function_def is null then 'null_definition'
      when transformation_parameter_text is null
        and regexp_matches(transformation_function_def, '\\bi[1-9][0-9]*\\b') then 'null_parameters'
    end as reason
  from faulty
)""",
        """
select config_id, custom_column_mapping_id, target_column_name, reason from reasons where reason is not null
union all
select config_id, null, null, case when bool_or(source_schema_name is null) then 'null_table_name'
  else 'many_source_tables' end
from faulty group by config_id
having bool_or(source_schema_name is null) or count(distinct source_table_name) > 1""",
    ),
    # the file holds empty text for NULL parameters, so no row is left out for them
    "compile_from_csv": _select(
        ACTIVE.replace("from mapping where active_ind = 1", "from (select * replace ("
        "coalesce(transformation_parameter_text, '') as transformation_parameter_text) from mapping)"
        " where transformation_function_id is not null")
        + f""",
in_file as (select *, row_number() over (order by custom_column_mapping_id desc, config_id) as place from active),
source_entries as (
  select config_id, kind, source_column_name as key, place as pos, {_bound(True)} as val
  from in_file where kind in ('Boolean', 'Date', 'Timestamp', 'Numeric', 'String')
),
configs as (select distinct config_id from active)"""
        + ","
        + _lists(8, ";", entries="source_entries"),
        f"select config_id, null::varchar as source_query, {_RECORD} from lists",
    ),
}
