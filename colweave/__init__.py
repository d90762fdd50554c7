"""Metadata-driven column mapping and component conversion logs as Spark jobs."""

from .operators.components import component_rejects, explode_components
from .operators.enrich import enrich_rows, render_prompts
from .operators.ids import allocate_ids
from .plans.apply import apply_mapping, apply_mappings
from .plans.compile import compile_mapping_arrays, compile_source_query, mapping_rejects
from .plans.convert import Conversion, convert_packages
from .sources.log import ConversionLog
from .sources.mapping import mapping_of_csv, read_mapping, read_mapping_csv, read_source_config
from .sources.packages import read_package_bytes, read_packages
from .sources.staging import release_staged

__all__ = [
    "Conversion",
    "ConversionLog",
    "allocate_ids",
    "apply_mapping",
    "apply_mappings",
    "compile_mapping_arrays",
    "compile_source_query",
    "component_rejects",
    "convert_packages",
    "enrich_rows",
    "explode_components",
    "mapping_of_csv",
    "mapping_rejects",
    "read_mapping",
    "read_mapping_csv",
    "read_package_bytes",
    "read_packages",
    "read_source_config",
    "release_staged",
    "render_prompts",
]
