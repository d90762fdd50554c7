"""Binding of the placeholders ``i0``, ``i1``, ... of a transformation definition.

A placeholder is a whole word, so ``i1`` is not found inside ``i10`` or ``bi1``. The definition is
cut once at its placeholders and the pieces are put together again, so all placeholders are bound
at the same time and nothing that was put in is looked at a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters and digits of any script, spelled out: what \b makes of them depends on the Java version.
_WORD = r"[\p{L}\p{N}_]"
PLACEHOLDER = rf"(?<!{_WORD})i(?:0|[1-9][0-9]*)(?!{_WORD})"
PARAMETER_PLACEHOLDER = rf"(?<!{_WORD})i[1-9][0-9]*(?!{_WORD})"
PARAMETER_SEPARATOR = r"\|"


def has_parameters(definition: Column) -> Column:
    """Whether a placeholder above ``i0`` occurs."""
    return definition.rlike(PARAMETER_PLACEHOLDER)


def bind_source_column(definition: Column, source_column: Column) -> Column:
    """Bind ``i0`` alone; the other placeholders stay."""
    return _rebuild(definition, lambda token: F.when(token == "i0", source_column))


def bind_parameters(definition: Column, source_column: Column, parameters: Column) -> Column:
    """Bind ``i0`` to the source column and ``i<k>`` to the k-th of the ``|``-separated parameters.

    A placeholder without a parameter stays as it is. Empty text is one empty parameter; NULL text
    is no parameter.
    """
    values = F.split(parameters, PARAMETER_SEPARATOR)

    def replacement(token: Column) -> Column:
        # an ordinal beyond the numbers has no parameter, like any other without one
        ordinal = F.substr(token, F.lit(2)).try_cast("int")
        return F.when(token == "i0", source_column).otherwise(F.get(values, ordinal - 1))

    return _rebuild(definition, replacement)


def _rebuild(definition: Column, replacement) -> Column:
    literals = F.split(definition, PLACEHOLDER)
    tokens = F.regexp_extract_all(definition, F.lit(PLACEHOLDER), 0)
    bound = F.transform(tokens, lambda token: F.coalesce(replacement(token), token))
    # one literal more than there are placeholders: the last one is followed by nothing
    followers = F.concat(bound, F.array(F.lit("")))
    return F.array_join(F.zip_with(literals, followers, lambda a, b: F.concat(a, b)), "")
