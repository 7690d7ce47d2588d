"""Contracts between the stages."""

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()  # noqa: E741


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One page, document or photo with what was found in it.
RECIPE = _struct(recipe_id=L, source_url=S, title=S, servings=I, ingredient_lines=T.ArrayType(S), raw_text=S)

#: One parsed ingredient line. recipe_pos and line_pos carry all first-seen orders.
INGREDIENT = _struct(
    list_id=L, recipe_pos=L, recipe=S, line_pos=L, name=S, quantity=D, unit=S, category=S, notes=S, source_url=S, confidence=D, flags=T.ArrayType(S),
)

#: One line of a consolidated list.
ITEM = _struct(
    list_id=L, item_pos=L, name=S, quantity=D, unit=S, category=S, notes=S, checked=B, sources=T.ArrayType(S), flags=T.ArrayType(S)
)
