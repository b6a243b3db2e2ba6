from plumbline.functions.columns import type_category
from plumbline.functions.masking import mask_value
from plumbline.functions.predicates import ratio

__all__ = ["mask_value", "ratio", "type_category"]
