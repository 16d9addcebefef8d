from verbaloom.functions.layers import LAYER_ORDER, layer_list, normalise_layers
from verbaloom.functions.text import (
    clean_field,
    half_even_2,
    pad_left,
    sheet_name,
    slug,
    time_stamp,
    value_or,
)

__all__ = [
    "LAYER_ORDER", "clean_field", "half_even_2", "layer_list", "normalise_layers",
    "pad_left", "sheet_name", "slug", "time_stamp", "value_or",
]
