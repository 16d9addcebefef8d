"""The annotation layers and how a comma-separated choice of them is put in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layer names, in the order in which they depend on each other.
LAYER_ORDER = ["tokenize", "mwt", "pos", "lemma", "depparse", "ner"]


def normalise_layers(layers: str) -> tuple[str, list[str]]:
    """Trim, drop empty and repeated names, order them; also return the warnings."""
    names = list(dict.fromkeys(name.strip() for name in layers.split(",") if name.strip()))
    unknown = [name for name in names if name not in LAYER_ORDER]
    known = [name for name in LAYER_ORDER if name in names]
    warnings = [f"unknown layers: {', '.join(unknown)}"] if unknown else []
    return ",".join(known + unknown), warnings


def layer_list(column: Column) -> Column:
    """The same ordering for a column of layer lists; yields an array of names."""
    trimmed = F.transform(F.split(column, ","), lambda name: F.btrim(name, F.lit(" \t\r\n")))
    names = F.array_distinct(F.filter(trimmed, lambda name: name != ""))
    order = F.array(*[F.lit(name) for name in LAYER_ORDER])
    known = F.filter(order, lambda name: F.array_contains(names, name))
    return F.concat(known, F.array_except(names, order))
