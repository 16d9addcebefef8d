from verbaloom.plans.annotate import annotate, store_annotation
from verbaloom.plans.packs import chart_pack, export_all, stats_pack, summary_pack

__all__ = [
    "annotate", "chart_pack", "export_all", "stats_pack", "store_annotation", "summary_pack",
]
