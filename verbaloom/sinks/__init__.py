from verbaloom.sinks.conllu import conllu_blocks, read_conllu, write_conllu
from verbaloom.sinks.report import read_report, report_lines, write_report
from verbaloom.sinks.sentence_json import sentence_objects, write_json
from verbaloom.sinks.tables import write_tables
from verbaloom.sinks.token_tsv import tsv_rows, write_tokens

__all__ = [
    "conllu_blocks", "read_conllu", "read_report", "report_lines", "sentence_objects", "tsv_rows",
    "write_conllu", "write_json", "write_report", "write_tables", "write_tokens",
]
