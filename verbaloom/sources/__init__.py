from verbaloom.sources.tables import corpus_from_table, corpus_from_text, without_markup
from verbaloom.sources.text_files import decode_text, read_text_files
from verbaloom.sources.token_tsv import TSV_OPTIONS, fill_tokens, read_tokens

__all__ = [
    "TSV_OPTIONS", "corpus_from_table", "corpus_from_text", "decode_text", "fill_tokens",
    "read_text_files", "read_tokens", "without_markup",
]
