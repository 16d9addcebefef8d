"""Small inputs whose results were worked out by hand."""

from collections import Counter
from itertools import combinations

COLUMNS = (
    "doc_id long, sent_ix long, tok_ix long, FORM string, LEMMA string, UPOS string, "
    "XPOS string, HEAD int, DEPREL string, NER string"
)

TWO_SENTENCES = [
    (1, 1, 1, "El", "el", "DET", "_", 2, "det", "O"),
    (1, 1, 2, "gato", "gato", "NOUN", "_", 3, "nsubj", "O"),
    (1, 1, 3, "ve", "ver", "VERB", "_", 0, "root", "O"),
    (1, 1, 4, "el", "el", "DET", "_", 5, "det", "O"),
    (1, 1, 5, "gato", "gato", "NOUN", "_", 3, "obj", "O"),
    (1, 1, 6, ".", ".", "PUNCT", "_", 3, "punct", "O"),
    (1, 2, 1, "María", "María", "PROPN", "_", 2, "nsubj", "B-PER"),
    (1, 2, 2, "come", "comer", "VERB", "_", 0, "root", "O"),
    (1, 2, 3, "en", "en", "ADP", "_", 4, "case", "O"),
    (1, 2, 4, "San", "San", "PROPN", "_", 2, "obl", "B-LOC"),
    (1, 2, 5, "José", "José", "PROPN", "_", 4, "flat", "I-LOC"),
    (1, 2, 6, ".", ".", "PUNCT", "_", 2, "punct", "O"),
]


def two_sentences(spark):
    return spark.createDataFrame(TWO_SENTENCES, COLUMNS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_pairs(sequences, window):
    """Two for each pair of places that are at most ``window`` apart."""
    counts = Counter()
    for seq in sequences:
        for (i, a), (j, b) in combinations(enumerate(seq), 2):
            if j - i <= window:
                counts[min(a, b), max(a, b)] += 2
    return dict(counts)
