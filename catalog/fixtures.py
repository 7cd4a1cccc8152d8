"""Parameter tables for the registered queries.

The driver's texts are invented words, so these name words that do occur in them.
"""

TAXONOMY = {
    "merger": ["the"],
    "partnership": ["of the", "de la"],
    "funding": ["und der", "que"],
    "product": ["tion"],
    "leadership": ["ing", "orre orre"],
}

BOILERPLATE = ["all rights reserved", "licensed under", "released under"]

ENTITIES = {
    "Orre Orre": "ORG",
    "Of": "ORG",
    "Eriner thanea": "PERSON",
    "De": "PERSON",
    "Nicht aulich": "GPE",
    "La": "GPE",
    "Der": "NORP",
    "From ou": "FAC",
    "The and": "PRODUCT",
    "And the": "EVENT",
}

LEMMAS = {
    "orre": "or", "tion": "t", "rewh": "re", "thatin": "that", "ononst": "on", "les": "le",
    "des": "de", "und": "un", "la": "l", "que": "qu",
}

SIGNALS = ["tion", "ing", "orre", "la", "und"]

PHRASE_SIGNALS = ["tion", "orre", "ment"]

# (sector, query_idx, query)
QUERIES = [
    ("S0", 0, '"of the"'),
    ("S0", 1, "orre"),
    ("S1", 0, "de la"),
    ("S1", 1, "und"),
    ("S2", 0, "licensed under"),
    ("S2", 1, "of the"),
]
