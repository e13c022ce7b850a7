"""Training-data operators: packing, quality, extraction, language, tokens, scoring, near duplicates, chat, toxicity, search."""
